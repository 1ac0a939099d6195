"""The interface of Database and Collection over HTTP."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from .schema import DEFAULT_INDEX, DEFAULT_METRIC

LOCAL = "http://localhost:8080"


class ClientError(Exception):
    """The server refused; the message is "status: reason"."""


class RemoteCollection:
    def __init__(self, client: Client, name: str):
        self.name = name
        self._call = lambda action, body=None: client._call("GET" if body is None else "POST", f"/collections/{quote(name, safe='')}/{action}", body)

    def upsert(self, ids: Sequence[str], vectors: Sequence[Sequence[float]], metadata: Sequence[dict] | None = None, documents: Sequence[str] | None = None) -> dict:
        given = {"ids": ids, "vectors": vectors, "metadata": metadata, "documents": documents}
        return self._call("upsert", {k: v for k, v in given.items() if v is not None})

    def query(self, vector: Sequence[float], top_k: int = 10, filter: dict | None = None) -> list[dict]:
        return self._call("query", {"vector": vector, "top_k": top_k} | ({} if filter is None else {"filter": filter}))["results"]

    def hybrid_query(self, vector: Sequence[float], query: str, top_k=10, alpha=0.5) -> list[dict]:
        return self._call("hybrid", dict(vector=vector, query=query, top_k=top_k, alpha=alpha))["results"]

    def keyword_search(self, query, top_k=10) -> list[dict]:
        return self._call("keyword", dict(query=query, top_k=top_k))["results"]

    def delete(self, ids: Sequence[str]) -> list[bool]:
        return self._call("delete", {"ids": ids})["deleted"]

    def count(self) -> int:
        return self._call("count")["count"]

    def __repr__(self):
        return "RemoteCollection(name=%r)" % self.name


class Client:
    """Speaks to a server; requests end after `timeout` seconds."""

    def __init__(self, base_url=LOCAL, timeout: float = 30.0):
        self.base_url, self.timeout = base_url.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: Any = None) -> Any:
        data = None if body is None else json.dumps(body).encode("utf-8")
        try:
            with urlopen(Request(self.base_url + path, data, {"Content-Type": "application/json"}, method=method), timeout=self.timeout) as answer:
                raw = answer.read()
                return json.loads(raw) if raw else {}
        except HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            try:
                text = json.loads(text)["error"]
            except (ValueError, KeyError, TypeError):
                pass
            raise ClientError(f"{e.code}: {text}") from None

    def __repr__(self):
        return "Client(base_url=%r)" % self.base_url

    def list_collections(self) -> list[str]:
        return self._call("GET", "/collections")["collections"]

    def create_collection(self, name, dimension, metric=DEFAULT_METRIC, index=DEFAULT_INDEX) -> RemoteCollection:
        self._call("POST", "/collections", dict(name=name, dimension=dimension, metric=metric, index=index))
        return self.get_collection(name)

    def delete_collection(self, name) -> None:
        self._call("DELETE", f"/collections/{quote(name, safe='')}")

    def get_collection(self, name) -> RemoteCollection:
        """The collection of a name; whether there is one shows with the first call."""
        return RemoteCollection(self, name)

    def close(self) -> None:
        """Nothing is held between calls."""

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *args: object) -> None:
        self.close()

