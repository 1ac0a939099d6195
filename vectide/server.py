"""Collections over HTTP and JSON: python -m vectide.server --host 0.0.0.0 --port 8080 [--path DIR]."""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
from collections.abc import Callable
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote

from .errors import CollectionNotFound, EngineError
from .plans.catalog import Database
from .schema import index_name, metric_name

log = logging.getLogger(__name__)
Answer = tuple[int, Any]
_ONE = re.compile(r"/collections/([^/]+)(?:/(upsert|query|hybrid|keyword|delete|count))?")


class Routes:
    """What each request does; answers are (status, JSON body)."""

    def __init__(self, db: Database):
        self.db = db

    def handle(self, method: str, path: str, body: Any) -> Answer:
        if path == "/collections" and method == "POST":
            return self._create(body)
        if path == "/collections" and method == "GET":
            return 200, {"collections": self.db.list_collections()}
        if found := _ONE.fullmatch(path):
            name, action = unquote(found[1]), found[2]
            if method == "DELETE" and action is None:
                return self._guarded(lambda: self.db.delete_collection(name), lambda _: (204, None), missing=404)
            if method == "GET" and action == "count":
                return self._guarded(lambda: self.db.get_collection(name).count(), lambda n: (200, {"count": n}), missing=404)
            if method == "POST" and action not in (None, "count"):
                return getattr(self, f"_{action}")(name, body)
        return 404, {"error": "no such route"}

    def _guarded(self, run: Callable[[], Any], answer: Callable[[Any], Answer], missing: int = 400) -> Answer:
        try:
            return answer(run())
        except CollectionNotFound as e:
            return missing, {"error": str(e)}
        except (EngineError, KeyError, TypeError, ValueError) as e:
            return 400, {"error": str(e)}

    def _create(self, body: Any) -> Answer:
        try:
            name, dimension = body["name"], int(body["dimension"])
            metric, index = metric_name(body.get("metric", "cosine")), index_name(body.get("index", "flat"))
        except (EngineError, KeyError, TypeError, ValueError) as e:
            return 400, {"error": str(e)}
        try:
            self.db.create_collection(name, dimension, metric, index)
        except EngineError as e:
            return 409, {"error": str(e)}
        return 201, {"name": name, "dimension": dimension}

    def _upsert(self, name: str, b: Any) -> Answer:
        run = lambda: self.db.get_collection(name).upsert(b["ids"], b["vectors"], b.get("metadata"), b.get("documents"))
        return self._guarded(run, lambda _: (200, {"upserted": len(b["ids"])}))

    def _query(self, name: str, b: Any) -> Answer:
        return self._guarded(lambda: self.db.get_collection(name).query(b["vector"], b.get("top_k", 10), b.get("filter")), _results)

    def _hybrid(self, name: str, b: Any) -> Answer:
        return self._guarded(lambda: self.db.get_collection(name).hybrid_query(b["vector"], b["query"], b.get("top_k", 10), b.get("alpha", 0.5)), _results)

    def _keyword(self, name: str, b: Any) -> Answer:
        return self._guarded(lambda: self.db.get_collection(name).keyword_search(b["query"], b.get("top_k", 10)), _results)

    def _delete(self, name: str, b: Any) -> Answer:
        return self._guarded(lambda: self.db.get_collection(name).delete(b["ids"]), lambda gone: (200, {"deleted": gone}))


def _results(found: list[dict]) -> Answer:
    return 200, {"results": found}


def make_server(db: Database, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that answers for db; port 0 takes a free one."""
    routes = Routes(db)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _serve(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
            except ValueError as e:
                status, out = 400, {"error": f"not JSON: {e}"}
            else:
                try:
                    status, out = routes.handle(self.command, self.path.split("?")[0], body)
                except Exception as e:  # a failed job must not end the connection unanswered
                    log.exception("request failed")
                    status, out = HTTPStatus.INTERNAL_SERVER_ERROR, {"error": str(e)}
            data = b"" if out is None else json.dumps(out).encode("utf-8")
            self.send_response(status)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _serve

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for name, value in (("Origin", "*"), ("Methods", "GET, POST, DELETE, OPTIONS"), ("Headers", "*")):
                self.send_header(f"Access-Control-Allow-{name}", value)
            self.end_headers()

        def log_message(self, format: str, *args: Any) -> None:
            log.info(format, *args)

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--host", default=os.environ.get("VECTIDE_HOST", "0.0.0.0"))
    parser.add_argument("--port", type=int, default=int(os.environ.get("VECTIDE_PORT", "8080")))
    parser.add_argument("--path", default=None)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    make_server(Database(given.path), given.host, given.port).serve_forever()


if __name__ == "__main__":
    main()
