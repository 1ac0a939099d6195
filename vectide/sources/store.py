"""Collections on disk: immutable Parquet segments, and manifests of rising version, of which the last counts.

A write adds one small segment (rows, or ids deleted) and the next manifest,
which only one writer can create; another one takes the version after it, so
that no commit is lost between applications.  Readers take the base and put the
latest of the later segments over it; the base is anti-joined with their ids and
not shuffled while these are few.  Many segments are merged by tiers: the latest
ones, as far back as none is much larger than those after it, so that a row is
rewritten a logarithmic number of times; the base joins in when its turn comes.
A crash between the two writes leaves the old manifest, and files that nothing names.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CollectionAlreadyExists, CollectionNotFound, StorageError
from ..operators.merge import last_wins
from ..schema import ROWS, CollectionConfig
from .files import Files

#: Segments over the base before a write merges the latest.
MOST_SEGMENTS = 12
#: Manifests that vacuum() leaves.
KEPT_MANIFESTS = 16
#: pos orders the rows of one id within a segment.
_SEGMENT = T.StructType([*ROWS.fields, T.StructField("deleted", T.BooleanType(), True), T.StructField("pos", T.LongType(), True)])


@dataclass
class Manifest:
    version: int = 0
    base: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    #: Bytes of the base, and of each segment.
    base_bytes: int = 0
    sizes: list[int] = field(default_factory=list)


class CollectionStore:
    """The rows of one collection under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.lock = threading.RLock()

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: CollectionConfig) -> CollectionStore:
        store = cls(spark, path)
        store.files.mkdirs(f"{store.path}/manifests")
        store._commit(Manifest())
        if not store.files.create(f"{store.path}/config.json", json.dumps(config.to_dict(), indent=2)):
            raise CollectionAlreadyExists(config.name)
        return store

    @property
    def config(self) -> CollectionConfig:
        return CollectionConfig(**json.loads(self.files.read(f"{self.path}/config.json")))

    def _manifests(self) -> list[str]:
        return [n for n in self.files.list(f"{self.path}/manifests") if n.endswith(".json")]

    def manifest(self) -> Manifest:
        return Manifest(**json.loads(self.files.read(f"{self.path}/manifests/{self._manifests()[-1]}")))

    def _commit(self, manifest: Manifest) -> bool:
        """Whether the manifest of this version could be made; not if another writer was first."""
        return self.files.create(f"{self.path}/manifests/{manifest.version:012d}.json", json.dumps(vars(manifest)))

    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _latest(self, segments: list[str]) -> DataFrame:
        """The last row of every id in the segments; seq is the place of a segment among them, whoever wrote it when."""
        parts = [self._read([n], _SEGMENT).withColumn("seq", F.lit(k).cast("bigint")) for k, n in enumerate(segments)]
        return last_wins(reduce(DataFrame.union, parts), order=("seq", "pos"))

    def rows(self) -> DataFrame:
        """The live rows, one per id, as of now; later writes don't change what this DataFrame reads."""
        return self._rows(self.manifest())

    def _rows(self, m: Manifest) -> DataFrame:
        if not m.segments:
            return self._read(m.base, ROWS)
        latest = self._latest(m.segments)
        live = latest.where(~F.col("deleted")).select(*ROWS.names)
        if not m.base:
            return live
        return self._read(m.base, ROWS).join(latest.select("id"), "id", "left_anti").select(*ROWS.names).union(live)

    def add(self, rows: DataFrame, deleted: bool = False) -> None:
        """Appends rows (id, vector, metadata, document, seq by order within the write) as one segment."""
        with self.lock:
            name = f"segments/{uuid.uuid4().hex}"
            stamped = rows.withColumn("pos", F.col("seq")).withColumn("deleted", F.lit(deleted))
            stamped.select(*[F.col(f.name).cast(f.dataType) for f in _SEGMENT]).write.parquet(f"{self.path}/{name}")
            size, done = self.files.size(f"{self.path}/{name}"), False
            while not done:
                m = self.manifest()
                m = replace(m, version=m.version + 1, segments=[*m.segments, name], sizes=[*m.sizes, size])
                done = self._commit(m)
            if len(m.segments) > MOST_SEGMENTS:
                self._merge(m)

    def _merge(self, m: Manifest) -> None:
        """Merges the latest segments, as far back as each is at most twice what comes after it; the base too, if that holds for it."""
        start, total = len(m.segments) - 1, m.sizes[-1]
        while start and m.sizes[start - 1] <= 2 * total:
            start -= 1
            total += m.sizes[start]
        if start == 0 and m.base_bytes <= 2 * total:
            self.compact()
        elif start < len(m.segments) - 1:
            name = f"segments/{uuid.uuid4().hex}"
            self._latest(m.segments[start:]).select(*_SEGMENT.names).write.parquet(f"{self.path}/{name}")
            size = self.files.size(f"{self.path}/{name}")
            self._swap(m, name, lambda now: replace(now, segments=[*m.segments[:start], name, *now.segments[len(m.segments) :]], sizes=[*m.sizes[:start], size, *now.sizes[len(m.sizes) :]]))

    def _swap(self, m: Manifest, name: str, change) -> bool:
        """Commits what was made of m, with the segments that have come since; False, and nothing, if m was merged meanwhile."""
        while True:
            now = self.manifest()
            if now.base != m.base or now.segments[: len(m.segments)] != m.segments:
                self.files.delete(f"{self.path}/{name}")
                return False
            if self._commit(replace(change(now), version=now.version + 1)):
                return True

    def compact(self) -> None:
        """Makes one base of base and segments; files of the version before stay until vacuum(), for its readers."""
        with self.lock:
            done = False
            while not done:
                m, name = self.manifest(), f"base/{uuid.uuid4().hex}"
                self._rows(m).write.parquet(f"{self.path}/{name}")
                size = self.files.size(f"{self.path}/{name}")
                done = self._swap(m, name, lambda now: replace(now, base=[name], base_bytes=size, segments=now.segments[len(m.segments) :], sizes=now.sizes[len(m.sizes) :]))

    def vacuum(self, grace: float = 0.0) -> int:
        """Deletes files that the manifest doesn't name, indexes of earlier versions and old manifests; returns how many segments went.

        Where other applications write at the same time, grace must be longer, in
        seconds, than one of their writes takes: younger files stay.
        """
        with self.lock:
            m, gone = self.manifest(), 0
            for kind in ("base", "segments"):
                for name in self.files.list(f"{self.path}/{kind}"):
                    if f"{kind}/{name}" not in (*m.base, *m.segments) and self.files.age(f"{self.path}/{kind}/{name}") >= grace:
                        self.files.delete(f"{self.path}/{kind}/{name}")
                        gone += 1
            old = [f"ann/{n}" for n in self.files.list(f"{self.path}/ann") if int(n.split("-")[0]) < m.version]
            for name in [*old, *(f"manifests/{n}" for n in self._manifests()[:-KEPT_MANIFESTS])]:
                if self.files.age(f"{self.path}/{name}") >= grace:
                    self.files.delete(f"{self.path}/{name}")
            return gone


class DatabaseStore:
    """The collections under a root; a collection is a folder that has a configuration and a manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.files.mkdirs(f"{self.root}/collections")
        self.lock = threading.RLock()

    def _path(self, name: str) -> str:
        return f"{self.root}/collections/{name}"

    def names(self) -> list[str]:
        return [n for n in self.files.list(f"{self.root}/collections") if self.files.exists(f"{self._path(n)}/config.json")]

    def create(self, config: CollectionConfig) -> CollectionStore:
        with self.lock:
            if config.name in self.names():
                raise CollectionAlreadyExists(config.name)
            return CollectionStore.create(self.spark, self._path(config.name), config)

    def open(self, name: str) -> CollectionStore:
        if name not in self.names():
            raise CollectionNotFound(name)
        store = CollectionStore(self.spark, self._path(name))
        if store.config.name != name:
            raise StorageError(f"the folder of '{name}' holds '{store.config.name}'")
        return store

    def drop(self, name: str) -> None:
        with self.lock:
            if name not in self.names():
                raise CollectionNotFound(name)
            self.files.delete(self._path(name))
