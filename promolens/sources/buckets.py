"""Keyed tables in hash buckets, of which a write replaces only those it touches.

A table is a folder of Parquet files, one folder for each bucket and write, and a
log of manifests. A manifest names the folder of every bucket, so consecutive
versions share the files of the buckets that did not change. A version is
committed by putting its manifest where none is yet; a writer that finds one
there starts from it again, and writes its rows again only if it changed one of
the same buckets.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promolens.operators.merge import merge_by_key

BUCKET = "bucket"


class Conflict(RuntimeError):
    """Other writers were always first."""


class BucketTable:
    """A table with unique ``keys`` in ``buckets`` buckets by their hash.

    ``buckets`` is fixed when the table is made; one per some hundred megabytes of
    it is about right, and a manifest has one entry for each. Any number of
    writers may write at the same time, and readers keep the version they began
    with until ``vacuum`` removes it. Rows without a key are refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        if BUCKET in schema.names:
            raise ValueError(f"a column must not be called {BUCKET}")
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        root = self._path("")
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"
        self.buckets = self.manifest()["buckets"] if self.versions() else buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_log") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, folders (of each bucket), batches (last of each writer), note."""
        if version is None:
            done = self.versions()
            if not done:
                return {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}, "note": {}}
            version = done[-1]
        stream = self.fs.open(self._path(f"_log/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_if_absent(self, manifest: dict) -> bool:
        """Whether the manifest became the version it names; it appears as a whole or not at all."""
        made, place = self._path(f"_log/.{uuid.uuid4().hex}.tmp"), self._path(f"_log/{manifest['version']:012d}.json")
        out = self.fs.create(made, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        try:
            if not self.local:
                return self.fs.rename(made, place)  # refused where the place is taken
            os.link(made.toUri().getPath(), place.toUri().getPath())  # a rename would replace a local file
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(made, False)

    # rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = manifest["folders"] if buckets is None else {str(b): manifest["folders"][str(b)] for b in buckets if str(b) in manifest["folders"]}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in wanted.items()])

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that is still there; an empty table before the first."""
        return self._rows(self.manifest(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        asked = keys.select(*self.keys)
        touched = [r[0] for r in asked.select(self._bucket().alias(BUCKET)).distinct().collect()]
        return self._rows(self.manifest(), touched).join(asked, self.keys, "left_semi")

    def files(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return {int(b): f"data/{folder}/{BUCKET}={b}" for b, folder in self.manifest(version)["folders"].items()}

    def rewrite(
        self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None, note: dict | None = None, tries: int = 50
    ) -> int:
        """The touched buckets become ``combine(their rows, incoming)``; returns the version.

        ``combine`` must leave rows of other keys alone. ``batch`` is a writer's
        name and the number of its batch, ascending: a batch that is replayed
        changes nothing. ``note`` is kept with the version.
        """
        if incoming.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in self.keys], F.lit(0)) == 1).limit(1).count():
            raise ValueError(f"rows without {', '.join(self.keys)}")
        touched = [r[0] for r in incoming.select(self._bucket().alias(BUCKET)).distinct().collect()]  # as many as there are buckets at most
        base, folder, made = None, "", []
        for _ in range(tries):
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return now["version"]
            if base is None or any(base["folders"].get(str(b)) != now["folders"].get(str(b)) for b in touched):
                folder = f"{now['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
                if touched:
                    rows = combine(self._rows(now, touched), incoming).select(*self.schema.names)
                    dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys)
                    dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
                made = [n.split("=")[1] for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")]
                base = now
            gone = {str(b) for b in touched}
            folders = {b: f for b, f in now["folders"].items() if b not in gone} | {b: folder for b in made}
            batches = now["batches"] | ({batch[0]: batch[1]} if batch else {})
            after = {"version": now["version"] + 1, "buckets": self.buckets, "folders": folders, "batches": batches, "note": now["note"] | (note or {})}
            if self._put_if_absent(after):
                return after["version"]
        raise Conflict(f"{tries} versions of {self.path} were made by others meanwhile")

    def merge(self, incoming: DataFrame, keep: Sequence[str] = (), as_of: datetime | None = None, updated: str = "updated_at", batch: tuple[str, int] | None = None) -> int:
        """``merge_by_key`` of the touched buckets; keys of ``incoming`` must be unique."""
        return self.rewrite(incoming, lambda current, new: merge_by_key(current, new, self.keys, keep, as_of, updated), batch)

    def vacuum(self, keep: int = 5, grace: float = 86_400) -> list[str]:
        """Deletes all but the newest ``keep`` versions, and folders that none of them names and nobody wrote to for ``grace`` seconds."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"_log/{v:012d}.json"), False)
        used = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = []
        for name in self._names("data"):
            age = time.time() - self.fs.getFileStatus(self._path(f"data/{name}")).getModificationTime() / 1000
            if name not in used and age >= grace:
                self.fs.delete(self._path(f"data/{name}"), True)
                gone.append(name)
        return gone
