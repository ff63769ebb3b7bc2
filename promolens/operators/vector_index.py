"""A stored inverted-file index of vectors, searched by cosine.

Centroids are fitted on a bounded sample; every vector goes to the list of its
nearest centroid, and a list is a folder of files. A query probes lists in two
ways. By bound: a vector of a list is at most the list's radius away from its
centroid, so a list whose centroid is further from the query than that radius and
the cutoff's angle together holds nothing; what is found is then exact. Or the
nearest ``probes`` lists, which may miss some. Only the files of lists that some
query probes are read; their vectors are compared exactly, by matrix products of
parts of a list with parts of the queries that probe it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Vectors that centroids are fitted on, at most: those with the least hashes of their ids.
MAX_SAMPLE = 50_000
#: Bytes of centroids, at most, that are sent to every task.
MAX_CENTROID_BYTES = 64 << 20
ROUNDS = 8
#: Vectors of a list, and queries that probe it, that are compared at once.
PART = 4096
_SEED = 1117
#: Added to angles, for rounding.
_SLACK = 1e-6


def _unit(column: pa.Array) -> np.ndarray:
    values = column.values if hasattr(column, "values") else column.flatten()
    n = len(column)
    x = np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, len(values) or 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(df: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """Rows whose vector has a direction, of length ``size`` if given; components as doubles."""
    v = F.col(vector).cast("array<double>")
    good = "__v is not null and size(__v) > 0 and forall(__v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(__v, x -> x <> 0)"
    rows = df.withColumn("__v", v).filter(good)
    return (rows if size is None else rows.filter(F.size("__v") == size)).drop(vector).withColumnRenamed("__v", vector)


def fit_centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k directions by rounds of assignment and mean (spherical k-means); empty ones start anew at the worst placed vectors."""
    rng = np.random.default_rng(_SEED)
    centroids = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS):
        likeness = sample @ centroids.T
        own = likeness.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = sample[np.argsort(likeness.max(axis=1))[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


class VectorIndex:
    """An index under ``path``: centroids, lists of (id, vector) with their radii.

    Vectors that are null, zero, of another length than the first ones, or hold a
    component that is null or not finite are not indexed and match nothing. An id
    is inserted once; a batch that is inserted again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fit(self, vectors: DataFrame, id_: str = "id", vector: str = "embedding", lists: int | None = None) -> None:
        """Fits centroids, about the square root of the number of vectors, on at most ``MAX_SAMPLE`` of them."""
        rows = _usable(vectors.select(id_, vector), vector)
        size = rows.agg(F.min(F.struct(id_, F.size(vector).alias("n"))).alias("x")).first()["x"]
        if size is None:
            raise ValueError("there is no vector to fit centroids on")
        rows = rows.filter(F.size(vector) == size["n"])
        table = rows.orderBy(F.xxhash64(id_), id_).limit(MAX_SAMPLE).select(vector).toArrow()
        sample = _unit(table.column(0).combine_chunks())
        room = MAX_CENTROID_BYTES // (8 * size["n"])
        k = max(1, min(lists or round(math.sqrt(rows.count())), len(sample), room))
        found = fit_centroids(sample, k)
        rows = [(n, c.tolist()) for n, c in enumerate(found)]
        self.spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # at most MAX_CENTROID_BYTES
        return np.array([r["centroid"] for r in rows])

    def insert(self, vectors: DataFrame, batch: str, id_: str = "id", vector: str = "embedding") -> None:
        """Adds the vectors of a batch to their lists."""
        shared = self.spark.sparkContext.broadcast(self.centroids())
        rows = _usable(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter("id is not null"), "v", shared.value.shape[1])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    likeness = _unit(b.column(1)) @ shared.value.T
                    own = likeness.argmax(axis=1)
                    angle = np.arccos(np.clip(likeness[np.arange(len(own)), own], -1, 1))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(angle)], ["id", "v", "list", "angle"])

        kind = rows.schema["id"].dataType.simpleString()
        placed = rows.mapInArrow(place, f"id {kind}, v array<double>, list int, angle double").withColumn("batch", F.lit(batch))
        # a list of many vectors is written by several tasks
        dealt = placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list", "batch").parquet(f"{self.path}/lists")
        sizes = self._members().groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes")

    def files(self, lists: list[int]) -> list[str]:
        """The folders of some lists."""
        return [f"{self.path}/lists/list={k}" for k in lists]

    def _members(self, lists: list[int] | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/lists")
        return reader.parquet(*(self.files(lists) if lists is not None else [f"{self.path}/lists"]))

    def search(self, queries: DataFrame, k: int = 8, cutoff: float = 0.6, probes: int | None = None, digits: int | None = None, id_: str = "query_id", vector: str = "vector") -> DataFrame:
        """(query_id, id, similarity, rank): the k most similar vectors of each query, from ``cutoff`` on; ties by id.

        With ``probes`` only that many of the nearest lists are searched. ``digits``
        rounds the similarity before it is compared.
        """
        kind = queries.schema[id_].dataType.simpleString()
        try:
            sizes = self.spark.read.parquet(f"{self.path}/sizes").orderBy("list").collect()  # one row per list
        except AnalysisException:
            sizes = []
        where = np.array([r["list"] for r in sizes], np.int64)
        radius = np.array([r["radius"] for r in sizes], np.float64)
        centroids = self.centroids()
        reach = math.acos(max(-1.0, min(1.0, cutoff - (0.5 * 10.0**-digits if digits is not None else 0.0))))
        shared = self.spark.sparkContext.broadcast((centroids[where], where, radius))
        asked = _usable(queries.select(F.col(id_).alias("query_id"), F.col(vector).alias("q")).filter("query_id is not null"), "q", centroids.shape[1])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle, names, wide = shared.value
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                angle = np.arccos(np.clip(_unit(b.column(1)) @ middle.T, -1, 1))
                near = angle <= wide + reach + _SLACK
                if probes is not None and probes < len(names):
                    allowed = np.zeros_like(near)
                    np.put_along_axis(allowed, np.argpartition(angle, probes - 1, axis=1)[:, :probes], True, axis=1)
                    near &= allowed
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(names[j].astype(np.int32))], ["query_id", "list"])

        probed = asked.mapInArrow(probe, f"query_id {kind}, list int")
        counts = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row per list
        if not counts:
            member = self.spark.read.parquet(f"{self.path}/lists").schema["id"].dataType.simpleString() if sizes else "long"
            return self.spark.createDataFrame([], f"query_id {kind}, id {member}, similarity double, rank int")
        parts = self.spark.createDataFrame(
            [(r["list"], -(-r["n"] // PART), -(-counts[r["list"]] // PART)) for r in sizes if r["list"] in counts], "list int, v_parts long, q_parts long"
        )
        members = self._members(sorted(counts)).select("list", "id", "v").join(F.broadcast(parts), "list")
        left = members.select(
            "list", F.pmod(F.xxhash64("id"), "v_parts").alias("vp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)).alias("qp"), "id", "v"
        )
        right = asked.join(probed, "query_id").join(F.broadcast(parts), "list").select(
            F.col("list").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_parts") - 1)).alias("v_part"),
            F.pmod(F.xxhash64("query_id"), "q_parts").alias("q_part"), "query_id", "q",
        )
        member = left.schema["id"].dataType.simpleString()

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            names = ["query_id", "id", "similarity"]
            kinds = [b.column("query_id").type, a.column("id").type, pa.float64()]
            if not a.num_rows or not b.num_rows:
                return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
            a = a.combine_chunks().sort_by("id")
            v, q = _unit(a.column("v").combine_chunks()), _unit(b.column("q").combine_chunks())
            out = []
            for at in range(0, len(q), 512):
                value = q[at : at + 512] @ v.T
                value = np.round(value, digits) if digits is not None else value
                i, j = np.nonzero(value >= cutoff)
                order = np.lexsort((j, -value[i, j], i))  # by query, similarity, id
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                i, j = i[keep], j[keep]
                out.append(pa.Table.from_arrays([b.column("query_id").take(pa.array(at + i)), a.column("id").take(pa.array(j)), pa.array(value[i, j])], names))
            return pa.concat_tables(out)

        pairs = left.groupBy("list", "vp", "qp").cogroup(right.groupBy("l", "v_part", "q_part")).applyInArrow(compare, f"query_id {kind}, id {member}, similarity double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
