"""A stored trigram index for searches of substrings.

Every text is listed under each of its runs of three characters, in lower case.
A task lists the texts of a few megabytes at a time, so a row is a run with the
keys of many texts, not with one; rows are dealt in shards by a hash of the run
and sorted by it, so a run's lists lie together. A text that holds a word holds
all of the word's runs.
So the texts under a word's rarest runs are candidates, and only the buckets that
hold candidates are read for the exact test, which is the same as without the index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from promolens.sources.buckets import BucketTable

SHARDS = 64
#: A word's runs that are looked up, the rarest ones.
LOOKED_UP = 4
#: Characters that are listed at once, at most; longer texts are listed in pieces.
LISTED = 1 << 22
#: Between columns; no word holds it.
_BETWEEN = "\x00"


def runs(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, found in one pass; none begins inside a surrogate pair."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=([^\\uDC00-\\uDFFF]..))"), F.lit(1)))


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, pieces of them) of at most ``LISTED`` characters; pieces of one text overlap by two characters, so no run is lost."""
    numbers, held, room = [], [], LISTED
    for n, text in enumerate(texts):
        for at in range(0, max(len(text) - 2, 0), LISTED - 2):
            piece = text[at : at + LISTED]
            if len(piece) > room:
                yield numbers, held
                numbers, held, room = [], [], LISTED
            numbers.append(n)
            held.append(piece)
            room -= len(piece)
    if held:
        yield numbers, held


def list_runs(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(distinct runs, where each one's list begins and ends, numbers of texts in them); a text is in a run's list once, or once for each of its pieces."""
    n = len(texts)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    alphabet = np.flatnonzero(np.bincount(points))
    if n > 1 and len(alphabet) ** 3 * n >= 1 << 63:  # a run and a text are one number below
        for first, part in ((0, texts[: n // 2]), (n // 2, texts[n // 2 :])):
            yield from ((runs_, ends, first + own) for runs_, ends, own in list_runs(part))
        return
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    code, size = place[points], len(alphabet)
    own = np.repeat(np.arange(n), [len(t) for t in texts])
    found = ((code[:-2] * size + code[1:-1]) * size + code[2:]) * n + own[:-2]
    found = np.sort(found[own[:-2] == own[2:]])
    found = found[np.flatnonzero(np.diff(found, prepend=-1))]
    run, own = np.divmod(found, n)
    begins = np.flatnonzero(np.diff(run, prepend=-1))
    run = run[begins]
    letters = np.stack([alphabet[run // size // size], alphabet[run // size % size], alphabet[run % size]], axis=1)
    joined = letters.astype("<u4").tobytes().decode("utf-32-le")
    yield [joined[k : k + 3] for k in range(0, len(joined), 3)], np.append(begins, len(own)), own


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for numbers, pieces in _pieces(b.column(1).to_pylist()):
            for found, ends, own in list_runs(pieces):
                ids = b.column(0).take(pa.array(np.array(numbers)[own]))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["run", "ids"])


class SubstringIndex:
    """Rows of a schema with a unique ``key``, and the runs of their ``columns``.

    Rows are inserted in batches with ascending numbers; a batch that comes again
    changes nothing. A row of a known key replaces the old one, whose postings
    stay and are sorted out by the exact test.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, columns: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, list(columns)
        self.kind = schema[key].dataType.simpleString()
        self.table = BucketTable(spark, f"{self.path}/rows", schema, [key], buckets)

    def insert(self, rows: DataFrame, batch: int) -> None:
        text = F.concat_ws(_BETWEEN, *[F.coalesce(F.col(c), F.lit("")) for c in self.columns])
        asked = rows.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("id"), F.lower(text).alias("text"))
        listed = asked.mapInArrow(_lists, f"run string, ids array<{self.kind}>")
        placed = listed.withColumns({"batch": F.lit(batch).cast("long"), "shard": F.pmod(F.xxhash64("run"), F.lit(SHARDS)).cast("int")})
        placed.repartition("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(4))).sortWithinPartitions("shard", "run").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch", "shard").parquet(f"{self.path}/lists")
        self.table.merge(rows.filter(F.col(self.key).isNotNull()), batch=("insert", batch))

    def _postings(self) -> DataFrame:
        schema = f"run string, ids array<{self.kind}>, batch long, shard int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/lists")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def candidates(self, words: Sequence[str]) -> DataFrame | None:
        """Keys of rows that may hold one of the words; None if a word is too short to tell."""
        asked = self.spark.createDataFrame([(n, w) for n, w in enumerate(words)], "word int, text string")
        parts = {r["word"]: r["runs"] for r in asked.select("word", runs(F.col("text")).alias("runs")).collect()}  # a query's words
        if any(not r for r in parts.values()):
            return None
        every = sorted({x for r in parts.values() for x in r})
        shards = [r[0] for r in self.spark.createDataFrame([(x,) for x in every], "run string").select(F.pmod(F.xxhash64("run"), F.lit(SHARDS)).cast("int")).distinct().collect()]
        near = self._postings().filter(F.col("shard").isin(shards) & F.col("run").isin(every))
        count = {r["run"]: r["n"] for r in near.groupBy("run").agg(F.sum(F.size("ids")).alias("n")).collect()}  # one row for each run of the words
        found = None
        for r in parts.values():
            rarest = sorted(r, key=lambda x: count.get(x, 0))[:LOOKED_UP]
            some = near.filter(F.col("run").isin(rarest)).select("run", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("run").alias("n")).filter(F.col("n") == len(rarest)).select("id")
            found = some if found is None else found.unionByName(some)
        return found.distinct().withColumnRenamed("id", self.key)

    def rows(self, words: Sequence[str]) -> DataFrame:
        """At least the rows that hold one of the words in one of the columns; all rows if there is no word or a word is too short."""
        keys = self.candidates(words) if words else None
        return self.table.read() if keys is None else self.table.lookup(keys)
