"""Materialised deal scores: a price histogram for each offer, kept up by batches.

The state of an offer is the histogram of its prices in the window: how often each
price was observed. Histograms add up: a batch of observations is counted per
offer, day and price and added; when the window moves on, the days that leave it
are subtracted, from the counts that are stored by day. Mean, least and highest
price and the percentile follow from an offer's histogram alone, so reading the
scores takes one row per offer in place of its observations.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from promolens.operators.history import cents, half_up, scored_offers
from promolens.sources.buckets import BucketTable

_DAYS = "external_id {}, day date, cents long, n long, batch long, month string"


def count_by_day(observations: DataFrame) -> DataFrame:
    """(external_id, day, cents, n) of the observations with a price."""
    rows = observations.filter("external_id is not null and price is not null and observed_at is not null")
    return rows.groupBy("external_id", F.to_date("observed_at").alias("day"), cents(F.col("price")).alias("cents")).agg(F.count("*").alias("n"))


def add_counts(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Histograms after adding (external_id, cents, n), n below 0 to subtract; only offers in ``counts`` are counted anew."""
    keys = counts.select("external_id").distinct()
    entries = state.join(keys, "external_id", "left_semi").select("external_id", F.inline("hist"))
    added = entries.unionByName(counts.select("external_id", "cents", "n")).groupBy("external_id", "cents").agg(F.sum("n").alias("n")).filter("n <> 0")
    changed = added.groupBy("external_id").agg(F.sort_array(F.collect_list(F.struct("cents", "n"))).alias("hist"))
    return state.join(keys, "external_id", "left_anti").unionByName(changed)


def score_histograms(offers: DataFrame, state: DataFrame, min_obs: int = 3, null_price_is_best: bool = False) -> DataFrame:
    """``deal_scores`` of the observations that are counted in ``state``."""
    now = offers.filter("external_id is not null").groupBy(F.col("external_id").alias("k")).agg(F.min(cents(F.col("price"))).alias("p"))
    both = state.join(now, state["external_id"] == now["k"])

    def total(rows: str, value: str) -> str:
        return f"aggregate({rows}, 0L, (s, x) -> s + {value})"

    stats = both.select(
        "external_id", F.expr(total("hist", "x.n")).alias("n"), F.expr(total("hist", "x.n * x.cents")).alias("total"),
        F.expr("hist[0].cents").alias("low"), F.expr("element_at(hist, -1).cents").alias("high"),
        F.coalesce(F.expr(total("filter(hist, y -> y.cents <= p)", "x.n")), F.lit(0).cast("long")).alias("at_or_below"),
    ).withColumn("mean", half_up(F.col("total"), F.col("n")))
    return scored_offers(offers, stats, min_obs, null_price_is_best)


class DealScores:
    """Deal scores of the ``days`` days before a date that only moves on.

    Equal to ``deal_scores`` at midnight (UTC) of that date over all observations
    that were added, in whatever order. A batch is known by its number: added
    again, also after a failure, it counts once. Batches have one writer at a
    time. Observations that are older than the window when they come are left out,
    as they would be at any later date.
    """

    def __init__(self, spark: SparkSession, path: str, start: date, key: DataType | None = None, days: int = 90, buckets: int = 64):
        kind = key or StringType()
        entry = StructType([StructField("cents", LongType()), StructField("n", LongType())])
        schema = StructType([StructField("external_id", kind), StructField("hist", ArrayType(entry))])
        self.spark, self.days, self.start, self.counts = spark, days, start, f"{path.rstrip('/')}/days"
        self.kind = kind.simpleString()
        self.table = BucketTable(spark, f"{path.rstrip('/')}/state", schema, ["external_id"], buckets)

    def as_of(self) -> date:
        return date.fromisoformat(self.table.manifest()["note"].get("as_of", self.start.isoformat()))

    def _since(self, as_of: date) -> date:
        return as_of - timedelta(days=self.days)

    def _stored(self) -> DataFrame:
        schema = _DAYS.format(self.kind)
        try:
            return self.spark.read.schema(schema).parquet(self.counts)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def add(self, observations: DataFrame, batch: int) -> None:
        """Counts a batch of observations; numbers ascend."""
        since = F.lit(self._since(self.as_of()))
        counted = count_by_day(observations).filter(F.col("day") >= since)
        placed = counted.select("external_id", "day", "cents", "n", F.lit(batch).cast("long").alias("batch"), F.date_format("day", "yyyy-MM").alias("month"))
        # the same partitions are replaced when a batch comes again
        placed.repartition("month").sortWithinPartitions("month", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month").parquet(self.counts)
        new = self._stored().filter((F.col("batch") == batch) & (F.col("day") >= since))
        self.table.rewrite(new.select("external_id", "cents", "n"), add_counts, ("add", batch))

    def advance(self, as_of: date) -> None:
        """Moves the window on to ``as_of``: days that leave it are read from their months' folders and subtracted."""
        before = self.as_of()
        if as_of < before:
            raise ValueError(f"the scores are of {before} already")
        first, end = self._since(before), self._since(as_of)
        left = self._stored().filter(
            F.col("month").between(first.strftime("%Y-%m"), end.strftime("%Y-%m")) & (F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(end))
            & (F.col("batch") <= self.table.manifest()["batches"].get("add", -1))  # a batch that failed half way is not in the state yet
        )
        minus = left.groupBy("external_id", "cents").agg((-F.sum("n")).alias("n"))
        self.table.rewrite(minus, add_counts, ("advance", as_of.toordinal()), {"as_of": as_of.isoformat()})

    def scores(self, offers: DataFrame, min_obs: int = 3, null_price_is_best: bool = False) -> DataFrame:
        return score_histograms(offers, self.table.read(), min_obs, null_price_is_best)

    def instant(self) -> datetime:
        """The point in time that ``deal_scores`` takes for the same result."""
        at = self.as_of()
        return datetime(at.year, at.month, at.day, tzinfo=timezone.utc)
