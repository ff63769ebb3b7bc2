"""Price history: observations and deal scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(c: Column) -> Column:
    return F.round(c.cast("decimal(20,4)") * 100, 0).cast("long")


def half_up(num: Column, den: Column) -> Column:
    """num / den as a whole number, halves away from zero."""
    return F.when(
        num < 0, -F.floor((den - num * 2).cast("decimal(25,0)") / (den * 2).cast("decimal(12,0)")).cast("long")
    ).otherwise(F.floor((den + num * 2).cast("decimal(25,0)") / (den * 2).cast("decimal(12,0)")).cast("long"))


def append_price_history(offers: DataFrame, as_of: datetime) -> DataFrame:
    """One observation per offer, in the columns of the history."""
    return offers.select(
        F.col("id").alias("offer_id"), "external_id", "price", "loyalty_price", "original_price", "discount_percent", "store", "category",
        F.lit(as_of).cast("timestamp").alias("observed_at"),
    )


def deal_scores(offers: DataFrame, history: DataFrame, as_of: datetime, days: int = 90, min_obs: int = 3, null_price_is_best: bool = False) -> DataFrame:
    """Every offer with its price against the last ``days`` days of observations.

    Adds observation_count, avg_, min_ and max_price_90d, pct_below_avg (against
    the rounded mean) and price_percentile (share of observations at or below the
    current price), each with one decimal, null below ``min_obs``. All of it is
    one aggregation over history joined with the offers on external_id; where rows
    repeat an external_id, the least of their prices counts for all. Without a
    current price both scores are null, or the percentile 0 with
    ``null_price_is_best``.
    """
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    seen = history.filter((F.col("observed_at") >= since) & F.col("price").isNotNull()).select("external_id", cents(F.col("price")).alias("h"))
    now = offers.filter("external_id is not null").groupBy(F.col("external_id").alias("k")).agg(F.min(cents(F.col("price"))).alias("p"))
    stats = (
        seen.join(now, seen["external_id"] == now["k"]).groupBy("external_id")
        .agg(
            F.count("*").alias("n"), F.sum("h").alias("total"), F.min("h").alias("low"), F.max("h").alias("high"),
            F.count_if(F.col("h") <= F.col("p")).alias("at_or_below"),
        )
        .withColumn("mean", half_up(F.col("total"), F.col("n")))
    )
    return scored_offers(offers, stats, min_obs, null_price_is_best)


def scored_offers(offers: DataFrame, stats: DataFrame, min_obs: int, null_price_is_best: bool) -> DataFrame:
    """``offers`` with the scores that ``stats`` (external_id, n, low, high, mean, at_or_below) give."""
    scored = offers.join(stats, "external_id", "left").withColumn("__p", cents(F.col("price")))
    enough = F.col("n") >= min_obs
    below = F.when(enough & (F.col("mean") > 0), half_up((F.col("mean") - F.col("__p")) * 1000, F.col("mean")))
    share = F.when(enough & (F.col("__p").isNotNull() | F.lit(null_price_is_best)), half_up(F.col("at_or_below") * 1000, F.col("n")))

    def money(c: str) -> Column:
        return (F.col(c).cast("decimal(18,0)") / 100).cast("decimal(10,2)")

    return scored.select(
        *[offers[c] for c in offers.columns],
        money("mean").alias("avg_price_90d"), money("low").alias("min_price_90d"), money("high").alias("max_price_90d"),
        F.col("n").alias("observation_count"),
        (below.cast("decimal(18,0)") / 10).cast("decimal(18,1)").alias("pct_below_avg"),
        (share.cast("decimal(18,0)") / 10).cast("decimal(5,1)").alias("price_percentile"),
    )


def daily_percentiles(history: DataFrame, days: int = 90, min_obs: int = 3) -> DataFrame:
    """Every offer's percentile on every day that it was observed, each against the ``days`` days before.

    Returns external_id, day, price (the day's lowest, in cents), observations (in
    the window, that day included) and percentile_tenths (share of them at or
    below that price, in tenths of a percent, null below ``min_obs``).

    Observations are counted per offer, day and price first. Time is cut into
    blocks as long as the window; a day goes to its own block and, as history, to
    the next one. So a window lies in two blocks, an offer that is observed very
    often is dealt by its blocks, and a row is compared with its window's prices,
    not with all observations of its offer.
    """
    length = days + 1
    seen = history.filter("external_id is not null and price is not null and observed_at is not null")
    counted = seen.groupBy("external_id", F.unix_date(F.to_date("observed_at")).alias("at"), cents(F.col("price")).alias("cents")).agg(F.count("*").alias("n"))
    by_day = counted.groupBy("external_id", "at").agg(F.collect_list(F.struct("cents", "n")).alias("prices"), F.min("cents").alias("price"))
    own = F.floor(F.col("at") / length)
    dealt = by_day.withColumn("own", own).withColumn("block", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    frame = Window.partitionBy("external_id", "block").orderBy("at").rangeBetween(-days, 0)
    inside = dealt.withColumn("window", F.flatten(F.collect_list("prices").over(frame))).filter("own = block")
    sums = inside.select(
        "external_id", F.date_from_unix_date("at").alias("day"), "price", F.expr("aggregate(window, 0L, (s, x) -> s + x.n)").alias("observations"),
        F.expr("aggregate(window, 0L, (s, x) -> s + if(x.cents <= price, x.n, 0L))").alias("at_or_below"),
    )
    tenths = F.when(F.col("observations") >= min_obs, half_up(F.col("at_or_below") * 1000, F.col("observations")))
    return sums.select("external_id", "day", "price", "observations", tenths.alias("percentile_tenths"))


def top_deals(scores: DataFrame, limit: int = 30) -> DataFrame:
    """Offers of the lowest percentile, ties by external_id."""
    return scores.filter("price_percentile is not null").orderBy("price_percentile", "external_id").limit(limit)


def price_series(history: DataFrame, external_id: Column, limit: int = 500) -> DataFrame:
    """Observations with a price of one offer, oldest first."""
    return history.filter((F.col("external_id") == external_id) & F.col("price").isNotNull()).orderBy("observed_at", "price").limit(limit)
