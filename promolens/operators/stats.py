"""Counts, comparisons and feeds for dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.prices import discount_trust, effective_discount
from promolens.functions.taxonomy import classify, source_bucket, store_class, taxonomy


def with_buckets(offers: DataFrame, labels: DataFrame | None = None, sources: Sequence[str] = ("source", "label", "rules"), **rules) -> DataFrame:
    """Offers with bucket, subcategory, bucket_source and sub_valid.

    The bucket comes from the first of the sources that knows it. The subcategory
    is the label's if it belongs to the bucket, else the rules' (``sub_valid`` tells
    whether that one does).
    """
    from promolens.functions.taxonomy import TAXONOMY, is_valid_pair

    rows = offers
    if labels is not None:
        rows = rows.join(labels.select("external_id", F.col("category").alias("__lc"), F.col("subcategory").alias("__ls")), "external_id", "left")
    else:
        rows = rows.withColumns({"__lc": F.lit(None).cast("string"), "__ls": F.lit(None).cast("string")})
    rows = rows.withColumn("__rule", classify(F.col("title"), F.col("category"), **rules))
    found = {
        "source": source_bucket(F.col("source_category"), F.col("source_category_path")),
        "label": F.when(F.col("__lc").isin(*TAXONOMY), F.col("__lc")),
        "rules": F.col("__rule.bucket"),
    }
    rows = rows.withColumn("bucket", F.coalesce(*[found[s] for s in sources])).withColumn("bucket_source", F.coalesce(*[F.when(found[s].isNotNull(), s) for s in sources]))
    rows = rows.withColumn("subcategory", F.when(is_valid_pair(F.col("bucket"), F.col("__ls")), F.col("__ls")).otherwise(F.col("__rule.subcategory")))
    return rows.withColumn("sub_valid", is_valid_pair(F.col("bucket"), F.col("subcategory"))).drop("__lc", "__ls", "__rule")


def category_counts(bucketed: DataFrame) -> DataFrame:
    """(bucket, subcategory, n) with zeros for every pair of the taxonomy; foreign pairs are kept."""
    rows = bucketed.filter("coalesce(title, '') <> '' or coalesce(category, '') <> '' or coalesce(source_category, '') <> ''")
    counted = rows.groupBy("bucket", "subcategory").agg(F.count("*").alias("n"))
    every = taxonomy(bucketed.sparkSession).select("bucket", "subcategory")
    return counted.join(F.broadcast(every), ["bucket", "subcategory"], "full_outer").select("bucket", "subcategory", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_source(bucketed: DataFrame) -> DataFrame:
    """source if at least half of the offers were resolved by the source's own categories."""
    resolved = F.count_if(F.col("bucket_source") == "source")
    return bucketed.agg(F.when((resolved > 0) & (resolved * 2 >= F.count("*")), "source").otherwise("heuristic").alias("label_source"))


def bucket_offers(bucketed: DataFrame, bucket: str, subcategory: str | None = None, limit: int = 60) -> DataFrame:
    rows = bucketed.filter(F.col("bucket") == bucket)
    if subcategory:
        rows = rows.filter(F.col("subcategory") == subcategory)
    return rows.orderBy(F.desc_nulls_last("discount_percent"), "external_id").limit(limit)


def compare_stores(offers: DataFrame, query: str, shown: int = 8, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(stores, offers): where a product is cheapest, and each store's first offers.

    The ``most`` cheapest hits are compared; stores without a name are "Unbekannt".
    """
    hits = offers.filter("is_active").filter(F.contains(F.lower("title"), F.lit(query.strip().lower()))).orderBy(F.asc_nulls_last("price"), "external_id").limit(most)
    hits = hits.withColumn("store", F.coalesce("store", F.lit("Unbekannt")))
    stores = hits.groupBy("store").agg(F.count("*").alias("n"), F.min("price").alias("min_price"))
    rank = F.row_number().over(Window.partitionBy("store").orderBy(F.asc_nulls_last("price"), "external_id"))
    return stores.orderBy(F.asc_nulls_last("min_price"), "store"), hits.withColumn("rank", rank).filter(F.col("rank") <= shown)


def store_options(offers: DataFrame) -> DataFrame:
    """Stores by number of active offers, with their class."""
    return offers.filter("is_active and store is not null").groupBy("store").agg(F.count("*").alias("n")).withColumn("store_class", store_class(F.col("store"))).orderBy(F.desc("n"), "store")


def top_groups(df: DataFrame, column: str, limit: int = 10, unknown: str = "Unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def ingestion_trend(df: DataFrame, at: str, until: date) -> DataFrame:
    """(day, n) from the first day to ``until``, zeros included."""
    counts = df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n")).filter(F.col("day") <= F.lit(until))
    days = counts.agg(F.min("day").alias("first")).select(F.explode(F.sequence("first", F.lit(until))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def market_kpis(offers: DataFrame, as_of: date, pool: float = 25) -> DataFrame:
    """One row of totals; a missing store counts as one store."""
    current = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(as_of))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of)))
    discounted = F.col("discount_percent") > 0
    return offers.agg(
        F.count("*").alias("total"), F.count_if(current).alias("current"), F.count_if(F.col("valid_from") > F.lit(as_of)).alias("upcoming"),
        F.count_distinct(F.coalesce("store", F.lit(""))).alias("stores"), F.count_if(discounted).alias("discounted"),
        F.avg(F.when(discounted, F.col("discount_percent"))).alias("mean_discount"), F.count_if(F.col("discount_percent") >= pool).alias("pool"),
        F.min("scraped_at").alias("first_scrape"), F.max("scraped_at").alias("last_scrape"), F.avg(F.date_diff("valid_to", "valid_from")).alias("mean_window_days"),
    )


def load_summary(offers: DataFrame, stores: int = 15, keywords: int = 10) -> dict[str, DataFrame]:
    return {
        "stores": top_groups(offers, "store", stores), "keywords": top_groups(offers, "category", keywords),
        "flags": offers.agg(F.count_if(F.col("discount_percent").isNotNull()).alias("with_discount"), F.count_if("requires_loyalty").alias("with_loyalty")),
    }


def run_summary(log: DataFrame) -> DataFrame:
    """Counters of a run log (run_id, step, n): one row per run."""
    steps = ("scraped", "analysed", "stored", "errors")
    return log.groupBy("run_id").agg(*[F.coalesce(F.sum(F.when(F.col("step") == s, F.col("n"))), F.lit(0)).alias(s) for s in steps])


def list_categories(offers: DataFrame) -> DataFrame:
    return offers.filter("is_active and coalesce(category, '') <> ''").select("category").distinct().orderBy("category")


def taxonomy_coverage(offers: DataFrame) -> DataFrame:
    return offers.groupBy("source_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_category")


def age_text(at: Column, as_of: datetime) -> Column:
    """Age in minutes, hours or days."""
    minutes = F.greatest(F.lit(0), F.round((F.lit(as_of).cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 60).cast("long"))
    hours = F.round(minutes / 60).cast("long")
    return (
        F.when(at.isNull(), "unbekannt").when(minutes < 60, F.concat(F.lit("vor "), minutes.cast("string"), F.lit(" min")))
        .when(hours < 36, F.concat(F.lit("vor "), hours.cast("string"), F.lit(" h"))).otherwise(F.concat(F.lit("vor "), F.round(hours / 24).cast("long").cast("string"), F.lit(" Tagen")))
    )


def freshness(offers: DataFrame, as_of: datetime) -> DataFrame:
    latest = offers.agg(F.max("last_seen_at").alias("last_seen_at"))
    return latest.withColumn("age", age_text(F.col("last_seen_at"), as_of))


def _feed_rows(offers: DataFrame, stores: Sequence[str], precut: int | None, **rules) -> DataFrame:
    rows = offers.filter("is_active")
    if stores:
        rows = rows.filter(F.col("store").isin(*stores))
    if precut:
        rows = rows.orderBy(F.desc_nulls_last("discount_percent"), "external_id").limit(precut)
    pair = classify(F.col("title"), F.col("category"), **rules)
    return rows.withColumns({"__pair": pair, "eff": effective_discount(F.col("title"), F.col("discount_percent")), "trust": discount_trust(F.col("title"), F.col("discount_percent"))}).select(
        "*", "__pair.bucket", "__pair.subcategory"
    ).drop("__pair")


def personal_feed(offers: DataFrame, scores: DataFrame, buckets: Sequence[str], stores: Sequence[str] = (), limit: int = 60, precut: int | None = 1000, **rules) -> DataFrame:
    """Offers of preferred buckets by discount, 15 points more for a price in the lowest fifth of its history."""
    rows = _feed_rows(offers, stores, precut, **rules).filter(F.col("bucket").isin(*buckets))
    rows = rows.join(scores.select("external_id", "price_percentile"), "external_id", "left")
    boost = F.coalesce(F.col("eff"), F.lit(0)) + F.when(F.col("price_percentile") <= 20, 15).otherwise(0)
    return rows.withColumn("boost", boost).orderBy(F.desc("boost"), F.desc_nulls_last("discount_percent"), "external_id").limit(limit)


def bargain_radar(offers: DataFrame, buckets: Sequence[str], minimum: float | None, stores: Sequence[str] = (), limit: int = 24, precut: int | None = 1000, **rules) -> DataFrame:
    """Trusted discounts of at least ``minimum`` outside the preferred buckets; none without a minimum."""
    rows = _feed_rows(offers, stores, precut, **rules)
    if minimum is None:
        return rows.limit(0)
    return rows.filter(~F.col("bucket").isin(*buckets) & (F.col("trust") == "trusted") & (F.col("eff") >= minimum)).orderBy(F.desc("eff"), "external_id").limit(limit)


def feed_ids(*feeds: DataFrame, key: str = "external_id", limit: int = 100) -> DataFrame:
    """The ids of the offers that any of several feeds shows, each once: the first ``limit``, feed by feed in order of id."""
    every = feeds[0].select(key, F.lit(0).alias("feed"))
    for n, feed in enumerate(feeds[1:], 1):
        every = every.unionByName(feed.select(key, F.lit(n).alias("feed")))
    return every.groupBy(key).agg(F.min("feed").alias("feed")).orderBy("feed", key).limit(limit).select(key)


def report_lists(offers: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """The report's lists: best discounts, ending soon, next week, newest."""
    from .filters import currently_valid, expiring_soon, next_week_preview

    return {
        "best": currently_valid(offers, as_of).filter("discount_percent is not null").orderBy(F.desc("discount_percent"), "external_id").limit(10),
        "expiring": expiring_soon(offers, as_of).orderBy("valid_to", F.desc_nulls_last("discount_percent"), "external_id").limit(10),
        "next_week": next_week_preview(offers, as_of).orderBy("valid_from", F.asc_nulls_last("store"), "external_id").limit(10),
        "newest": offers.orderBy(F.desc("scraped_at"), "external_id").limit(12),
    }


def url_prefix_counts(links: DataFrame, url: str = "url", depth: int = 1) -> DataFrame:
    """How often each beginning of a path occurs."""
    path = F.regexp_extract(F.regexp_replace(F.col(url), r"^[a-z]+://[^/?#]+", ""), r"^([^?#]*)", 1)
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, depth)
    return links.groupBy(F.concat(F.lit("/"), F.array_join(parts, "/")).alias("prefix")).agg(F.count("*").alias("n"))
