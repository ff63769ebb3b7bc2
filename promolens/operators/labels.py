"""Versioned category labels, model responses and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.taxonomy import TAXONOMY, is_valid_pair

from .merge import dedupe_first

_RESULT = "struct<results:array<struct<id:string,category:string,subcategory:string,confidence:double,reasoning:string>>>"


def latest_labels(labels: DataFrame) -> DataFrame:
    """The newest label of each offer; equal times by model version, descending."""
    return dedupe_first(labels, ["external_id"], [F.desc("classified_at"), F.desc("model_version")])


def pending_labels(offers: DataFrame, labels: DataFrame, version: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """Active offers without a label of a version (or all), newest first."""
    rows = offers.filter("is_active")
    if not force:
        done = labels.filter(F.col("model_version") == version).select("external_id")
        rows = rows.join(done, "external_id", "left_anti")
    if limit is None:
        return rows
    return rows.orderBy(F.desc("scraped_at"), "external_id").limit(limit)


#: Offers of a shard, about, in which payloads are numbered.
SHARD_ROWS = 5_000


def label_batches(pending: DataFrame, size: int = 25, shards: int | None = None) -> DataFrame:
    """Payloads of at most ``size`` offers as JSON: (shard, batch, n, payload).

    Offers are numbered within shards by hash of their id, one for every
    ``SHARD_ROWS`` of them, so no task sees all.
    """
    if shards is None:
        shards = max(1, -(-pending.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("external_id"), F.lit(shards))
    at = F.row_number().over(Window.partitionBy("shard").orderBy("external_id"))
    return (
        pending.withColumn("shard", shard).withColumn("batch", F.floor((at - 1) / size))
        .groupBy("shard", "batch")
        .agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(F.struct("external_id", "title", "store")))).alias("payload"))
    )


def json_object(text):
    """The outermost {...} of a noisy text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def parse_label_responses(responses: DataFrame) -> DataFrame:
    """(offer_id, category, subcategory, confidence, reasoning) of every result in model responses.

    ``responses`` has ``response``; text around the JSON is ignored, and a response
    that cannot be read gives no rows.
    """
    parsed = responses.select(F.from_json(json_object(F.col("response")), _RESULT, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(F.explode("r.results").alias("x")).select(
        F.col("x.id").alias("offer_id"), "x.category", "x.subcategory", "x.confidence", "x.reasoning"
    )


def validate_labels(results: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): results of known offers with a known category.

    A subcategory of another bucket becomes the bucket's first one (``coerced``),
    a missing confidence 0.5, reasoning is cut at 500 characters.
    """
    known = results.join(offers.select(F.col("id").alias("offer_id"), "external_id"), "offer_id", "left")
    ok = F.coalesce(F.col("external_id").isNotNull() & F.col("category").isin(*TAXONOMY), F.lit(False))
    first = F.create_map(*[F.lit(x) for b, subs in TAXONOMY.items() for x in (b, subs[0])])[F.col("category")]
    valid = is_valid_pair(F.col("category"), F.col("subcategory"))
    good = known.filter(ok).select(
        "external_id", "offer_id", "category", F.when(valid, F.col("subcategory")).otherwise(first).alias("subcategory"), (~valid).alias("coerced"),
        F.coalesce("confidence", F.lit(0.5)).cast("decimal(3,2)").alias("confidence"), F.substring("reasoning", 1, 500).alias("reasoning"),
    )
    return good, known.filter(~ok).drop("external_id")


def build_analyses(offers: DataFrame, responses: DataFrame) -> DataFrame:
    """Analysis rows from model responses (offer_id, response), with defaults for what is missing."""
    kind = "struct<product_name:string,brand:string,condition:string,key_features:array<string>,quality_score:double,deal_verdict:string,tags:array<string>>"
    r = responses.withColumn("r", F.from_json(json_object(F.col("response")), kind))
    return offers.select(F.col("id").alias("offer_id"), "title").join(r, "offer_id").select(
        "offer_id", F.coalesce("r.product_name", "title").alias("product_name"), F.coalesce("r.brand", F.lit("Unbekannt")).alias("brand"),
        F.coalesce("r.condition", F.lit("unbekannt")).alias("condition"), F.coalesce("r.key_features", F.array().cast("array<string>")).alias("key_features"),
        F.coalesce("r.quality_score", F.lit(0.5)).cast("decimal(3,2)").alias("quality_score"),
        F.coalesce("r.deal_verdict", F.lit("Durchschnittlich")).alias("deal_verdict"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"),
        F.col("response").alias("raw_response"),
    )


def parse_page_analyses(responses: DataFrame) -> DataFrame:
    """Brochure page responses: summary, the first five offers, and a hint."""
    kind = "struct<page_summary:string,top_offers:array<struct<product:string,price:string,badge:string>>,comparison_hint:string>"
    r = responses.withColumn("r", F.from_json(json_object(F.col("response")), kind))
    return r.select("external_id", "r.page_summary", F.slice(F.coalesce("r.top_offers", F.array().cast("array<struct<product:string,price:string,badge:string>>")), 1, 5).alias("top_offers"), "r.comparison_hint")


def apply_review_patches(analyses: DataFrame, patches: DataFrame, allowed: tuple[str, ...] = ("product_name", "brand", "condition", "deal_verdict")) -> tuple[DataFrame, DataFrame]:
    """(patched analyses, rejected patches). ``patches``: offer_id and a map of new values.

    A patch with a field that may not be edited is rejected as a whole.
    """
    extra = F.array_except(F.map_keys("patch"), F.array(*map(F.lit, allowed)))
    good, bad = patches.filter(F.size(extra) == 0), patches.filter(F.size(extra) > 0)
    joined = analyses.join(good.select("offer_id", "patch"), "offer_id", "left")
    out = [F.coalesce(F.col("patch")[c], F.col(c)).alias(c) if c in allowed else F.col(c) for c in analyses.columns]
    return joined.select(*out), bad


def append_reviews(decisions: DataFrame, offers: DataFrame, analyses: DataFrame) -> DataFrame:
    """Review rows: decisions joined with what was scraped and what the model saw."""
    o = offers.select("external_id", F.col("id").alias("offer_id"), F.col("url").alias("offer_url"), "image_url", F.col("title").alias("scraped_title"), F.col("store").alias("scraped_store"), F.col("price").alias("scraped_price"), "validity_text")
    a = analyses.select("offer_id", F.col("product_name").alias("vision_product_name"), F.col("brand").alias("vision_brand"), F.col("condition").alias("vision_condition"), F.col("key_features").alias("vision_key_features"), F.col("deal_verdict").alias("vision_verdict"))
    return decisions.join(o, "external_id", "left").join(a, "offer_id", "left").drop("offer_id")


def review_queue(offers: DataFrame, analyses: DataFrame, order: str = "position") -> DataFrame:
    """Offers under review with their analysis, in their order."""
    return offers.join(analyses.withColumnRenamed("offer_id", "id"), "id", "left").orderBy(order)


def review_summary(reviews: DataFrame) -> DataFrame:
    """Decisions per session."""
    return reviews.groupBy("review_session_id").agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("approved", "rejected", "flagged")], F.count("*").alias("total")
    )
