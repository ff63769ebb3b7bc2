"""Keyed merges, deduplication and retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order; a hot key is cut down before the shuffle by the rank limit."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def merge_by_key(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), as_of: datetime | None = None, updated: str = "updated_at") -> DataFrame:
    """Upsert: incoming rows replace current ones of the same key, other rows stay.

    Columns in ``keep`` retain the current value where there is one; columns that
    incoming lacks do too. ``updated`` is set to ``as_of`` for every incoming key.
    Keys must be unique in either table (``dedupe_first`` makes them so).
    """
    stamp = F.lit(as_of).cast("timestamp") if as_of is not None else None
    new = {c.lower() for c in incoming.columns}
    a, b = current.alias("a"), incoming.withColumn("__in", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    both = a.join(b, on, "full_outer")
    out = []
    for c in current.columns:
        old = F.col(f"a.{c}")
        if c in keys:
            value = F.coalesce(F.col(f"b.{c}"), old)
        elif c == updated and stamp is not None:
            value = F.when(F.col("b.__in"), stamp).otherwise(old)
        elif c.lower() not in new:
            value = old
        elif c in keep:
            value = F.coalesce(old, F.col(f"b.{c}"))
        else:
            value = F.when(F.col("b.__in"), F.col(f"b.{c}")).otherwise(old)
        out.append(value.cast(current.schema[c].dataType).alias(c))
    return both.select(*out)


def merge_offers(current: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Upsert offers on external_id: seen now and active again; id, first sighting and vector stay.

    Of repeated incoming keys the one that sorts first by title and URL is taken.
    """
    now = F.lit(as_of).cast("timestamp")
    rows = dedupe_first(incoming.filter("external_id is not null"), ["external_id"], ["title", "url"])
    seen = rows.withColumns({
        "id": F.substring(F.sha2("external_id", 256), 1, 32), "is_active": F.lit(True), "last_seen_at": now, "scraped_at": now,
        "first_seen_at": now, "created_at": now, "updated_at": now,
    })
    return merge_by_key(current, seen, ["external_id"], keep=["id", "first_seen_at", "created_at", "embedding"], as_of=as_of)


def merge_brochure_pages(current: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Upsert brochure pages on external_id; other categories are left out, defaults are filled in."""
    pages = incoming.filter("category = 'prospekt'").withColumns({
        "is_upcoming": F.coalesce("is_upcoming", F.lit(False)), "scraped_at": F.coalesce("scraped_at", F.lit(as_of).cast("timestamp")),
    })
    return merge_by_key(current, dedupe_first(pages, ["external_id"], ["page_number", "image_url"]), ["external_id"], keep=["created_at"], as_of=as_of)


def merge_analyses(current: DataFrame, incoming: DataFrame, offers: DataFrame, as_of: datetime) -> DataFrame:
    """Upsert analyses on offer_id for offers that are there; one analysis for each, the first by its response."""
    known = incoming.join(offers.select(F.col("id").alias("offer_id")).distinct(), "offer_id", "left_semi")
    return merge_by_key(current, dedupe_first(known, ["offer_id"], ["raw_response"]), ["offer_id"], keep=["created_at"], as_of=as_of)


def merge_labels(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert labels on offer and model version; of repeated ones the newest."""
    keys = ["external_id", "model_version"]
    return merge_by_key(current, dedupe_first(incoming, keys, [F.desc("classified_at"), "category", "subcategory"]), keys)


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return incoming.join(known.select(key), key, "left_anti")


def retention_preview(offers: DataFrame, as_of: datetime, days: int = 21) -> DataFrame:
    """How many offers retention would deactivate, and how many vectors it would clear."""
    old = F.col("last_seen_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return offers.agg(
        F.count_if(old & F.col("is_active")).alias("deactivated"), F.count_if(old & F.col("embedding").isNotNull()).alias("embeddings_cleared")
    )


def apply_retention(offers: DataFrame, as_of: datetime, days: int = 21) -> DataFrame:
    """Offers unseen for ``days`` days become inactive and lose their vector."""
    now = F.lit(as_of).cast("timestamp")
    old = F.coalesce(F.col("last_seen_at") < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return offers.withColumns({
        "updated_at": F.when(old & F.col("is_active"), now).otherwise(F.col("updated_at")),
        "is_active": F.when(old, F.lit(False)).otherwise(F.col("is_active")),
        "embedding": F.when(~old, F.col("embedding")),
    })
