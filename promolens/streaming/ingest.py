"""Incremental ingest and alert matching with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promolens.functions.vectors import embed_missing, offer_text
from promolens.operators.alerts import match_alerts
from promolens.operators.history import append_price_history
from promolens.operators.merge import dedupe_first, merge_by_key, merge_offers
from promolens.schema import ALERTS, OFFERS, align_schema
from promolens.sources.buckets import BucketTable
from promolens.sources.listings import dedupe_offers, explode_listing_items, extract_listing_json, normalize_items
from promolens.sources.tables import Snapshots, append_history

PAGES = "url string, html string, keyword string, keyword_rank int, scraped_at timestamp"


def _with_vectors(merged: DataFrame) -> DataFrame:
    return align_schema(embed_missing(merged, offer_text(F.col("title"), F.col("category"), F.col("store"))), OFFERS)


def run_ingest_stream(
    spark: SparkSession, landing: str, offers_path: str, history_path: str, checkpoint: str, base: str, clock: Callable[[DataFrame], datetime], buckets: int | None = None,
    once_within: timedelta | None = None,
) -> StreamingQuery:
    """Pages that arrive in ``landing`` become offers, vectors and observations.

    Each micro-batch is normalised, deduplicated, merged into the offers, and
    appended to the history; a replayed batch changes nothing. With ``buckets``
    the offers are a ``BucketTable`` of that many: a micro-batch then reads and
    writes the buckets of its own keys only. Without, they are snapshots, and each
    one is a copy of the whole table. With ``once_within``, which needs buckets, an
    item that an earlier batch saw less than that time ago goes no further; what was
    seen is in the offers themselves, so a restart keeps it. ``clock`` gives a batch's point in time.
    Runs until what is there is read.
    """
    if once_within is not None and not buckets:
        raise ValueError("once_within needs buckets")
    snapshots = Snapshots(spark, offers_path)

    def normalised(batch: DataFrame, at: datetime) -> DataFrame:
        items = explode_listing_items(extract_listing_json(batch.drop("scraped_at")))
        return align_schema(dedupe_offers(normalize_items(items, at, base)), OFFERS)

    def into_snapshots(batch: DataFrame, number: int) -> None:
        tag = f"b{number}"
        if not any(v.endswith(f"-{tag}") for v in snapshots.versions()):
            at = clock(batch)
            snapshots.write(_with_vectors(merge_offers(snapshots.read(OFFERS), normalised(batch, at), at)), tag)
        merged_now = snapshots.read(OFFERS)
        at = merged_now.agg(F.max("last_seen_at")).first()[0]
        if at is not None:
            append_history(append_price_history(merged_now.filter(F.col("last_seen_at") == F.lit(at)), at), history_path, tag)

    def into_buckets(batch: DataFrame, number: int) -> None:
        table = BucketTable(spark, offers_path, OFFERS, ["external_id"], buckets)
        at = clock(batch)
        rows = normalised(batch, at).filter("external_id is not null")
        if once_within is not None:
            known, now = table.lookup(rows.select("external_id").distinct()), F.lit(at).cast("timestamp")
            if table.manifest()["batches"].get("ingest", -1) >= number:  # merged before a failure: only what this batch brought
                rows = rows.join(known.filter(F.col("last_seen_at") == now).select("external_id"), "external_id", "left_semi")
            else:
                rows = rows.join(known.filter(F.col("last_seen_at") > now - F.expr(f"interval {int(once_within.total_seconds())} seconds")).select("external_id"), "external_id", "left_anti")
        rows = rows.persist()
        try:
            table.rewrite(rows, lambda current, new: _with_vectors(merge_offers(current, new, at)), ("ingest", number))
            append_history(append_price_history(table.lookup(rows.select("external_id").distinct()), at), history_path, f"b{number}")
        finally:
            rows.unpersist()

    pages = spark.readStream.schema(PAGES).parquet(landing)
    return pages.writeStream.foreachBatch(into_buckets if buckets else into_snapshots).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_alert_stream(spark: SparkSession, landing: str, alerts_path: str, checkpoint: str) -> StreamingQuery:
    """Alerts that arrive in ``landing`` get the vector of their query text and join the alerts' next snapshot."""
    alerts = Snapshots(spark, alerts_path)

    def step(batch: DataFrame, number: int) -> None:
        new = embed_missing(align_schema(batch, ALERTS), F.col("query_text"), "query_embedding")
        alerts.write(merge_by_key(alerts.read(ALERTS), dedupe_first(align_schema(new, ALERTS), ["id"], ["created_at", "query_text"]), ["id"]), f"b{number}")

    rows = spark.readStream.schema(ALERTS).parquet(landing)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_alerts_stream(offers: DataFrame, alerts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, as_of: datetime) -> StreamingQuery:
    """New offers against all alerts, micro-batch by micro-batch; ``sink`` gets the matches."""

    def step(batch: DataFrame, number: int) -> None:
        sink(match_alerts(alerts, batch, as_of), number)

    return offers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, at: str = "scraped_at", late: str = "2 days") -> DataFrame:
    """Arrivals per day, with a watermark for late rows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")
