"""Merges, snapshots, streaming ingest and invariants of feeds."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from promolens.operators import alerts, labels, merge, search
from promolens.schema import ALERTS, OFFERS, PRICE_HISTORY, align_schema, validate
from promolens.sources.tables import Snapshots, append_history, read_history
from promolens.streaming.ingest import PAGES, run_alert_stream, run_ingest_stream

AT = datetime(2026, 5, 16, 12, tzinfo=timezone.utc)
LATER = datetime(2026, 5, 17, 12, tzinfo=timezone.utc)


def offers(spark, rows):
    return align_schema(spark.createDataFrame(rows, "external_id string, title string, price double"), OFFERS)


def test_merge_offers_keeps_identity_and_is_idempotent(spark):
    first = merge.merge_offers(spark.createDataFrame([], OFFERS), offers(spark, [("a", "A", 1.0), ("b", "B", 2.0)]), AT)
    second = merge.merge_offers(first, offers(spark, [("b", "B2", 3.0), ("c", "C", 4.0), ("c", "C", 4.0)]), LATER)
    again = merge.merge_offers(second, offers(spark, [("b", "B2", 3.0), ("c", "C", 4.0)]), LATER)
    got = {r["external_id"]: r for r in second.collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["title"] == "B2"
    assert got["b"]["first_seen_at"] < got["b"]["last_seen_at"] and got["a"]["last_seen_at"] == got["a"]["first_seen_at"]
    assert sorted(map(str, again.collect())) == sorted(map(str, second.collect()))


def test_snapshots_switch_and_replay(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/offers")
    assert table.read(OFFERS).count() == 0
    table.write(offers(spark, [("a", "A", 1.0)]), "b0")
    table.write(offers(spark, [("a", "A", 1.0), ("b", "B", 2.0)]), "b1")
    assert table.write(offers(spark, [("z", "Z", 1.0)]), "b1") == table.versions()[-1]
    assert table.read(OFFERS).count() == 2


def test_history_replay_does_not_repeat(spark, tmp_path):
    rows = align_schema(spark.createDataFrame([("a", AT)], "external_id string, observed_at timestamp"), PRICE_HISTORY)
    path = f"file://{tmp_path}/history"
    for _ in range(2):
        append_history(rows, path, "b0")
    append_history(rows, path, "b1")
    assert read_history(spark, path, PRICE_HISTORY).count() == 2
    assert read_history(spark, path, PRICE_HISTORY, LATER).count() == 0


def test_ingest_stream(spark, tmp_path):
    item = {"id": "1", "type": "OFFER", "title": "Milch", "brand": "Marke", "publisherName": "Lidl", "prices": {"mainPrice": 1.0, "secondaryPrice": 2.0}}
    listing = {"props": {"pageProps": {"pageInformation": {"offers": {"main": {"items": [item, dict(item, id="2", type="AD")]}}}}}}
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(listing)}</script>'
    landing = f"file://{tmp_path}/landing"
    spark.createDataFrame([("u", page, "milch", 0, AT), ("v", page, "mehr", 1, AT), ("w", "<html>", "x", 2, AT)], PAGES).write.parquet(landing)
    paths = (landing, f"file://{tmp_path}/offers", f"file://{tmp_path}/history", f"file://{tmp_path}/check")
    for _ in range(2):
        run_ingest_stream(spark, *paths, "https://offers.example", lambda batch: AT).awaitTermination()
    got = Snapshots(spark, paths[1]).read(OFFERS).collect()
    assert [(r["external_id"], r["title"], float(r["discount_percent"]), r["category"]) for r in got] == [("1", "Marke Milch", 50.0, "milch")]
    assert got[0]["embedding"] is not None and read_history(spark, paths[2], PRICE_HISTORY).count() == 1


def test_alert_stream_embeds(spark, tmp_path):
    landing, table = f"file://{tmp_path}/landing", f"file://{tmp_path}/alerts"
    rows = spark.createDataFrame([("1", "u", "Kaffee"), ("2", "u", " ")], "id string, user_id string, query_text string")
    align_schema(rows, ALERTS).write.parquet(landing)
    run_alert_stream(spark, landing, table, f"file://{tmp_path}/check").awaitTermination()
    got = {r["id"]: r["query_embedding"] for r in Snapshots(spark, table).read(ALERTS).collect()}
    assert len(got["1"]) == 64 and got["2"] is None


def test_validate_splits(spark):
    good, bad = validate(spark.createDataFrame([("sent",), ("lost",), (None,)], "status string"))
    assert good.count() == 2 and bad.count() == 1


def test_review_patch_rejects_unknown_fields(spark):
    analyses = spark.createDataFrame([("1", "A", "B"), ("2", "C", "D")], "offer_id string, product_name string, brand string")
    patches = spark.createDataFrame([("1", {"brand": "X"}), ("2", {"raw": "Y"})], "offer_id string, patch map<string,string>")
    out, bad = labels.apply_review_patches(analyses, patches)
    assert {r["offer_id"]: r["brand"] for r in out.collect()} == {"1": "X", "2": "D"} and bad.count() == 1


def test_first_tier(spark):
    a, b = spark.range(0), spark.range(3)
    assert {r["tier"] for r in search.first_tier([a, b]).collect()} == {1}


def test_touch_and_deactivate(spark):
    rows = spark.createDataFrame([("1", "u", True, None), ("2", "v", True, None)], "id string, user_id string, is_active boolean, last_triggered_at timestamp")
    hit = alerts.touch_alerts(rows, spark.createDataFrame([("u",)], "user_id string"), AT)
    assert hit.filter(F.col("last_triggered_at").isNotNull()).count() == 1
    off = alerts.deactivate_alerts(rows, spark.createDataFrame([("1", "v"), ("2", "v")], "id string, user_id string"))
    assert [r["id"] for r in off.filter("is_active").collect()] == ["1"]
