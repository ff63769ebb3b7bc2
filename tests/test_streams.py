"""Streams and jobs on small tables."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from promolens.operators.stats import feed_ids
from promolens.sources.tables import Snapshots
from promolens.streaming.ingest import daily_counts, match_alerts_stream
from promolens.streaming.jobs import run_digest

AS_OF = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
OFFERS = "id long, price decimal(10,2), discount_percent decimal(5,1), store string, category string, is_active boolean, scraped_at timestamp, embedding array<float>"
ALERTS = (
    "id long, user_id string, name string, query_embedding array<float>, similarity_threshold double, max_price decimal(10,2), is_active boolean, stores array<string>, "
    "min_discount decimal(5,1), categories array<string>, last_triggered_at timestamp"
)
USERS = "id string, telegram_chat_id string, email string, notification_channel string, is_active boolean"


def offers(spark):
    at = datetime(2024, 1, 18, tzinfo=timezone.utc)
    return spark.sql("select id, cast(10 + id as decimal(10,2)) price, cast(null as decimal(5,1)) discount_percent, 'Lidl' store, 'x' category, true is_active, array(cast(1 as float), cast(id % 3 as float)) embedding from range(6)").withColumn(
        "scraped_at", F.lit(at).cast("timestamp")
    )


def alerts(spark):
    rows = [(1, "u1", "a", [1.0, 0.0], 0.9, None, True, None, None, None, None), (2, "u2", "b", [1.0, 2.0], 0.9, None, True, None, None, None, None), (3, "u3", "c", [1.0, 0.0], 0.9, None, True, None, None, None, None), (4, "u1", "d", [0.0, -1.0], 0.9, None, True, None, None, None, None)]
    return spark.createDataFrame(rows, ALERTS)


def test_digest_run(spark):
    users = spark.createDataFrame([("u1", "t1", None, "telegram", True), ("u2", None, "m2", None, True), ("u3", None, None, "email", True)], USERS)
    log, touched = run_digest(alerts(spark), users, offers(spark), AS_OF)
    assert {(r["user_id"], r["status"], r["payload_summary"], tuple(r["offer_ids"])) for r in log.collect()} == {("u1", "sent", "2 Angebote", (0, 3)), ("u2", "skipped", "4 Angebote", (2, 5, 1, 4))}
    assert {r["id"] for r in touched.filter("last_triggered_at is not null").collect()} == {1, 4}


def test_digest_run_without_matches(spark):
    users = spark.createDataFrame([], USERS)
    log, touched = run_digest(alerts(spark), users, offers(spark), AS_OF)
    assert log.count() == 0 and touched.filter("last_triggered_at is not null").count() == 0 and touched.count() == 4


def test_alert_matching_of_arriving_offers(spark, tmp_path):
    offers(spark).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(offers(spark).schema).parquet(f"{tmp_path}/in")
    query = match_alerts_stream(stream, alerts(spark), lambda df, n: seen.extend((r["alert_id"], r["id"]) for r in df.collect()), f"{tmp_path}/state", AS_OF)
    query.awaitTermination(120)
    assert set(seen) == {(1, 0), (1, 3), (3, 0), (3, 3), (2, 1), (2, 2), (2, 4), (2, 5)}


def test_daily_counts_of_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 06:00:00' + make_dt_interval(cast(id % 3 as int)) as scraped_at from range(10)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = daily_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(120)
    assert {(str(r["day"]), r["n"]) for r in spark.table("days").collect()} == {("2024-01-01", 4), ("2024-01-02", 3), ("2024-01-03", 3)}


def test_old_snapshots_go(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/t", keep=3)
    for k in range(6):
        table.write(spark.range(k + 1), f"b{k}")
    assert [v.split("-")[1] for v in table.versions()] == ["b3", "b4", "b5"] and table.read(spark.range(1).schema).count() == 6
    assert table.write(spark.range(99), "b4").endswith("-b4") and table.read(spark.range(1).schema).count() == 6


def test_union_of_feeds(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "external_id long") for xs in ([1, 2, 2], [2, 3]))
    assert sorted(r[0] for r in feed_ids(a, b).collect()) == [1, 2, 3]
