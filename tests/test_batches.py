"""Tables that are kept up by batches: buckets, materialised scores, percentiles of all days, compaction."""

import itertools
import json
import os
import threading
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.operators import history
from promolens.operators.merge import merge_by_key
from promolens.operators.scores import DealScores
from promolens.schema import OFFERS, PRICE_HISTORY, align_schema
from promolens.sources.buckets import BucketTable, Conflict
from promolens.sources.tables import Snapshots, append_history, compact_history, open_compacted, read_history
from promolens.streaming.ingest import PAGES, run_ingest_stream

AT = datetime(2026, 5, 16, 12, tzinfo=timezone.utc)
COLUMNS = "k long, title string, price long, first_seen_at timestamp, updated_at timestamp"


def items(spark, keys, title, at=AT):
    return spark.createDataFrame([(k, f"{title} {k}", k * 3, at, None) for k in keys], COLUMNS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_merge_equals_the_whole_table_merge(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", items(spark, [1], "a").schema, ["k"], 8)
    assert table.read().count() == 0
    whole = spark.createDataFrame([], COLUMNS)
    for n, keys in enumerate((range(50), range(40, 70), [5], [])):
        new = items(spark, keys, f"t{n}", AT + timedelta(days=n))
        table.merge(new, ["first_seen_at"], AT + timedelta(days=n), batch=("w", n))
        whole = merge_by_key(whole, new, ["k"], ["first_seen_at"], AT + timedelta(days=n))
        assert rows(table.read()) == rows(whole)
    assert rows(table.read(1)) == rows(merge_by_key(spark.createDataFrame([], COLUMNS), items(spark, range(50), "t0"), ["k"], ["first_seen_at"], AT))


def test_a_small_batch_writes_only_its_buckets(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", items(spark, [1], "a").schema, ["k"], 32)
    table.merge(items(spark, range(3000), "a"))
    before = table.files()

    def size(names):
        return sum(p.stat().st_size for n in names for p in Path(f"{tmp_path}/t/{n}").glob("*.parquet"))

    total = size(before.values())
    for keys in ([7], [7, 8, 9]):
        last = table.files()
        table.merge(items(spark, keys, "b"))
        changed = {b: f for b, f in table.files().items() if last.get(b) != f}
        assert 1 <= len(changed) <= len(keys) and size(changed.values()) < total * len(keys) / 16
        assert set(last.values()) - set(table.files().values()) == {last[b] for b in changed}
    assert table.read().filter("title like 'b %'").count() == 3 and table.read().count() == 3000


def test_replayed_batches_change_nothing(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", items(spark, [1], "a").schema, ["k"], 4)
    first = table.merge(items(spark, [1, 2], "a"), batch=("w", 0))
    second = table.merge(items(spark, [2, 3], "b"), batch=("w", 1))
    files, seen = table.files(), sorted(os.listdir(f"{tmp_path}/t/data"))
    assert table.merge(items(spark, [2, 9], "z"), batch=("w", 1)) == second == table.merge(items(spark, [2, 9], "z"), batch=("w", 0)) == first + 1
    assert table.files() == files and sorted(os.listdir(f"{tmp_path}/t/data")) == seen
    assert table.merge(items(spark, [4], "c"), batch=("other", 0)) == second + 1


def test_writers_that_meet(spark, tmp_path):
    """Another writer commits in the middle of a rewrite: on the same bucket the rows are written again, on another one they are not."""
    path, schema = f"file://{tmp_path}/t", items(spark, [1], "a").schema
    table = BucketTable(spark, path, schema, ["k"], 64)
    table.merge(items(spark, range(10), "a"))
    for other_keys, times in (([1], 2), ([2], 1)):
        calls = []

        def combine(current, new, other_keys=other_keys, calls=calls):
            if not calls:
                BucketTable(spark, path, schema, ["k"]).merge(items(spark, other_keys, "other"))
            calls.append(1)
            return merge_by_key(current, new, ["k"])

        table.rewrite(items(spark, [1], "mine"), combine)
        titles = {r["k"]: r["title"] for r in table.read().collect()}
        assert len(calls) == times and titles[1] == "mine 1" and len(titles) == 10
    assert titles[2] == "other 2"

    def hostile(current, new):
        BucketTable(spark, path, schema, ["k"]).merge(items(spark, [1], "again"))
        return merge_by_key(current, new, ["k"])

    with pytest.raises(Conflict):
        table.rewrite(items(spark, [1], "never"), hostile, tries=2)


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    path, schema, errors = f"file://{tmp_path}/t", items(spark, [1], "a").schema, []

    def write(writer):
        try:
            table = BucketTable(spark, path, schema, ["k"], 4)
            for n in range(3):
                table.merge(items(spark, [100 * writer + n, 7], f"w{writer}"), batch=(f"w{writer}", n))
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(2)]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    table = BucketTable(spark, path, schema, ["k"])
    assert not errors and table.versions() == list(range(1, 7))
    assert sorted(r["k"] for r in table.read().collect()) == sorted([7, *(100 * w + n for w in range(2) for n in range(3))])
    assert table.manifest()["batches"] == {"w0": 2, "w1": 2}


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", items(spark, [1], "a").schema, ["k"], 4)
    for n in range(5):
        table.merge(items(spark, [n], "a"), batch=("w", n))
    assert table.vacuum(keep=2) == [] and table.versions() == [4, 5]
    table.vacuum(keep=1, grace=0)
    assert sorted(os.listdir(f"{tmp_path}/t/data")) == sorted({f.split("/")[1] for f in table.files().values()})
    assert table.read().count() == 5


def test_odd_rows_of_a_bucket_table(spark, tmp_path):
    schema = items(spark, [1], "a").schema
    table = BucketTable(spark, f"file://{tmp_path}/t", schema, ["k"], 4)
    with pytest.raises(ValueError, match="without k"):
        table.merge(items(spark, [1], "a").withColumn("k", F.lit(None).cast("long")))
    with pytest.raises(ValueError, match="bucket"):
        BucketTable(spark, f"file://{tmp_path}/u", spark.range(1).withColumnRenamed("id", "bucket").schema, ["bucket"])
    table.merge(items(spark, [1, 2], "a"))
    table.rewrite(items(spark, [1], "x"), lambda current, new: current.join(new.select("k"), "k", "left_anti"))
    assert [r["k"] for r in table.read().collect()] == [2]
    assert BucketTable(spark, f"file://{tmp_path}/t", schema, ["k"], 999).buckets == 4


# --- scores


def observations(spark, rng, n, first=date(2026, 1, 1), span=160):
    rows = [(f"o{rng.integers(12)}", None if rng.random() < 0.05 else float(rng.integers(1, 40)) / 4, datetime(first.year, first.month, first.day, int(rng.integers(24)), tzinfo=timezone.utc) + timedelta(days=int(rng.integers(span)))) for _ in range(n)]
    return spark.createDataFrame(rows, "external_id string, price double, observed_at timestamp").withColumn("price", F.col("price").cast("decimal(10,2)"))


def score_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::4])
def test_materialised_scores_equal_the_view(spark, tmp_path, order):
    rng = np.random.default_rng(4)
    batches = [observations(spark, rng, 150) for _ in range(3)]
    offers = spark.createDataFrame([(f"o{k}", None if k == 3 else 2.5 + k / 4) for k in range(15)] + [(None, 1.0)], "external_id string, price double").withColumn("price", F.col("price").cast("decimal(10,2)"))
    table = DealScores(spark, f"file://{tmp_path}/s", date(2026, 3, 1), buckets=4)
    everything = batches[0].limit(0)
    for number, (k, at) in enumerate(zip(order, (date(2026, 4, 2), date(2026, 4, 2), date(2026, 5, 20)), strict=True)):
        table.add(batches[k], number)
        table.add(batches[k], number)
        table.advance(at)
        everything = everything.unionByName(batches[k])
        for best in (False, True):
            expected = history.deal_scores(offers, everything, table.instant(), null_price_is_best=best)
            assert score_rows(table.scores(offers, null_price_is_best=best)) == score_rows(expected)
    with pytest.raises(ValueError, match="already"):
        table.advance(date(2026, 1, 1))


def test_only_touched_offers_are_rewritten(spark, tmp_path):
    table = DealScores(spark, f"file://{tmp_path}/s", date(2026, 3, 1), buckets=16)
    table.add(observations(spark, np.random.default_rng(1), 300, date(2026, 2, 1), 20), 0)
    before = table.table.files()
    table.add(spark.createDataFrame([("o3", 1, AT)], "external_id string, price int, observed_at timestamp"), 1)
    assert sum(before.get(b) != f for b, f in table.table.files().items()) == 1
    before = table.table.files()
    table.advance(date(2026, 3, 2))  # no day leaves the window
    assert table.table.files() == before and table.as_of() == date(2026, 3, 2)
    table.advance(date(2027, 3, 2))
    assert table.table.read().count() == 0


def test_scores_without_observations(spark, tmp_path):
    offers = spark.createDataFrame([("a", 1)], "external_id string, price int")
    table = DealScores(spark, f"file://{tmp_path}/s", date(2026, 3, 1))
    table.advance(date(2026, 3, 5))
    assert table.scores(offers).first()["observation_count"] is None
    table.add(offers.limit(0).withColumn("observed_at", F.lit(AT)), 0)
    assert table.scores(offers).first()["price_percentile"] is None


def test_repeated_offers_count_with_their_least_price(spark):
    seen = spark.createDataFrame([("a", x, AT) for x in (1, 2, 3, 4)], "external_id string, price int, observed_at timestamp")
    offers = spark.createDataFrame([("a", 4), ("a", 2)], "external_id string, price int")
    assert {float(r["price_percentile"]) for r in history.deal_scores(offers, seen, AT).collect()} == {50.0}


def test_daily_percentiles_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    seen = observations(spark, rng, 700, date(2025, 12, 20), 420)
    raw = [(r["external_id"], (r["observed_at"].astimezone(timezone.utc)).date(), int(r["price"] * 100)) for r in seen.collect() if r["price"] is not None]
    expected = []
    for key, day in sorted({(k, d) for k, d, _ in raw}):
        price = min(c for k, d, c in raw if (k, d) == (key, day))
        window = [c for k, d, c in raw if k == key and day - timedelta(days=90) <= d <= day]
        below = sum(c <= price for c in window)
        tenths = (2 * below * 1000 + len(window)) // (2 * len(window)) if len(window) >= 3 else None
        expected.append((key, day, price, len(window), tenths))
    got = history.daily_percentiles(seen)
    assert sorted(map(tuple, got.collect())) == expected
    assert history.daily_percentiles(seen.limit(0)).count() == 0


# --- compaction


def test_compacted_history_joins_without_a_shuffle(spark, tmp_path):
    seen = observations(spark, np.random.default_rng(2), 400).withColumn("batch", F.pmod(F.xxhash64("observed_at"), F.lit(3)))
    for b in range(3):
        append_history(align_schema(seen.filter(F.col("batch") == b).drop("batch"), PRICE_HISTORY), f"file://{tmp_path}/h", f"b{b}")
    table = compact_history(spark, f"file://{tmp_path}/h", PRICE_HISTORY, "compacted_test", f"file://{tmp_path}/c", 8)
    assert len(list(Path(f"{tmp_path}/c").glob("*.parquet"))) <= 8
    offers = spark.createDataFrame([(f"o{k}", k) for k in range(12)], "external_id string, price int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = history.deal_scores(offers, table, AT)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("Initial Plan")[-1].splitlines()
        at = next(k for k, x in enumerate(lines) if "compacted_test" in x or "Bucketed: true" in x)
        above = []  # the operators over the history's scan, up to the join
        for x in reversed(lines[:at]):
            above.append(x)
            if "Join" in x:
                break
        assert not any("Exchange" in x for x in above) and "SelectedBucketsCount" in plan
        expected = history.deal_scores(offers, read_history(spark, f"file://{tmp_path}/h", PRICE_HISTORY), AT)
        assert score_rows(scores) == score_rows(expected)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS compacted_test")
    again = open_compacted(spark, PRICE_HISTORY, "compacted_again", f"file://{tmp_path}/c", 8)
    assert again.count() == 400
    spark.sql("DROP TABLE IF EXISTS compacted_again")


# --- ingest


def page(items):
    listing = {"props": {"pageProps": {"pageInformation": {"offers": {"main": {"items": items}}}}}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(listing)}</script>'


def test_ingest_into_buckets_equals_snapshots(spark, tmp_path):
    def item(k, price):
        return {"id": str(k), "type": "OFFER", "title": f"Milch {k}", "brand": "Marke", "publisherName": "Lidl", "prices": {"mainPrice": price}}

    landing = f"file://{tmp_path}/landing"
    tables = {}
    for n, (keys, price, at) in enumerate(((range(40), 1.0, AT), ((3, 41), 2.0, AT + timedelta(days=1)))):
        spark.createDataFrame([(f"u{n}", page([item(k, price) for k in keys]), "milch", 0, at)], PAGES).write.mode("append").parquet(landing)
        for kind, buckets in (("whole", None), ("buckets", 16)):
            paths = (landing, f"file://{tmp_path}/{kind}/offers", f"file://{tmp_path}/{kind}/history", f"file://{tmp_path}/{kind}/check")
            before = set(BucketTable(spark, paths[1], OFFERS, ["external_id"], 16).files().values()) if buckets else set()
            for _ in range(2):
                run_ingest_stream(spark, *paths, "https://offers.example", lambda batch: batch.agg(F.max("scraped_at")).first()[0].astimezone(timezone.utc), buckets).awaitTermination()
            table = BucketTable(spark, paths[1], OFFERS, ["external_id"]) if buckets else Snapshots(spark, paths[1])
            tables[kind] = rows(table.read() if buckets else table.read(OFFERS)), rows(read_history(spark, paths[2], PRICE_HISTORY))
            if before:
                assert 1 <= len(set(table.files().values()) - before) <= 2
        assert tables["whole"] == tables["buckets"]
    assert len(tables["buckets"][0]) == 41 and len(tables["buckets"][1]) == 42


def test_items_of_an_earlier_batch_go_no_further(spark, tmp_path):
    def item(k, price):
        return {"id": str(k), "type": "OFFER", "title": f"Milch {k}", "brand": "Marke", "publisherName": "Lidl", "prices": {"mainPrice": price}}

    landing, base = f"file://{tmp_path}/landing", "https://offers.example"
    paths = (landing, f"file://{tmp_path}/offers", f"file://{tmp_path}/history", f"file://{tmp_path}/check")

    def clock(batch):
        return batch.agg(F.max("scraped_at")).first()[0].astimezone(timezone.utc)

    expected = {}
    for n, (keys, price, hours) in enumerate(((range(4), 1.0, 0), ((2, 3, 4), 2.0, 10), ((2, 4, 5), 3.0, 30))):
        spark.createDataFrame([(f"u{n}", page([item(k, price) for k in keys]), "milch", 0, AT + timedelta(hours=hours))], PAGES).write.mode("append").parquet(landing)
        run_ingest_stream(spark, *paths, base, clock, 8, timedelta(hours=24)).awaitTermination()
        expected |= {0: {"0": 1.0, "1": 1.0, "2": 1.0, "3": 1.0}, 1: {"4": 2.0}, 2: {"2": 3.0, "5": 3.0}}[n]
        got = {r["external_id"]: float(r["price"]) for r in BucketTable(spark, paths[1], OFFERS, ["external_id"]).read().collect()}
        assert got == expected
    assert read_history(spark, paths[2], PRICE_HISTORY).count() == 7
    with pytest.raises(ValueError, match="buckets"):
        run_ingest_stream(spark, *paths, base, clock, None, timedelta(hours=1))


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", items(spark, [1], "a").schema, ["k"], 16)
    table.merge(items(spark, range(100), "a"))
    found = table.lookup(spark.createDataFrame([(5,), (500,)], "k long"))
    assert [r["k"] for r in found.collect()] == [5]
    assert {f.rsplit("/", 2)[1] for f in found.inputFiles()} < {f.rsplit("/", 1)[1] for f in table.files().values()}
