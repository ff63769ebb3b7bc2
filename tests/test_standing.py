"""Standing alerts in state against the batch match at every trigger."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.operators.alerts import match_alerts
from promolens.streaming.digests import best_offers, standing_matches, still_useful

DAY0 = datetime(2026, 5, 1, tzinfo=timezone.utc)
OFFERS = "id long, price double, discount_percent double, store string, category string, is_active boolean, scraped_at timestamp, embedding array<double>"
ALERTS = "id long, query_embedding array<double>, similarity_threshold double, max_price double, is_active boolean, stores array<string>, min_discount double, categories array<string>"


def test_pruned_state_gives_the_same_lists():
    """Random offers come and leave: the best of what is kept are the best of all."""
    rng = np.random.default_rng(6)
    for k in (1, 2, 5):
        everything, held = {}, {}
        for at in range(120):
            i = int(rng.integers(60))
            everything[i, at] = held[i, at] = float(rng.integers(8))
            since = at - 20
            everything, held = ({j: v for j, v in x.items() if j[1] >= since} for x in (everything, held))
            held = still_useful(held, k)
            for later in range(since, at + 1, 5):
                best = [best_offers({j: v for j, v in x.items() if j[1] >= later}, k) for x in (everything, held)]
                assert best[0] == best[1]
    assert len(still_useful({(j, j): float(j % 97) for j in range(5000)}, 8)) < 800


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stream_equals_batch_at_each_trigger(rocks, tmp_path):
    spark, rng = rocks, np.random.default_rng(3)
    vectors = rng.standard_normal((6, 4))
    alerts = spark.createDataFrame([(k, v.tolist(), 0.2, 60.0 if k % 2 else None, k != 5, None, None, None) for k, v in enumerate(vectors)], ALERTS)
    batches = []
    for n, day in enumerate((0, 2, 4, 6, 9, 10, 30)):
        ids = range(8 * n, 8 * n + 8) if n < 6 else [900]
        rows = [(i, float(rng.integers(20, 90)), None, "Lidl", "x", True, DAY0 + timedelta(days=day, hours=int(rng.integers(20))), rng.standard_normal(4).tolist()) for i in ids]
        batches.append(rows)
    out, state = {}, {"seen": [], "new": []}

    def step(df, number):
        rows = df.collect()
        for alert in {r["alert_id"] for r in rows}:
            out[alert] = sorted((r["rank"], r["id"], r["similarity"]) for r in rows if r["alert_id"] == alert and r["rank"])
            state["new"] += [(alert, r["id"]) for r in rows if r["alert_id"] == alert and r["is_new"]]
        state["seen"].append({k: v for k, v in out.items() if v})

    for n in range(len(batches)):  # one batch a run, from the same checkpoint: restarts keep the state
        spark.createDataFrame(batches[n], OFFERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(OFFERS).parquet(f"{tmp_path}/in")
        query = standing_matches(stream, alerts, 7, 3, digits=6).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        rows = [r for b in batches[: n + 1] for r in b]
        mark = max(r[6] for r in rows)  # a run ends with a trigger that has the watermark of all its rows
        expected = {}
        for r in match_alerts(alerts, spark.createDataFrame(rows, OFFERS), mark, 7, 3, digits=6).collect():
            expected.setdefault(r["alert_id"], []).append((r["rank"], r["id"], r["similarity"]))
        assert {k: sorted(v) for k, v in expected.items()} == state["seen"][-1]
    assert len(state["new"]) == len(set(state["new"])) and len(state["new"]) > 12
