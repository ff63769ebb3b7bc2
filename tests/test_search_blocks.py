"""Searches by matrix products of parts against the join of all pairs."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from promolens.operators import search_blocks
from promolens.operators.search import nearest, scored_pairs
from promolens.plans import queries as plans

OFFERS = "id long, embedding array<double>, category string, price decimal(10,2), is_active boolean, store string, discount_percent decimal(5,1)"
QUERIES = "query_id long, vector array<double>, cutoff double, max_price decimal(12,3), category string, stores array<string>, min_discount double"
NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0, 0.0, 0.0], [NAN, 1.0, 0.0], [INF, 0.0, 0.0], [None, 1.0, 0.0], [1.0, 2.0], [-3.0, 0.5], [1e-170, 2e-170, 0.0], [1e180, 1e179, 3.0], [2e120, 1e120, 0.0]]


def some(rng, values):
    return rng.choice([None, *values])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(40)] + ODD
    offers = [
        (n if n % 50 else None, rng.choice(vectors), some(rng, ["Eco Wein", "ECO", "Brot"]), some(rng, [Decimal(p) for p in range(5)]), some(rng, [True] * 5), some(rng, ["a", "b", "c"]), some(rng, [Decimal(5), Decimal(30)]))
        for n in range(400)
    ]
    queries = [
        (n if n else None, rng.choice(vectors), some(rng, [0.5, 0.9, -1.0, -INF, NAN]), some(rng, [Decimal("2.000"), Decimal("2.999")]), some(rng, ["eco", "w", ""]), some(rng, [[], ["a"], ["b", None], [None]]), some(rng, [5.0, 29.9, NAN]))
        for n in range(100)
    ]
    return spark.createDataFrame(offers, OFFERS), spark.createDataFrame(queries, QUERIES)


def by_join(queries, offers, k, digits):
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id"))
    rows = scored_pairs(queries, offers, digits).withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("similarity") >= F.col("cutoff"))
    return rows.select("query_id", "id", "similarity", "rank")


@pytest.mark.parametrize(("columns", "k", "digits"), [((), 8, None), ((), 8, 6), (("max_price", "category"), 8, 6), (("max_price", "category", "stores", "min_discount"), 3, 2)])
def test_same_rows_as_the_join(spark, tables, columns, k, digits, monkeypatch):
    monkeypatch.setattr(search_blocks, "OFFERS_PART", 90)
    monkeypatch.setattr(search_blocks, "QUERIES_PART", 40)
    offers, queries = tables
    asked = queries.select("query_id", "vector", "cutoff", *columns)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    got, expected = (sorted(map(tuple, f(asked, offers, k, digits).collect()), key=key) for f in (nearest, by_join))
    assert got == expected and len(got) > 50


def test_no_join_of_all_pairs(tables):
    offers, queries = tables
    plan = nearest(queries, offers)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("digits", [None, 4])
def test_steps_of_a_part(monkeypatch, digits):
    """Many copies and little steps: the ids decide, over all steps."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((12, 5)).round(1)[rng.integers(12, size=300)]
    y = rng.standard_normal((40, 5)).round(1)
    monkeypatch.setattr(search_blocks, "OFFERS_STEP", 20)
    monkeypatch.setattr(search_blocks, "QUERIES_STEP", 7)
    monkeypatch.setattr(search_blocks, "PAIRS_STEP", 11)
    a, b = pa.table({"embedding": x.tolist()}), pa.table({"vector": y.tolist(), "cutoff": [0.1] * 40})
    got = list(zip(*(v.tolist() for v in search_blocks.best_of_parts(a, b, 30, digits)), strict=True))
    xn, yn = np.sqrt(search_blocks._summed(x, x)), np.sqrt(search_blocks._summed(y, y))
    value = search_blocks.round_half_up((search_blocks._summed(x[None], y[:, None]) / (xn[None] * yn[:, None])).ravel(), digits).reshape(40, 300)
    assert got == [(i, j, value[i, j]) for i in range(40) for j in sorted(np.flatnonzero(value[i] >= 0.1).tolist(), key=lambda j: (-value[i, j], j))[:30]]


def test_rounding_is_sparks(spark):
    values = [0.1234565, 0.1234575, -0.1234565, 0.0000005, -0.0000004, 0.9999995, 0.123456499999, 1.0, 0.30000000000000004]
    expected = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert search_blocks.round_half_up(np.array(values), 6).tolist() == expected


def products(df):
    """How often the plan compares offers with queries."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups")


@pytest.mark.parametrize("name", ["source_links", "comparison_rows", "notification_log", "alert_topk", "alert_digests", "touch_alerts", "alert_topk_loose"])
def test_matches_are_computed_once(spark, name):
    """By products, and in no second place of the plan."""
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert products(df) == 1
    assert "NestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_digests_are_computed_once(spark):
    """The job keeps them, as its log and its touched alerts both follow from them."""
    assert products(plans.QUERIES["run_digest"](spark, "/root/testdata/sf0.001")) == 0


@pytest.mark.parametrize("strict", [False, True], ids=["alert_topk_loose", "alert_topk"])
def test_conditions_are_tested_for_few_pairs(monkeypatch, strict):
    """The first product's pairs, then only those that could be among the best."""
    rng = np.random.default_rng(3)
    a = pa.table({"embedding": rng.standard_normal((4096, 16)).tolist(), "price": rng.integers(100, size=4096), "discount_percent": rng.integers(90, size=4096).astype(float), "store": [f"s{n % 4}" for n in range(4096)], "category": ["x"] * 4096})
    b = {"vector": rng.standard_normal((64, 16)).tolist(), "cutoff": [0.1] * 64, "max_price": [70, None] * 32, "category": pa.array([None] * 64, pa.string())}
    b |= {"stores": [["s1", "s2"], None] * 32, "min_discount": [30.0, None] * 32} if strict else {}
    real, asked = search_blocks._conditions, []

    def counted(*tables):
        allowed = real(*tables)
        return lambda i, j: asked.append(np.broadcast(i, j).size) or allowed(i, j)

    monkeypatch.setattr(search_blocks, "_conditions", counted)
    found = search_blocks.best_of_parts(a, pa.table(b), 8, 6)
    assert len(found[0]) == 64 * 8 and sum(asked) < 64 * 1024


@pytest.mark.parametrize("dims", [1, 3, 64, 700])
def test_slack_covers_single_precision(dims):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((300, dims)) * 10.0 ** rng.integers(-3, 3, (300, dims))
    y = np.concatenate([x, -x, x + rng.standard_normal(x.shape) * 1e-6])
    ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    off = np.abs(uy @ ux.T - uy.astype(np.float32) @ ux.astype(np.float32).T).max()
    assert off < search_blocks.slack(dims) / 2


@pytest.mark.parametrize("digits", [None, 6, 9])
def test_cosines_that_single_precision_cannot_tell_apart(digits):
    rng = np.random.default_rng(5)
    x = np.array([1.0, 2.0, -1.0, 0.5, 3.0]) + rng.standard_normal((3000, 5)) * 1e-5
    y = np.array([1.0, 2.0, -1.0, 0.5, 3.0]) + rng.standard_normal((20, 5)) * 0.2
    a, b = pa.table({"embedding": x.tolist()}), pa.table({"vector": y.tolist(), "cutoff": [0.1] * 20})
    got = list(zip(*(v.tolist() for v in search_blocks.best_of_parts(a, b, 8, digits)), strict=True))
    xn, yn = np.sqrt(search_blocks._summed(x, x)), np.sqrt(search_blocks._summed(y, y))
    value = search_blocks.round_half_up((search_blocks._summed(x[None], y[:, None]) / (xn[None] * yn[:, None])).ravel(), digits).reshape(20, 3000)
    assert got == [(i, j, value[i, j]) for i in range(20) for j in sorted(range(3000), key=lambda j: (-value[i, j], j))[:8]]


def test_copies_are_not_all_compared_again(monkeypatch):
    """Copies with larger ids are no better than the k held, though a product in single precision can't tell."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((1, 24)), 8192, axis=0)
    y = x[:64] + rng.standard_normal((64, 24)) * 0.1
    real, compared = search_blocks._paired, []
    monkeypatch.setattr(search_blocks, "_paired", lambda a, b, j, i: compared.append(len(j)) or real(a, b, j, i))
    i, j, _ = search_blocks.best_of_parts(pa.table({"embedding": x.tolist()}), pa.table({"vector": y.tolist(), "cutoff": [0.1] * 64}), 8, 6)
    assert j.tolist() == list(range(8)) * 64 and i.tolist() == [n for n in range(64) for _ in range(8)]
    assert sum(compared) <= 2 * 64 * search_blocks.FIRST_STEP


@pytest.mark.parametrize("name", ["alert_topk_loose", "touch_alerts", "alert_digests", "alert_topk", "notification_log"])
def test_same_rows_from_many_parts(spark, name, monkeypatch):
    key = lambda r: tuple(map(str, r))
    whole = sorted(map(tuple, plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=key)
    monkeypatch.setattr(search_blocks, "OFFERS_PART", 30)
    monkeypatch.setattr(search_blocks, "QUERIES_PART", 10)
    assert sorted(map(tuple, plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=key) == whole and whole
