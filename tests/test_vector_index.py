"""The stored vector index against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.operators import vector_index
from promolens.operators.vector_index import VectorIndex

SF = "/root/testdata/sf0.01/embeddings.parquet"


def clustered(n, dim=16, clusters=12, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return centres[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dim))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")


def brute(ids, x, q_ids, q, k, cutoff, digits=6):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    value = np.round(unit(q) @ unit(x).T, digits)
    out = []
    for n, row in zip(q_ids, value, strict=True):
        best = sorted((-s, i) for i, s in zip(ids, row, strict=True) if s >= cutoff)[:k]
        out += [(n, i, r + 1) for r, (_, i) in enumerate(best)]
    return sorted(out)


def queries(spark, q):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, vector array<double>")


def found(df):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("part", [7, 4096])
def test_bound_gives_exact_results(spark, tmp_path, part, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", part)
    x, q = clustered(500), clustered(40, seed=1)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.fit(frame(spark, x), lists=12)
    index.insert(frame(spark, x[:300]), "b0")
    ids = range(500)
    assert found(index.search(queries(spark, q), 5, 0.7, digits=6)) == brute(ids[:300], x[:300], range(40), q, 5, 0.7)
    index.insert(frame(spark, x[300:], 300), "b1")  # increments widen the radii
    index.insert(frame(spark, x[300:], 300), "b1")
    for cutoff in (0.95, 0.3, -1.0):
        assert found(index.search(queries(spark, q), 5, cutoff, digits=6)) == brute(ids, x, range(40), q, 5, cutoff)


def test_files_follow_the_probes(spark, tmp_path):
    x = clustered(600, spread=0.05)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.fit(frame(spark, x), lists=12)
    index.insert(frame(spark, x), "b0")
    read = []
    members = index._members
    index._members = lambda lists=None: read.append(lists) or members(lists)
    one = index.search(queries(spark, x[:1]), 3, 0.95, digits=6)
    assert found(one) == brute(range(600), x, [0], x[:1], 3, 0.95)
    assert len(read[-1]) <= 3 and all(f"list={k}/" in f for f in members(read[-1]).inputFiles() for k in [f.split("list=")[1].split("/")[0]])
    assert len(members(read[-1]).inputFiles()) < len(members().inputFiles()) / 2
    index.search(queries(spark, x[:50]), 3, -1.0, probes=1).count()
    assert len(read[-1]) <= 12


@pytest.mark.skipif(not os.path.exists(SF), reason="no given tables")
def test_recall_of_probes_on_the_given_vectors(spark, tmp_path):
    """Ids divisible by 20 against all, by a tenth of the lists."""
    rows = spark.read.parquet(SF).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    all_ = rows.collect()
    ids, x = [r["id"] for r in all_], np.array([r["embedding"] for r in all_])
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.fit(rows)
    index.insert(rows, "b0")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    chosen = [k for k, i in enumerate(ids) if i % 20 == 0]
    expected = {(a, b) for a, b, _ in brute(ids, x, [ids[k] for k in chosen], x[chosen], 8, 0.6)}
    lists = len(index.centroids())
    got = {(r["query_id"], r["id"]) for r in index.search(asked, 8, 0.6, probes=max(2, lists // 5), digits=6).collect()}
    assert lists >= 10 and len(got & expected) / len(expected) >= 0.95


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 0.0]), (6, [None, 1.0]), (7, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(ValueError, match="no vector"):
        index.fit(df.filter("id = 3"))
    index.fit(df.filter("id is not null"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 0.0])], "query_id long, vector array<double>")
    assert found(index.search(asked)) == []
    index.insert(df, "b0")
    assert found(index.search(asked)) == [(1, 1, 1), (1, 7, 2)]
    assert found(index.search(asked.limit(0))) == []


def test_sample_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "MAX_SAMPLE", 30)
    monkeypatch.setattr(vector_index, "MAX_CENTROID_BYTES", 16 * 8 * 5)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.fit(frame(spark, clustered(400)))
    assert index.centroids().shape == (5, 16)
