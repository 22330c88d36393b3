"""Vantage-point search against brute force, and its recall where pruning is relaxed."""

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import vector_search as vs


def brute(ids, x, k):
    """For each query's id the results of all its rows, by rank."""
    out = {}
    for n, (i, q) in enumerate(zip(ids, x)):
        if i % 5 == 0:
            scored = sorted((-float(np.cumsum(q * v)[-1]), j) for m, (j, v) in enumerate(zip(ids, x)) if m != n)
            out.setdefault(i, []).extend((r, j) for r, (_, j) in enumerate(scored[:k], 1))
    return {i: sorted(rows) for i, rows in out.items()}


def test_equals_brute_force_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).round(1)
    x[100:400] = x[7]  # a very common vector
    x[np.abs(x).sum(axis=1) == 0] = 1.0
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    odd = [(1000, None, ""), (1005, [0.0] * 8, ""), (1010, [float("nan")] * 8, ""), (1015, [None] * 8, ""), (1020, [1.0], ""), (None, [1.0] * 8, ""), rows[5], rows[5], (6, [9.0] * 8, "")]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, score string")
    want = brute([*range(700), 5, 5, 6], np.vstack([x, x[5], x[5], np.full(8, 9.0)]), 6)
    for shard_rows in (60, 10_000):
        got = {}
        for r in sorted(vs.nearest(df, F.col("vec_id") % 5 == 0, 6, 1.0, shard_rows).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert {i: sorted(rows) for i, rows in got.items()} == want
    mixed = df.union(spark.createDataFrame([(2000, [2.0], ""), (2005, [-1.0], "")], df.schema))  # meet 1020 and each other only
    two = {(r["query_id"], r["vec_id"], r["score"]) for r in vs.nearest(mixed, F.col("vec_id") % 5 == 0, 6, 1.0, 60).collect() if r["query_id"] > 999}
    assert two == {(1020, 2000, 2.0), (1020, 2005, -1.0), (2000, 1020, 2.0), (2000, 2005, -2.0), (2005, 1020, -1.0), (2005, 2000, -2.0)}
    few = vs.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert vs.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_tree_prunes_exactly_and_relaxed():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4)) * rng.uniform(0.5, 2, size=(4000, 1))
    radius = float(np.sqrt((x**2).sum(axis=1).max()))
    extra = np.sqrt(np.maximum(radius**2 - (x**2).sum(axis=1), 0))
    tree, ids = vs.Tree(np.arange(4000), np.arange(4000), x, extra, radius, leaf=32), np.arange(100)
    scores = x[:100] @ x.T
    scores[ids, ids] = -np.inf
    want = [set(r) for r in np.argsort(-scores, axis=1)[:, :10].tolist()]
    for factor, least in ((1.0, 1.0), (0.85, 0.9)):
        q, r, _ = tree.search(ids, x[:100], 10, factor)
        got = [set(r[q == i].tolist()) for i in range(100)]
        assert np.mean([len(a & b) for a, b in zip(got, want)]) / 10 >= least


def test_query_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    got = {}
    for r in vs.op8_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = np.flatnonzero(ids % 20 == 0)
    scores = x[rows] @ x.T
    scores[np.arange(len(rows)), rows] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[ids[q]] & set(ids[w].tolist())) for q, w in zip(rows, want)]) / 20 >= 0.99


def test_rows_of_one_id_are_all_candidates(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (40, [0.0, 1.0]), (40, [0.0, 2.0])]
    got = {tuple(r) for r in vs.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).collect()}
    assert {r for r in got if r[0] == 20} == {(20, 1, 1, 5.0), (20, 2, 2, 2.0), (20, 3, 1, 1.0)}
    assert {r for r in got if r[0] == 40 and r[1] == 1} == {(40, 1, 40, 2.0)}
