"""Mixing against the oracle's SQL and plain Python."""

import random

import duckdb

from docmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target double"


def rows_of(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "c", "d", None, "é"], [40, 2, 3, 4, 1, 2])[0]
        text = rng.choice([None, "", " \t ", "w " * rng.randint(1, 40), "x\ny z"])
        rows.append((rng.choice([i, i, 7, None]), text, source, "clash", 1.0))
    return rows


def test_equals_sql_with_nulls_ties_and_clashing_columns(spark, tmp_path):
    for seed in range(2):
        docs = spark.createDataFrame(rows_of(seed), SCHEMA)
        docs.write.parquet(f"{tmp_path}/{seed}")
        want = duckdb.sql(mixing.MIX_SQL.format(rows=f"'{tmp_path}/{seed}/*.parquet'"))
        got = mixing.mix(docs).select(*want.columns)
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_budgets(spark):
    docs = spark.createDataFrame(rows_of(3), SCHEMA)
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(taken == int(target) for target, taken in by.values())
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for t, _ in by.values()) - 1.5 * total) < 1e-6 * total


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a", "", 0.0)], SCHEMA)).first()
    assert (got["size"], got["target"], got["taken"]) == (0, 0.0, 0)
