"""Calibration of the gate and evaluation reports over samples (grp, vec, kw)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.session import checkpointed

#: Candidates of a grid for each channel.
GRID = 61


def accumulated(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``_before_<c>`` for each of ``sums``: its sum over all rows before, in order of ``by``. Ranges of the
    order are summed apart; one row for each of them comes together."""
    ranged = checkpointed(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = lambda *part: Window.partitionBy(*part).orderBy(*(by if part else ["_range"])).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    starts = starts.select("_range", *[total(c, before()).alias(f"_start_{c}") for c in sums])
    placed = ranged.join(F.broadcast(starts), "_range")
    return placed.select(*rows.columns, *[(F.col(f"_start_{c}") + total(c, before("_range"))).alias(f"_before_{c}") for c in sums])


def summary(samples: DataFrame, value: str) -> DataFrame:
    """(grp, n, least, p25, mid, most): p25 at place (n + 1) / 4, between neighbours.

    Values are counted before they move, and their places are running sums over ranges of values, so that a group of any
    size is many tasks' work.
    """
    counts = samples.filter(F.col(value).isNotNull()).groupBy("grp", F.col(value).alias("v")).agg(F.count("*").alias("k"))
    counts = accumulated(counts, ["grp", "v"], ["k"])
    whole = counts.groupBy("grp").agg(F.sum("k").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.min("_before_k").alias("_start"))
    rows = counts.join(F.broadcast(whole), "grp")  # a row for each group
    n, before = F.col("n").cast("double"), F.col("_before_k") - F.col("_start")

    def at(place: Column) -> Column:
        """The part that a value has in what lies at a place from 1."""
        has = lambda i: (i > before) & (i <= before + F.col("k"))
        part = place - F.floor(place)
        return F.col("v") * (F.when(has(F.floor(place)), 1 - part).otherwise(0.0) + F.when(has(F.floor(place) + 1), part).otherwise(0.0))

    quarter = F.greatest(F.lit(1.0), F.least(n, (n + 1) / 4))
    out = rows.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("n", "least", "most")], F.sum(at(quarter)).alias("p25"), F.sum(at((n + 1) / 2)).alias("mid"))
    groups = samples.select("grp").distinct()  # those without values too
    return groups.join(out, groups["grp"].eqNullSafe(out["grp"]), "left").select(groups["grp"], F.coalesce("n", F.lit(0)).alias("n"), "least", "p25", "mid", "most")


def threshold(samples: DataFrame, value: str, step: float = 0.01) -> DataFrame:
    """(threshold, errors): of evenly spaced thresholds the first with the fewest samples on the wrong side.

    Samples have grp 'pos' or 'neg'; with either side empty it is (0, -1). Counting needs no pair of sample and
    threshold: a sample falls in the step it lies in, and errors are running sums over the steps.
    """
    spark = samples.sparkSession
    low, high, pos, neg = samples.agg(F.min(value), F.max(value), F.count_if(F.col("grp") == "pos"), F.count_if(F.col("grp") == "neg")).first()
    if not pos or not neg:
        return spark.createDataFrame([(0.0, -1)], "threshold double, errors long")
    steps = max(2, int((high - low) / step) + 1)
    edge = lambda i: F.lit(low) + F.lit(high - low) * i / F.lit(steps)
    # the number of thresholds that a sample reaches
    reached = F.least(F.lit(steps + 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / ((high - low) / steps or 1.0)).cast("int") + 1))
    reached = reached + F.when((reached <= steps) & (edge(reached) <= F.col(value)), 1).when(edge(reached - 1) > F.col(value), -1).otherwise(0)
    by = samples.groupBy(reached.alias("i")).agg(F.count_if(F.col("grp") == "pos").alias("p"), F.count_if(F.col("grp") == "neg").alias("q"))
    # errors only change at steps that hold samples, so those and the first are all there is to compare
    by = by.unionByName(spark.createDataFrame([(0, 0, 0)], "i int, p long, q long")).groupBy("i").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    summed = accumulated(by, ["i"], ["p", "q"])
    missed = summed.select("i", (F.col("_before_p") + F.col("p")).alias("fn"), (F.lit(neg) - F.col("_before_q") - F.col("q")).alias("fp")).filter(F.col("i") <= steps)
    best = missed.withColumn("errors", F.col("fn") + F.col("fp")).orderBy("errors", "i").limit(1)
    return best.select(F.round(edge(F.col("i")), 3).alias("threshold"), F.col("errors").cast("long").alias("errors"))


def candidates(low: float, high: float, pad: float = 0.05) -> list[float]:
    a, b = low - pad, high + pad
    return [round(a + (b - a) * i / (GRID - 1), 4) for i in range(GRID)]


def pair_of_thresholds(samples: DataFrame) -> DataFrame:
    """(vec_min, kw_min, errors): of a grid of gates "vec or kw reaches its threshold" the one with the fewest errors,
    then with the widest margin to any sample, then the first; (0, 0, -1) with either side empty."""
    spark = samples.sparkSession
    v0, v1, k0, k1, pos, neg = samples.agg(F.min("vec"), F.max("vec"), F.min("kw"), F.max("kw"), F.count_if(F.col("grp") == "pos"), F.count_if(F.col("grp") == "neg")).first()
    if not pos or not neg:
        return spark.createDataFrame([(0.0, 0.0, -1)], "vec_min double, kw_min double, errors long")
    vs, ks = candidates(v0, v1), candidates(k0, k1)
    # each sample says how many thresholds it reaches: 62 x 62 cells hold all there is to count
    reach = lambda c, ts: sum((F.col(c) >= t).cast("int") for t in ts)
    edges = [f(c).alias(f"{n}_{c}") for c in ("vec", "kw") for n, f in (("low", F.min), ("high", F.max))]
    cells = samples.groupBy(reach("vec", vs).alias("a"), reach("kw", ks).alias("b"))
    cells = cells.agg(F.count_if(F.col("grp") == "pos").alias("p"), F.count_if(F.col("grp") == "neg").alias("q"), *edges).collect()  # one row for each cell
    held = np.zeros((2, GRID + 1, GRID + 1), np.int64)
    for r in cells:
        if r["a"] is not None and r["b"] is not None:
            held[:, r["a"], r["b"]] = r["p"], r["q"]
    # a gate (i, j) stops the samples that reach neither: sums of cells up to it
    stopped = held.cumsum(axis=1).cumsum(axis=2)[:, :GRID, :GRID]
    errors = stopped[0] + held[1].sum() - stopped[1]

    def nearest(at: str, c: str, ts: list[float]) -> np.ndarray:
        """How near the samples of either side come to each threshold."""
        low, high = np.full(GRID + 1, np.inf), np.full(GRID + 1, -np.inf)
        for r in cells:
            if r[at] is not None:
                low[r[at]], high[r[at]] = min(low[r[at]], r[f"low_{c}"]), max(high[r[at]], r[f"high_{c}"])
        below, above = np.maximum.accumulate(high)[:GRID], np.minimum.accumulate(low[::-1])[::-1][1:]
        return np.minimum(np.array(ts) - below, above - np.array(ts))

    margin = np.minimum(nearest("a", "vec", vs)[:, None], nearest("b", "kw", ks)[None, :])
    i, j = min(np.ndindex(GRID, GRID), key=lambda g: (errors[g], -margin[g], g))
    return spark.createDataFrame([(vs[i], ks[j], int(errors[i, j]))], "vec_min double, kw_min double, errors long")


def pass_report(results: DataFrame) -> DataFrame:
    """(grp, passed, total) of (grp, ok), with a row over all (grp null)."""
    return results.rollup("grp").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def outcome(answer: Column) -> Column:
    """What an answer is: a guide, a refusal or direct, by what it says."""
    return F.when(F.contains(answer, F.lit("请确认")), F.lit("guide")).when(F.contains(answer, F.lit("未找到")) | F.contains(answer, F.lit("暂未收录")), F.lit("refusal")).otherwise(F.lit("direct"))


def mix(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share) of each value."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select(by, "n", F.round(100 * F.col("n") / F.lit(total), 4).alias("share"))
