"""Approximate nearest neighbours (operator 8): a vantage-point tree for each shard, searched by blocks of queries.

Vectors go to shards by a hash of their row's number, so that a shard is bounded whatever the input looks like, and
every query goes to every shard. A task builds a shard's tree, then streams the queries through it. The largest inner product is
the smallest distance once each vector has one more component that brings it to the largest norm of all. A node keeps
the least and the largest distance of either child from its vantage point; by the triangle inequality a child whose
lower bound is over the distance of the query's worst neighbour so far can't matter. ``factor`` relaxes that: children
whose bound is over factor times that distance are passed over, so one is exact and less is faster.

Defined cases: vectors that are null, zero or that hold null or non-finite components take no part, nor do rows without
an id; vectors of different lengths have no inner product, so each length has shards of its own; rows with one id, and
repeated rows, are candidates and queries of their own, only a query's own row is none of its candidates; equal scores
go to the smaller id; fewer candidates than asked for give fewer rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
SHARD = 8192
BLOCK = 1024
FACTOR = 1.0


class Tree:
    """A vantage-point tree over the rows of ``points``, which are of one length each once ``extra`` is added."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, extra: np.ndarray, radius: float, leaf: int = LEAF):
        self.ids, self.rows, self.points, self.radius = ids, rows, points, radius
        self.whole = np.column_stack([points, extra])
        self.rng = np.random.default_rng(0)
        self.root = self.build(np.arange(len(ids)), leaf)

    def build(self, rows: np.ndarray, leaf: int):
        """A leaf is an array of rows; a node is (vantage row, [(child, least, largest distance) twice])."""
        if len(rows) <= leaf:
            return rows
        vantage = int(rows[self.rng.integers(len(rows))])
        away = np.sqrt(np.maximum(((self.whole[rows] - self.whole[vantage]) ** 2).sum(axis=1), 0))
        inner = away <= np.median(away)
        if inner.all():
            inner = away < away.max()
        if not inner.any():  # all of them at one distance
            return rows
        return vantage, [(self.build(rows[m], leaf), away[m].min(), away[m].max()) for m in (inner, ~inner)]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, row of the tree, score) of the ``k`` best for each query, but its ``own`` row."""
        lengths = np.linalg.norm(queries, axis=1)
        scaled = queries * (self.radius / lengths)[:, None]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        worst = np.full(len(queries), -np.inf)  # k-th best score so far

        def meet(rows: np.ndarray, qs: np.ndarray) -> None:
            nonlocal best
            near = queries[qs] @ self.points[rows].T >= (worst[qs] - 1e-9 * self.radius * lengths[qs])[:, None]
            near &= own[qs][:, None] != self.rows[rows][None, :]
            a, b = np.nonzero(near)
            if not len(a):
                return
            q, r = qs[a], rows[b]
            score = np.multiply(queries[q].T, self.points[r].T, order="C").sum(axis=0)  # component by component, in order
            touched = np.zeros(len(queries), bool)
            touched[q] = True
            old = touched[best[0]]
            q, r, score = (np.concatenate([x[old], y]) for x, y in zip(best, (q, r, score)))
            order = np.lexsort((self.ids[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            kth = rank == k - 1
            worst[q[kth]] = score[kth]
            keep = rank < k
            best = tuple(np.concatenate([x[~old], y[keep]]) for x, y in zip(best, (q, r, score)))

        def walk(node, qs: np.ndarray) -> None:
            if not isinstance(node, tuple):
                meet(node, qs)
                return
            vantage, children = node
            away = self.radius**2 * 2 - 2 * (scaled[qs] @ self.points[vantage])
            away = np.sqrt(np.maximum(away, 0))
            bounds = [np.maximum(np.maximum(away - high, low - away), 0) for _, low, high in children]
            middle = (children[0][2] + children[1][1]) / 2
            for first in (0, 1):  # each query goes to the nearer child first
                mine = (away <= middle) == (first == 0)
                for c in (first, 1 - first):
                    reach = np.sqrt(np.maximum(2 * self.radius**2 - 2 * self.radius / lengths[qs] * np.where(np.isfinite(worst[qs]), worst[qs], -np.inf), 0))
                    if len(go := qs[mine & (bounds[c] <= factor * reach * (1 + 1e-12) + 1e-9 * (factor >= 1))]):
                        walk(children[c][0], go)

        walk(self.root, np.arange(len(queries)))
        return best


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding as doubles): the vectors that take part, each with a number of its row."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("embedding"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates by inner product for each row that ``is_query``."""
    rows = clean_vectors(vectors)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, most = rows.agg(F.count("*"), F.max(square)).first()
    shards, radius = max(1, math.ceil(n / shard_rows)), math.sqrt(most or 1.0)
    shard = lambda i: F.size("embedding") * F.lit(shards).cast("long") + i  # noqa: E731 - of vectors of one length
    role = lambda i, asks: F.struct(shard(i).alias("shard"), F.lit(asks).alias("query"))
    own = F.array(role(F.pmod(F.xxhash64("row"), F.lit(shards)), False))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda i: role(i, True))
    roles = F.when(F.coalesce(is_query, F.lit(False)), F.concat(own, every)).otherwise(own)
    dealt = rows.select("row", "vec_id", "embedding", F.explode(roles).alias("role"))  # a row's number is made once for all its roles
    dealt = dealt.select("role.shard", "role.query", "row", "vec_id", "embedding").repartition("shard").sortWithinPartitions("shard", "query", "vec_id")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, shard, held = None, None, []
        for f in frames:
            keys = f["shard"].to_numpy()
            for s in pd.unique(keys):
                of_shard = f[keys == s]
                if s != shard:
                    tree, shard, held = None, s, []
                held += [x for x in (of_shard[~of_shard["query"]],) if len(x)]
                asks = of_shard[of_shard["query"]]
                if not len(asks) or not (held or tree):
                    continue
                if tree is None:  # a shard's candidates all come before its queries
                    points = np.stack([*pd.concat(held)["embedding"]]).astype(float)
                    extra = np.sqrt(np.maximum(radius**2 - (points**2).sum(axis=1), 0))
                    found = pd.concat(held)
                    tree, held = Tree(found["vec_id"].to_numpy(), found["row"].to_numpy(), points, extra, radius), []
                for at in range(0, len(asks), BLOCK):
                    block = asks.iloc[at : at + BLOCK]
                    ids, own = block["vec_id"].to_numpy(), block["row"].to_numpy()
                    q, r, score = tree.search(own, np.stack([*block["embedding"]]).astype(float), k, factor)
                    yield pd.DataFrame({"row": own[q], "query_id": ids[q], "vec_id": tree.ids[r], "score": score})

    found = dealt.mapInPandas(search, "row long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


NEAREST_SQL = """
WITH fine AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND c.row <> q.row AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
