"""Resharding (operator 12): a minimum-cost flow from old shard sizes to new capacities, then only affected files anew.

Old shards are the flow's sources and send what they hold; new ones are its sinks and take what their capacity allows.
A byte that stays in its shard costs nothing, one that moves costs one, by way of a hub that all shards share, so the
network has three arcs for each shard and not one for each pair. Its cheapest flow, by successive shortest paths, moves
the fewest bytes that any layout of these capacities needs. Only sizes of shards come to the driver.

What a shard sends to another is a block: rows side by side in a random but fixed order (so that what moves is like
what stays), cut by running sums over ranges of that order, which are many tasks whatever a shard's size. Rows are
whole, so a block may be off by half a row. A second flow settles that: it goes from the sizes reached to the same
capacities, and takes the smallest rows.

``rewrite`` does it to a stored table: shards that neither give nor get keep their files; the others are written anew
and published together, in one version.

The query's law is ``bytes``: sizes of shards are near equal. Equal texts are groups, but this law can't keep those
together, as one group may be larger than a shard.

Defined cases: null is the text without bytes, its checksum that of the empty text; repeated rows and null ids are rows
of their own, each with its slot; ties go by a number that each row gets when it is first read; an empty table gives an
empty result; a single row that is larger than a shard's capacity makes its shard as much larger; capacities of less
than all rows are an error; other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import written
from docmill.llm.mixing import running_sums
from docmill.session import checkpointed
from docmill.sources.store import Change, Store

SHARDS = 16
#: Shards that the query's documents come from.
OLD_SHARDS = 12


class Flow:
    """A network of arcs with capacities and costs; arc a and its way back, a ^ 1, share what is left."""

    def __init__(self, nodes: int):
        self.ends: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.of: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for end, start, left, price in ((b, a, capacity, cost), (a, b, 0, -cost)):
            self.of[start].append(len(self.ends))
            self.ends.append(end)
            self.left.append(left)
            self.cost.append(price)
        return len(self.ends) - 2

    def run(self, source: int, sink: int) -> int:
        """Sends all that goes from ``source`` to ``sink`` at the least cost; gives how much. Costs are not negative."""
        level, sent = [0] * len(self.of), 0
        while True:
            away, by = [float("inf")] * len(self.of), [-1] * len(self.of)
            away[source], heap = 0, [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > away[a]:
                    continue
                for x in self.of[a]:
                    b = self.ends[x]
                    if self.left[x] and (e := d + self.cost[x] + level[a] - level[b]) < away[b]:
                        away[b], by[b] = e, x
                        heapq.heappush(heap, (e, b))
            if by[sink] < 0:
                return sent
            level = [h + d if d < float("inf") else h for h, d in zip(level, away)]
            path, b = [], sink
            while b != source:
                path.append(by[b])
                b = self.ends[by[b] ^ 1]
            amount = min(self.left[x] for x in path)
            for x in path:
                self.left[x] -= amount
                self.left[x ^ 1] += amount
            sent += amount


def block_transfers(sizes: dict[int, int], capacities: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard what it sends, as (new shard, bytes), by number; what stays is the last."""
    old, new = sorted(sizes), sorted(capacities)
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the new shards can't hold all rows")
    net = Flow(len(old) + len(new) + 3)
    source, sink, hub = len(old) + len(new), len(old) + len(new) + 1, len(old) + len(new) + 2
    at = {s: len(old) + j for j, s in enumerate(new)}
    stays, gives, gets = {}, {}, {}
    for i, s in enumerate(old):
        net.arc(source, i, sizes[s])
        if s in at:
            stays[s] = net.arc(i, at[s], sizes[s])
        gives[s] = net.arc(i, hub, sizes[s], 1)
    for s in new:
        gets[s] = net.arc(hub, at[s], capacities[s])
        net.arc(at[s], sink, capacities[s])
    net.run(source, sink)
    used = lambda arc: net.left[arc ^ 1]
    out: dict[int, list[tuple[int, int]]] = {}
    open_ = [[s, used(gets[s])] for s in new if used(gets[s])]
    for s in old:
        rest, out[s] = used(gives[s]), []
        while rest:
            to, room = open_[-1]
            amount = min(rest, room)
            out[s].append((to, amount))
            rest -= amount
            open_[-1][1] -= amount
            if not open_[-1][1]:
                open_.pop()
        out[s].sort()
        if s in stays and used(stays[s]):
            out[s].append((s, used(stays[s])))
    return out


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {i: total // shards + (i < total % shards) for i in range(shards)}


def dealt(rows: DataFrame, capacities: dict[int, int], order: list[Column]) -> DataFrame:
    """``rows`` (shard, size and what ``order`` needs) with new shards; what a shard sends is what comes first in order."""
    sizes = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum("size")).collect()}  # a row for each shard
    blocks = block_transfers(sizes, capacities)
    giving = [s for s in sorted(sizes) if any(to != s for to, _ in blocks[s])]
    if not giving:
        return rows
    cuts, start = [], 0
    for s in giving:
        ends, end = [], start
        for _, amount in blocks[s]:
            ends.append(end := end + amount)
        cuts.append((s, ends, [to for to, _ in blocks[s]]))
        start += sizes[s]
    told = rows.sparkSession.createDataFrame(cuts, "shard int, _ends array<bigint>, _to array<int>")
    placed = running_sums(rows.filter(F.col("shard").isin(giving)), [F.col("shard"), *order], {"size": "_before"}, "_at")
    passed = F.size(F.filter("_ends", lambda e: 2 * e <= 2 * F.col("_before") + F.col("size")))  # by the row's middle
    to = F.element_at("_to", F.least(passed + 1, F.size("_to")))
    moved = placed.join(F.broadcast(told), "shard").withColumn("shard", to).select(*rows.columns)
    return rows.filter(~F.col("shard").isin(giving)).union(moved)


def resharded(rows: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """``rows`` (old, size and any columns that are one row's own in ``row``) with their new shard and slot."""
    key = F.xxhash64("row").alias("_key")
    first = checkpointed(dealt(rows.withColumns({"_key": key, "shard": F.col("old")}), capacities, [F.col("_key"), F.col("row")]))
    last = checkpointed(dealt(first, capacities, [F.col("size"), F.col("_key"), F.col("row")]))
    counts = sorted(tuple(r) for r in last.groupBy("shard").count().collect())
    starts, at = [], 0
    for shard, count in counts:
        starts.append((shard, at))
        at += count
    told = rows.sparkSession.createDataFrame(starts, "shard int, _start bigint")
    numbered = running_sums(last, [F.col("shard"), F.col("_key"), F.col("row")], {}, "_at")
    slot = (F.col("_at") - F.col("_start")).cast("long")
    return numbered.join(F.broadcast(told), "shard").select(*rows.columns, "shard", slot.alias("slot"))


def rewrite(store: Store, table: str, capacities: dict[int, int], size: Column) -> DataFrame:
    """Reshards a stored table (with columns shard, which its layout has as the bucket, and slot, gapless from 0 in each)
    and gives the transfers (old, shard, rows, bytes). Shards without any keep their files and slots."""
    told: list[tuple] = []

    def work(change: Change) -> None:
        before = change.read(table).select(F.col("shard").alias("old"), F.struct("shard", "slot").alias("row"), size.cast("long").alias("size"))
        after = checkpointed(resharded(before, capacities))
        moved = after.filter("old <> shard").groupBy("old", "shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        told.extend(tuple(r) for r in moved.orderBy("old", "shard").collect())  # fewer than two for each shard and flow
        if affected := {s for old, new, *_ in told for s in (old, new)}:
            rows = change.read(table, affected)
            names = [f.name for f in rows.schema if f.name not in ("shard", "slot")]
            places = after.select(F.col("row.shard").alias("_old"), F.col("row.slot").alias("_slot"), F.col("shard").alias("_shard"), F.col("slot").alias("_new"))
            rows = rows.join(places, (rows["shard"] == places["_old"]) & (rows["slot"] == places["_slot"]))
            change.rewrite(table, rows.select(*names, F.col("_shard").alias("shard"), F.col("_new").alias("slot")), affected)

    store.change(work)
    return store.spark.createDataFrame(told, "old int, shard int, rows bigint, bytes bigint")


def text_bytes(text: str = "text") -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def op12_resharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (text_bytes() + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int").alias("old"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "sizes")  # so that a row's number is settled
    total = rows.agg(F.sum("size")).first()[0] or 0
    found = resharded(rows, equal_capacities(total, SHARDS))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
