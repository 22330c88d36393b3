"""SimHash near-duplicates (operator 9): a binary trie joined with itself under a Hamming error budget.

Documents with one fingerprint become one node first, so a group of copies, of any size, is a single row. Fingerprints
that differ in three bits or fewer agree in one of four blocks of 16 bits; each goes, once for each block, to the task
of that block's value, rotated so that the block comes first. There the fingerprints, in order, are a binary trie.
Pairs of its nodes are walked down together from the shared block on; the bits in which a pair's paths differ add up,
and a pair over the budget is dropped with all below it. A block value with very many fingerprints is dealt out once
more, by four quarters of its other 48 bits, of which again one must agree. Tasks return trees of links, never all
pairs, and the links' components are found with joins.

Defined cases: null is the empty text, which has fingerprint 0 and is linked like any other; null ids never become
component ids unless a component has no other; every row of the input gives a row, repeated rows too, with its id as
it is; other columns of the input are not looked at; whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import derived
from docmill.llm.components import components
from docmill.session import checkpointed

BUDGET = 3
#: Fingerprints of one block value from which on it is dealt out once more.
CROWDED = 20_000
#: For each byte, its eight bits as the eight bytes of a long: adding up to 255 such longs counts bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: str) -> list[int]:
    """XXH64 (seed 42) of the 3-word shingles of ``text``, repeats included; A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters, ASCII white space
    hashed = xxhash.xxh64_intdigest
    if len(words) < 3:
        return [hashed(b" ".join(words), 42)] if words else []
    spaced = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    return [hashed(spaced[a:b], 42) for a, b in zip([0, *ends[:-3].tolist()], (ends[2:] - 1).tolist())]


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles' hashes."""
    hashes = [shingle_hashes(x) for x in texts]
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([np.array(hashes[i], np.uint64) for i in full]).view(np.uint8).reshape(-1, 8)
    runs = -(-sizes[full] // 255)
    first = np.cumsum(sizes[full]) - sizes[full]
    inner = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(first, runs) + 255 * inner
    sums = np.stack([np.add.reduceat(LANES[flat[:, k]], starts) for k in range(8)], axis=1)  # run, byte
    counts = np.add.reduceat(sums.view(np.uint8).astype(np.int64), np.cumsum(runs) - runs, axis=0)
    out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed long."""

    return derived(docs.select("doc_id", "text"), "fp long", lambda: lambda texts: [fingerprints_of(texts).view(np.int64)])


def trie_links(values: np.ndarray, starts: np.ndarray, depth: int, budget: int, most: int = 1 << 20, folded: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``values`` that differ in ``budget`` bits or fewer, for groups that begin at ``starts``.

    Each group's values are distinct, in order, and agree in their first ``depth`` bits, so that a stretch of them is
    a node of a binary trie. Pairs of nodes are walked level by level; at most about ``most`` pairs at once. Once there
    are ``folded`` links (0: never) and more than nodes, they give way to a tree that joins the same nodes.
    """
    values, n = values.astype(np.uint64), len(values)
    ends = np.append(starts[1:], n)
    left, right, kept = [], [], 0
    todo = [(depth, np.stack([starts, ends, starts, ends, np.zeros_like(starts)]))]
    while todo:
        depth, pairs = todo.pop()
        a, b, c, d, e = pairs
        lone = (b - a == 1) & (d - c == 1)
        i, j = a[lone], c[lone]
        near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
        left.append(i[near])
        right.append(j[near])
        kept += int(near.sum())
        if kept > max(folded or kept, n):  # more links than nodes: a tree of them joins the same
            roots = local_roots(n, np.concatenate(left), np.concatenate(right))
            at = np.flatnonzero(roots != np.arange(n))
            left, right, kept = [at], [roots[at]], len(at)
        pairs = pairs[:, ~lone]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > most:
            half = pairs.shape[1] // 2
            todo += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
            continue
        a, b, c, d, e = pairs
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        am, cm = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])  # where the bit turns from 0 to 1
        same = a == c
        below = [(a, am, c, cm, e), (am, b, cm, d, e), (a, am, cm, d, e + 1), (am, b, c, cm, e + 1)]
        keep = [(lo < hi) & (lo2 < hi2) & (x <= budget) for lo, hi, lo2, hi2, x in below]
        keep[3] &= ~same  # of a node with itself, the mirror of the pair before
        todo.append((depth + 1, np.concatenate([np.stack(x)[:, k] for x, k in zip(below, keep)], axis=1)))
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` is linked with, directly or not."""
    roots = np.arange(n)
    while len(left):
        low = np.minimum(roots[left], roots[right])
        np.minimum.at(roots, roots[left], low)
        np.minimum.at(roots, roots[right], low)
        while not np.array_equal(roots, up := roots[roots]):
            roots = up
        apart = roots[left] != roots[right]
        left, right = left[apart], right[apart]
    return roots


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that join all of the distinct longs ``fps.fp`` that differ in ``budget`` (up to 3) bits or fewer."""
    if not 0 <= budget <= 3:
        raise ValueError("four blocks suffice for a budget of 3 bits")
    blocks = fps.select("fp", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("block"))
    turned = "case when block = 0 then fp else shiftleft(fp, 16 * block) | shiftrightunsigned(fp, 64 - 16 * block) end"
    blocks = blocks.select("block", F.expr(turned).alias("value")).withColumn("head", F.expr("shiftrightunsigned(value, 48)"))
    # at most 4 * 65,536 block values, whatever the input
    full = blocks.groupBy("block", "head").count().filter(F.col("count") > crowded).select("block", "head", F.lit(True).alias("full"))
    blocks = blocks.join(F.broadcast(full), ["block", "head"], "left")
    parts = F.when(F.col("full"), F.array(*[F.lit(i) for i in range(4)])).otherwise(F.array(F.lit(-1)))
    parts = blocks.select("block", "value", F.explode(parts).alias("part"))
    low = "(value & 281474976710655L)"  # 48 bits
    again = f"(value & -281474976710656L) | ((shiftleft({low}, 12 * part) | shiftrightunsigned({low}, 48 - 12 * part)) & 281474976710655L)"
    parts = parts.withColumn("value", F.expr(f"case when part > 0 then {again} else value end"))
    parts = parts.withColumn("head", F.expr("shiftrightunsigned(value, case when part < 0 then 48 else 36 end)"))

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # the frames of the last group so far, which may go on
        for f in frames:
            keys = f[["block", "part", "head"]].to_numpy()
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = held[-1][["block", "part", "head"]].to_numpy()[-1] if held else keys[0]
            cut = changes[-1] if len(changes) else 0 if (keys[0] == last).all() else None
            if cut is None or cut:
                yield from linked(pd.concat([*held, f.iloc[: cut or 0]], ignore_index=True))
                held = []
            held.append(f.iloc[cut or 0 :])
        if held:
            yield from linked(pd.concat(held, ignore_index=True))

    def linked(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for crowd, depth in ((False, 16), (True, 28)):
            g = f[(f["part"] >= 0) == crowd]
            if len(g) < 2:
                continue
            block, part, value = g["block"].to_numpy(), g["part"].to_numpy(), g["value"].to_numpy().view(np.uint64)
            head = value >> np.uint64(64 - depth)
            order = np.lexsort((value, head, part, block))
            block, part, value, head = block[order], part[order], value[order], head[order]
            new = np.ones(len(g), bool)
            new[1:] = (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (head[1:] != head[:-1])
            left, right = trie_links(value, np.flatnonzero(new), depth, budget, folded=1 << 20)
            roots = local_roots(len(value), left, right)
            at = np.flatnonzero(roots != np.arange(len(value)))
            back = turned_back(value, block, part)
            yield pd.DataFrame({"a": back[at].view(np.int64), "b": back[roots[at]].view(np.int64)})

    dealt = parts.repartition("block", "part", "head").sortWithinPartitions("block", "part", "head", "value")
    return dealt.mapInPandas(link, "a long, b long")


def turned_back(value: np.ndarray, block: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The fingerprints that ``fingerprint_links`` turned: the quarter of the lower 48 bits first, then the block."""
    low = np.uint64((1 << 48) - 1)
    by = (12 * np.maximum(part, 0)).astype(np.uint64)
    bits = value & low
    bits = ((bits >> by) | (bits << (np.uint64(48) - by))) & low
    value = (value & ~low) | bits
    by = (16 * block).astype(np.uint64)
    return np.where(by == 0, value, (value >> by) | (value << ((np.uint64(64) - by) % np.uint64(64))))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row of ``docs``; root is the smallest fingerprint of its component,
    component_id the smallest id of it."""
    rows = checkpointed(fingerprints(docs))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(nodes.select("fp"), budget, crowded)
    roots = components(links, "a", "b")
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = checkpointed(nodes)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
