"""Ranked lexical search (operator 11): variable-block-max WAND over shards of postings.

Documents are dealt into shards of some ``SHARD`` rows. A task lays out a shard's postings by term and document and cuts
each list into blocks by dynamic programming: of all cuts into blocks of at most ``LONGEST`` postings it takes the one
with the least sum of bound errors (a block's largest impact less each posting's own) plus ``PENALTY`` for each block.
All lists of a shard go through that recurrence together, a posting at a time.

A search keeps the k-th best score so far. The bounds of an item's blocks, added up along the documents, cut the shard
into ranges that share one bound, and a range is a pivot if its bound reaches the k-th score. Pivots are taken from the
highest bound down; only blocks that reach into one are read, and the first bound that is too low ends the search. So
results are exact. One shard is searched first, and its k-th scores are where all others begin.

Integers throughout, but for the logarithm in a term's weight; see ``impact`` and ``weighted_terms``.

The terms of the items are told to all tasks. Items are a query set whose size is checked: they go in blocks of
``CHARS`` characters, one for an ordinary set, and each block is a search of its own over all documents.

Defined cases: null texts have no term and are in no result; they and texts without a term don't count in N; repeated
rows of documents are documents of their own; equal rows of items are one item, different texts under one id are items
of their own, each ranked from 1; items that are null or whose terms no document has give no rows; equal scores go by
id, null ids last; ids of any type that has an order pass as they are; other columns of the inputs are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docmill.llm.common import derived, written
from docmill.session import checkpointed

#: Documents of a shard, about.
SHARD = 8192
#: Postings of a block, at most, and what a block costs beside its bound errors, in units of impact.
LONGEST = 64
PENALTY = 1_000_000
#: Documents that a search scores before it looks at its bounds again; doubled each time.
FIRST = 128
#: Characters of the items that are searched for together.
CHARS = 4_000_000

#: In a text's UTF-8 bytes: A-Z in lower case, what is in no term as a blank.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split(b" ")


def impact(tf: np.ndarray, length: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a posting adds to a score for each unit of its term's weight."""
    m = 10 + 90 * length * documents // words
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def cut_points(impacts: np.ndarray, sizes: np.ndarray, longest: int = LONGEST, penalty: int = PENALTY) -> np.ndarray:
    """The first postings of all blocks, for lists of ``sizes`` that lie one after another in ``impacts``.

    With best[i] the least cost of a list's first i postings, where a block costs its length times its largest impact
    (the impacts' own sum is the same for all cuts) and ``penalty``, best[i] is the least of best[j] + (i - j) *
    max(j..i) + penalty over the last ``longest`` j. Lists are taken by length, so that those not yet at their end are
    always the first ones.
    """
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
    n, most = len(size), int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), side="left")  # lists longer than i
    back = np.zeros(len(impacts), np.int32)
    best = np.zeros((longest, n), np.int64)  # row i % longest: the cost of the first i postings
    top = np.zeros((longest, n), np.int64)  # row j % longest: the largest impact from posting j on, so far
    for i in range(most):
        a = live[i]
        depth = min(i + 1, longest)
        top[i % longest, :a] = 0
        held = top[:depth, :a]
        np.maximum(held, impacts[start[:a] + i], out=held)
        from_ = np.arange(max(0, i + 1 - longest), i + 1)
        from_ = from_[np.argsort(from_ % longest)]  # in the order of the rows
        cost = best[:depth, :a] + held * (i + 1 - from_)[:, None]
        pick = cost.argmin(axis=0)
        back[start[:a] + i] = from_[pick]
        best[(i + 1) % longest, :a] = cost[pick, np.arange(a)] + penalty
    firsts, end, at = [], size.copy(), np.arange(n)
    while len(at := at[end[at] > 0]):
        end[at] = back[start[at] + end[at] - 1]
        firsts.append(start[at] + end[at])
    return np.sort(np.concatenate(firsts)) if firsts else np.zeros(0, np.int64)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Shard:
    """Postings of some documents, numbered in the order of ties, in blocks."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, documents: int, longest: int = LONGEST, penalty: int = PENALTY):
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, self.documents = docs[order], impacts[order], documents
        self.terms, sizes = np.unique(terms, return_counts=True)
        self.first = cut_points(self.impacts, sizes, longest, penalty)
        self.size = np.diff(np.append(self.first, len(self.docs)))
        self.top = np.maximum.reduceat(self.impacts, self.first) if len(self.first) else self.first
        self.low, self.high = self.docs[self.first], self.docs[self.first + self.size - 1] + 1
        ends = np.cumsum(sizes)
        self.blocks = np.searchsorted(self.first, np.append(ends - sizes, ends[-1:]))  # of term number i: [i], [i + 1]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the ``k`` best that score ``least`` or more, best first."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        use = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[use], weights[use]
        count = self.blocks[at + 1] - self.blocks[at]
        block, weight = spread(self.blocks[at], count), np.repeat(weights, count)
        if not len(block):
            return none
        edges = np.concatenate([self.low[block], self.high[block]])
        order = np.argsort(edges, kind="stable")
        bound = np.cumsum(np.concatenate([self.top[block] * weight, -self.top[block] * weight])[order])
        last = np.append(edges[order][1:] != edges[order][:-1], True)  # bounds hold once all edges of a place are in
        place, bound = edges[order][last], bound[last]
        length = np.diff(np.append(place, place[-1:]))
        ranges = np.argsort(-bound, kind="stable")
        ranges = ranges[(bound[ranges] >= least) & (length[ranges] > 0)]
        covered = np.cumsum(length[ranges])
        found, scores = none
        done, want = 0, FIRST
        while done < len(ranges) and bound[ranges[done]] >= least:
            upto = max(done + 1, int(np.searchsorted(covered, want, side="right")))
            now = ranges[done:upto]
            now = now[bound[now] >= least]
            pivots = spread(place[now], length[now])
            live = np.zeros(self.documents + 1, bool)
            live[pivots] = True
            before = np.concatenate([[0], np.cumsum(live[:-1])])
            reached = before[self.high[block]] > before[self.low[block]]
            reads = block[reached]
            posting = spread(self.first[reads], self.size[reads])
            gain = self.impacts[posting] * np.repeat(weight[reached], self.size[reads])
            doc = self.docs[posting]
            score = np.zeros(self.documents, np.int64)
            np.add.at(score, doc, gain)
            pivots = pivots[score[pivots] >= least]
            found, scores = np.append(found, pivots), np.append(scores, score[pivots])
            first = np.lexsort((found, -scores))[:k]
            found, scores = found[first], scores[first]
            if len(found) == k:
                least = max(least, int(scores[-1]))
            done, want = upto, want * 2 + int(covered[upto - 1])
        return found, scores


def weighted_terms(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, weight of each of the terms 0 .. ``terms`` - 1) over the documents of an index."""
    n, words = index.agg(F.count(F.when(F.col("n") > 0, True)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    rows = df.select("term", weight.alias("weight")).toArrow()  # a row for each term of the items
    weights = np.zeros(terms, np.int64)
    weights[rows["term"].to_numpy()] = rows["weight"].to_numpy()
    return n, words, weights


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs, row) for each document: its length, and how often it has each term of ``known``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def start():
        number = sent.value.get

        def cut(texts: list[str]) -> list:
            lengths, sizes, terms, tfs = [], [0], [], []
            for text in texts:
                words = Counter(terms_of(text))
                lengths.append(words.total() - words.pop(b"", 0))
                for word, tf in words.items():
                    if (t := number(word)) is not None:
                        terms.append(t)
                        tfs.append(tf)
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            return [lengths, *(pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (terms, tfs))]

        return cut

    return derived(docs.select("doc_id", "text"), "n bigint, terms array<int>, tfs array<int>", start).withColumn("row", F.monotonically_increasing_id())


def item_blocks(items: DataFrame, chars: int = CHARS) -> Iterator[pa.Table]:
    """The items (item_id, text), each once, in tables of some ``chars`` characters."""
    rows = items.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    n = math.ceil((rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0) / chars)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        yield rows.filter(part == i).orderBy("item_id", "text").toArrow()


def search_block(docs: DataFrame, asked: pa.Table, k: int, shard_rows: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items of one block."""
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    of_item = [[known.setdefault(t, len(known)) for t in dict.fromkeys(terms_of(text)) if t] for text in asked["text"].to_pylist()]
    index = written(postings(docs, known), "postings")
    documents, words, weights = weighted_terms(index, len(known))
    shards = max(1, math.ceil(documents / shard_rows))
    dealt = index.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    terms = [np.array(t, np.int64) for t in of_item]
    schema = StructType.fromDDL("item int, score long").add("doc_id", docs.schema["doc_id"].dataType)

    def found(part: DataFrame, least: np.ndarray) -> DataFrame:
        told = spark.sparkContext.broadcast((terms, weights, least))

        def search(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
            lists = table["terms"].combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(table)), size)
            tf = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            gain = impact(tf, table["n"].to_numpy()[doc], documents, words)
            terms, weights, least = told.value
            shard = Shard(lists.flatten().to_numpy(), doc, gain, len(table))
            hits = [shard.search(t, weights[t], k, int(a)) for t, a in zip(terms, least)]
            item = np.repeat(np.arange(len(hits)), [len(d) for d, _ in hits])
            at = pa.array(np.concatenate([d for d, _ in hits]) if hits else np.zeros(0, np.int64))
            score = np.concatenate([s for _, s in hits]) if hits else np.zeros(0, np.int64)
            ids = table["doc_id"].combine_chunks().take(at)
            return pa.table([pa.array(item, pa.int32()), pa.array(score, pa.int64()), ids], names=["item", "score", "doc_id"])

        return part.groupBy("shard").applyInArrow(search, schema)

    first = checkpointed(found(dealt.filter("shard = 0"), np.ones(len(terms), np.int64)))
    least = np.ones(len(terms), np.int64)
    for item, score in first.groupBy("item").agg(F.min("score"), F.count("*").alias("n")).filter(F.col("n") >= k).select("item", "min(score)").collect():
        least[item] = score
    both = first.unionByName(found(dealt.filter("shard > 0"), least)) if shards > 1 else first
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = both.withColumn("rank", place).filter(F.col("rank") <= k)
    names = pa.table([pa.array(range(len(asked)), pa.int32()), asked["item_id"]], names=["item", "item_id"])
    return best.join(F.broadcast(spark.createDataFrame(names)), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard_rows: int = SHARD, chars: int = CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` that score best for each of ``items``."""
    found, before = None, None
    for asked in item_blocks(items, chars):
        if before is not None:  # the block before is done with
            before = written(before, "ranked")
            found = before if found is None else found.union(before)
        before = search_block(docs, asked, k, shard_rows)
    if before is None:
        kinds = StructType([items.schema["item_id"], *StructType.fromDDL("rank int"), docs.schema["doc_id"], *StructType.fromDDL("score long")])
        return docs.sparkSession.createDataFrame([], kinds)
    return before if found is None else found.union(before)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


RANKED_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc, doc_id, terms, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM held),
items AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM items),
tokens AS (SELECT doc, unnest(terms) AS term FROM held),
tfs AS (SELECT doc, term, count(*)::BIGINT AS tf FROM tokens SEMI JOIN asked USING (term) GROUP BY doc, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), stats),
scored AS (
  SELECT item, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN held USING (doc), stats
  GROUP BY item, item_id, doc, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
