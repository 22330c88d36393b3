"""Near-duplicates by Jaccard similarity of word shingles, for the pipeline: exact, by prefixes of rare shingles.

First the fingerprints and the trie of operator 9 find what differs in three bits or fewer; each such link is checked on
whole sets, and those that hold begin the components. Fingerprints can't tell similarities of 0.8 apart within three
bits, and the trie prunes nothing under a budget of a dozen; so sets then find what the trie leaves out. A text's set
holds the hashes of its shingles of ``words`` words; a
shorter text is one shingle. Two sets of similarity ``least`` share a shingle among the first
``size - ceil(least * size) + 1`` of each, in any order that is one for all: here the shingles that a sample of texts
has often come last, so that common phrases bring few sets together. The order bears on the work alone. Equal sets are
one node first. Nodes that share a shingle are compared with one of them, and what agrees is joined into components;
then nodes of different components that share enough are compared, those of a shingle's largest component only with
the others. Where shingles are still crowded, components grow first: each node outside the largest one is compared with
the likeliest of some nodes in it, a few times. So a group of copies costs its size, not its square. Before two sets are compared, their sketches
have to allow it: a set's sketch has a bit for the parity of its hashes in each of ``SKETCH`` places, so that two sketches
differ in at most as many bits as there are shingles in one set only. Texts of one template that aren't similar end
there. Every link is checked on whole sets, and none of ``least`` is missed.

Bitmaps of a fixed size tell tasks which shingles and which texts can matter, so that the rest is not shuffled: a bit
that is set wrongly costs work, not results, so they are right at any size and save less the fuller they are.

Defined cases: null is the empty text, all empty texts are equal; every row of the input counts, repeated rows too;
ids are of any type and pass as they are, as do all columns, whatever their names; whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docmill.llm import simhash
from docmill.llm.common import Tables, derived, text_slices
from docmill.llm.components import components
from docmill.llm.lm_scoring import extended, words_of
from docmill.session import checkpointed

WORDS = 5
LEAST = 0.8
#: One of so many texts says which shingles are common; so many of those are told to tasks.
SAMPLE = 16
COMMON = 100_000
#: Bits of a set's sketch.
SKETCH = 512
#: While so many pairs for each row of shingles lie ahead, components grow first, in so many turns at most.
CROWDED, TURNS = 8, 1
#: Rows of the input for each file of a table, at least.
ROWS_OF_FILE = 2_000
#: Bits of a bitmap: 4 MB.
BITS = 1 << 25


def sets_of(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text by text and in order, and how many each has."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*split)} if split else {}
    hashes = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[of]
    grams, found, owners = hashes, [], []
    for n in range(1, words + 1):
        if n > 1:
            grams = extended(np.roll(grams, 1), hashes)
        use = place >= words - 1 if n == words else (sizes[of] == n) & (place == n - 1)
        found.append(grams[use])
        owners.append(of[use])
    gram, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new].view(np.int64), np.bincount(owner[new], minlength=len(texts))


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))


def set_keys(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    keys = [xxhash.xxh64_intdigest(found[b - n : b].tobytes()) for b, n in zip(ends.tolist(), sizes.tolist())]
    return np.array(keys, np.uint64).view(np.int64)


def sketches(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each set, the parity of its hashes in each place, as longs."""
    place = found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SKETCH.bit_length() + 1)
    of = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(of * SKETCH + place.astype(np.int64), minlength=len(sizes) * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, SKETCH), axis=1).view(np.int64)


def fewest(size: Column, least: float) -> Column:
    """Shingles of a set that any similar set has."""
    return F.ceil(size * least - 1e-9)


def bitmap(values: Column, of: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits in which those of the hashes ``values`` are set; only its words come to the driver."""
    place = F.pmod(values, F.lit(bits))
    rows = of.select(place.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def marked(map_: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values % (len(map_) * 64)
    return (map_[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def common_shingles(docs: DataFrame, words: int, sample: int, most: int) -> np.ndarray:
    """Rows of shingle and number of texts, by shingle, of those common among a sample of the texts."""
    some = docs.select("text", F.xxhash64("text").alias("hash")).filter(F.pmod("hash", F.lit(sample)) == 0).dropDuplicates(["hash"])
    cut = derived(some.select("text"), "grams array<bigint>", lambda: lambda texts: [lists(*sets_of(texts, words))])
    counted = cut.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    rows = counted.filter("count > 1").orderBy(F.desc("count"), "gram").limit(most).collect()  # ``most`` rows
    return np.array(sorted((r["gram"], r["count"]) for r in rows), np.int64).reshape(-1, 2)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, whole, words: two hashes that tell rows apart, doc_id, text) of ``docs``, whose columns are in ``row``."""
    hashed = [F.col(f"row.`{f.name.replace('`', '``')}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", F.xxhash64(*hashed).alias("whole"), F.xxhash64("row.text").alias("words"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def shingled(rows: DataFrame, words: int, least: float, common: np.ndarray) -> DataFrame:
    """(doc_id, whole, words, key, size, prefix, sketch, fp) for each row: the hash of its set, the set's size, rarest
    shingles and sketch, and the text's fingerprint."""
    often = rows.sparkSession.sparkContext.broadcast(common)

    def start():
        known, counts = often.value[:, 0], often.value[:, 1]

        def cut(texts: list[str]) -> list:
            found, sizes = sets_of(texts, words)
            ends, keys = np.cumsum(sizes), set_keys(found, sizes)
            at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
            count = np.where(known[at] == found, counts[at], 0) if len(known) else np.zeros(len(found), np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(found)) - (ends - sizes)[of]
            first = sizes - np.ceil(sizes * least - 1e-9).astype(np.int64) + 1
            rare = found[np.lexsort((found, count, of))][place < first[of]]
            flat = sketches(found, sizes)
            fps = simhash.fingerprints_of(texts).view(np.int64)
            return [keys, sizes, lists(rare, np.minimum(first, sizes)), lists(flat.ravel(), np.full(len(flat), flat.shape[1])), fps]

        return cut

    return derived(rows.select("doc_id", "whole", "words", "text"), "key bigint, size bigint, prefix array<bigint>, sketch array<bigint>, fp bigint", start)


def marked_grams(nodes: DataFrame, map_: np.ndarray) -> DataFrame:
    """(gram and the other columns of the nodes) for those shingles of the nodes' prefixes that the bitmap marks."""
    sent = nodes.sparkSession.sparkContext.broadcast(map_)
    kept = [c for c in nodes.columns if c != "prefix"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(batch.schema.get_field_index("prefix"))
            grams = prefix.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(batch)), np.diff(prefix.offsets.to_numpy()))
            use = marked(sent.value, grams)
            row = pa.array(of[use])
            yield pa.RecordBatch.from_arrays([pa.array(grams[use]), *[batch.column(c).take(row) for c in kept]], ["gram", *kept])

    return nodes.mapInArrow(cut, StructType([StructField("gram", LongType()), *[nodes.schema[c] for c in kept]]))


def narrowed(nodes: DataFrame, map_: np.ndarray) -> DataFrame:
    """The nodes with those shingles alone in their prefixes that the bitmap marks."""
    sent = nodes.sparkSession.sparkContext.broadcast(map_)
    at = nodes.columns.index("prefix")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, sizes = batch.column(at).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(at).offsets.to_numpy())
            use = marked(sent.value, grams)
            kept = np.bincount(np.repeat(np.arange(len(batch)), sizes)[use], minlength=len(batch))
            yield batch.set_column(at, batch.schema.names[at], lists(grams[use], kept))

    return nodes.mapInArrow(cut, nodes.schema)


def trie_pairs(nodes: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Pairs (a, b, m, n with sizes) of the nodes' keys, each of which comes once, whose fingerprints the trie joins, or that have one fingerprint: no more than
    a few for each key, which connect all keys within the trie's budget."""
    marks = nodes.select("key", "fp", "size")
    leads = checkpointed((tables or Tables(nodes.sparkSession)).few(marks.groupBy("fp").agg(F.min(F.struct("key", "size")).alias("lead"))))
    same = marks.join(leads, "fp").filter(F.col("key") != F.col("lead.key")).select("lead", F.struct("key", "size").alias("other"))
    links = simhash.fingerprint_links(leads.select("fp")).distinct()
    links = links.join(leads.withColumnRenamed("fp", "a"), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("other")), "b")
    met = same.union(links.select("lead", "other"))
    return met.select(F.col("lead.key").alias("a"), F.col("other.key").alias("b"), F.col("lead.size").alias("m"), F.col("other.size").alias("n"))


def similar(rows: DataFrame, table: DataFrame, pairs: DataFrame, words: int, least: float, bits: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose whole sets reach ``least``. ``table``: what ``shingled`` gave of ``rows``."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    asked = table.select("key", "whole").join(asked, "key", "left_semi").groupBy("key").agg(F.min("whole").alias("whole"))
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(F.col("whole"), asked, bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(sent.value, batch.column(0).to_numpy())))
            for _, texts in text_slices([batch]):
                found, sizes = sets_of(texts, words)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(found, sizes)), lists(found, sizes)], ["key", "grams"])

    sets = rows.select("whole", "text").mapInArrow(cut, "key long, grams array<long>").dropDuplicates(["key"])
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= (F.size("x") + F.size("y") - shared) * least - 1e-9).select("a", "b")


def near_keys(rows: DataFrame, table: DataFrame, words: int, least: float, bits: int, tables: Tables) -> DataFrame:
    """(node, root) for each key that isn't the smallest of its component."""
    some = table.select("key", "size", "prefix", "sketch", "fp").filter(fewest(F.col("size"), least) < F.floor(F.col("size") / least + 1e-9))
    every = some.select("key", F.explode("prefix").alias("gram"))
    held = every.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("gram")
    # one row a node from here on: rows of shingles are cut from it where they are needed, and are not joined with what nodes have
    parts = range(SKETCH // 64)
    nodes = narrowed(some, bitmap(F.col("gram"), held, bits)).groupBy("key").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    nodes = tables.written(nodes.select("key", "size", "fp", "prefix", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in parts]), "near-nodes")

    shared = lambda m, n: F.ceil((F.col(m) + F.col(n)) * (least / (1 + least)) - 1e-9)  # noqa: E731 - shingles, at least

    sketched = nodes.select(F.col("key").alias("a"), *[f"s{i}" for i in parts])
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in parts), F.lit(0))
    spare = F.col("m") + F.col("n") - 2 * shared("m", "n") - apart  # of the shingles that may be in one set only
    sketched_b = sketched.withColumnsRenamed({"a": "b", **{f"s{i}": f"t{i}" for i in parts}})

    def enough(met: DataFrame) -> DataFrame:
        """Of met keys (a, b, m, n with sizes), once for each shingle of both prefixes, the pairs that may be similar by the
        number of those and by their sketches."""
        counted = met.groupBy("a", "b", "m", "n").count()
        need = shared("m", "n")
        counted = counted.filter(F.col("count") > need - F.greatest(fewest(F.col("m"), least), fewest(F.col("n"), least)))
        return counted.join(sketched, "a").join(sketched_b, "b").filter(spare >= 0).select("a", "b")

    def cut(live: DataFrame, per: DataFrame) -> DataFrame:
        """(gram, a, m, root, top, sketch) for the shingles of ``per``, cut from the nodes."""
        grams = marked_grams(live, bitmap(F.col("gram"), per, bits)).join(per.select("gram", "top"), "gram")
        return grams.withColumnsRenamed({"key": "a", "size": "m"})

    sized = lambda m, n: F.least(m, n) >= F.greatest(m, n) * least - 1e-9
    band = F.floor(F.log("size") / float(np.log(1 / least))).alias("band") if least < 1 else F.col("size").alias("band")
    banded = nodes.select("key", "size", F.explode("prefix").alias("gram"), band)
    leads = banded.groupBy("gram", "band").agg(F.min(F.struct("key", "size")).alias("lead"), F.count("*").alias("_n")).filter("_n > 1")
    met = banded.join(leads, ["gram", "band"]).filter((F.col("key") != F.col("lead.key")) & sized(F.col("size"), F.col("lead.size")))
    met = met.select(F.col("lead.key").alias("a"), F.col("key").alias("b"), F.col("lead.size").alias("m"), F.col("size").alias("n"))
    near = trie_pairs(nodes, tables).filter(sized(F.col("m"), F.col("n"))).join(sketched, "a").join(sketched_b, "b").filter(spare >= 0)
    met = enough(met).union(near.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = tables.written(similar(rows, table, tables.written(met, "near-met"), words, least, bits), "near-links")

    live = nodes.select("key", "size", "prefix", *[f"s{i}" for i in parts])
    for turn in range(TURNS + 1):
        roots = components(links, "a", "b")
        live = live.join(roots, live["key"] == roots["node"], "left").select(*live.columns, F.coalesce("root", "key").alias("root"))
        live = tables.written(live, f"near-live-{turn}")
        per = live.select(F.explode("prefix").alias("gram"), "root").groupBy("gram", "root").count()
        per = per.groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.max("count").alias("most"), F.sum("count").alias("all"))
        per = tables.written(per.filter(F.col("all") > F.col("most")), f"near-per-{turn}")
        outside = F.col("root") != F.col("top")
        held, pairs = per.agg(F.sum("all"), F.sum(F.col("all") * (F.col("all") - F.col("most")))).first()
        if turn == TURNS or (pairs or 0) <= CROWDED * (held or 0):
            break
        x = cut(live, per.filter(F.col("all") - F.col("most") > CROWDED))
        # each node outside its shingles' largest components meets one node in each of those, another in each turn
        lead = F.min_by(F.struct("a", "m", *[f"s{i}" for i in parts]), F.xxhash64("a", "gram", F.lit(turn))).alias("lead")
        leads = x.filter(~outside).groupBy("gram").agg(lead).select("gram", F.col("lead.a").alias("b"), F.col("lead.m").alias("n"), *[F.col(f"lead.s{i}").alias(f"t{i}") for i in parts])
        near = x.filter(outside).join(leads, "gram").filter(sized(F.col("m"), F.col("n")) & (spare >= 0))
        near = near.groupBy("a").agg(F.max_by("b", F.struct(spare, "b")).alias("b"))  # the likeliest
        near = tables.written(near, f"near-leads-{turn}")
        links = tables.written(links.union(similar(rows, table, near, words, least, bits)), f"near-links-{turn}")
        # what one component holds alone stays so: its shingles go, and nodes that have no others
        live = narrowed(live.drop("root"), bitmap(F.col("gram"), per, bits)).filter(F.size("prefix") > 0)
    # sketches are compared before a pair is made
    x = cut(live, per)
    y = x.filter(outside).select("gram", F.col("a").alias("b"), F.col("m").alias("n"), F.col("root").alias("other"), *[F.col(f"s{i}").alias(f"t{i}") for i in parts])
    once = ~outside | (F.col("a") < F.col("b"))
    met = x.join(y, "gram").filter(once & (F.col("root") != F.col("other")) & sized(F.col("m"), F.col("n")) & (spare >= 0))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("m")).otherwise(F.col("n")).alias("m"), F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n"))
    more = similar(rows, table, tables.written(enough(met), "near-more"), words, least, bits)
    return components(links.union(more), "a", "b")


def near_duplicates(rows: DataFrame, words: int = WORDS, least: float = LEAST, sample: int = SAMPLE, most: int = COMMON, bits: int = BITS, tables: Tables | None = None) -> DataFrame:
    """(doc_id, whole, words, root) for each of the rows of ``keyed``; rows of similar sets, directly or by a chain, have
    one root. What is written on the way is in ``tables``, to be removed when the result has been read."""
    tables = tables or Tables(rows.sparkSession)
    table = tables.written(shingled(rows, words, least, common_shingles(rows, words, sample, most)), "near-rows")
    roots = near_keys(rows, table, words, least, bits, tables)
    return table.join(roots, table["key"] == roots["node"], "left").select("doc_id", "whole", "words", F.coalesce("root", "key").alias("root"))


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = LEAST, bits: int = BITS) -> DataFrame:
    """One row of each component of near-duplicates, the one with the smallest id, with all its columns; of repeated
    rows the first by the columns' hash."""
    rows = keyed(docs)
    tables = Tables(docs.sparkSession, 1 + docs.count() // ROWS_OF_FILE)
    found = checkpointed(tables.few(near_duplicates(rows, words, least, bits=bits, tables=tables)))
    tables.removed()
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole", "words")).alias("x"), F.count("*").alias("n"))
    grouped = found.join(first.filter("n > 1"), "root")
    kept = (F.col("whole") == F.col("x.whole")) & (F.col("words") == F.col("x.words"))
    decided = checkpointed(tables.few(grouped.select("whole", "words", kept.alias("kept")).distinct()))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(F.col("whole"), decided, bits))

    def those(met: bool) -> DataFrame:
        """The rows that may be of a group, or those that can't."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marked(sent.value, batch.column(1).to_numpy()) == met))

        part = rows.select("row", "whole", "words")
        return part.mapInArrow(cut, part.schema)

    met = those(True).join(decided, ["whole", "words"], "left").filter(F.coalesce("kept", F.lit(True)))
    place = F.row_number().over(Window.partitionBy("whole", "words").orderBy("whole"))  # of repeated rows, which are equal, one
    met = met.withColumn("place", place).filter("place = 1").select("row")
    return tables.few(those(False).select("row").union(met).select("row.*"))
