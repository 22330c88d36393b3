"""Language-model scores by stupid backoff (operator 1).

Every token is scored by the counts of all *other* documents: the longest n-gram that ends there and that they hold
often enough gives ``backoff**steps * count(n-gram) / count(n-gram without its last word)``, a single word count / all
tokens. A document's own n-grams don't count for it, else each of its n-grams would be known and nothing backed off.
Logarithms are summed for each document.

Documents are cut into chunks of consecutive rows, some million tokens each. The n-grams of a chunk, exploded and
counted once for each distinct one, go to the bucket of their hash, packed into an array for each chunk and bucket:
rows of one n-gram each would outgrow the corpus, whose compressed text is under four bytes a token. A bucket adds up
its part of the count table and joins it to what the chunks asked for; the counts go back to the chunks. An n-gram of
three words or more is asked for only where other documents hold both of the shorter n-grams in it; else none of them
can hold it. Buckets grow in number with the corpus, so that each stays small; frequent n-grams come to theirs once
for each chunk, not once for each document.

``least`` is a count cut-off for n-grams of two words or more; n-grams start anew in each document. Counts are over all
rows, whole texts; what is gathered grows with the corpus. N-grams are told apart by 64-bit hashes.

Defined cases: null is the empty text, which has no tokens, sum 0 and a null mean; a word that no other document holds
counts as held once; every row of the input counts as a document and gives a row, repeated rows too; ids of any type
pass as they are; other columns of the input are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docmill.llm.common import WORD, text_slices

ORDER = 3
LEAST = 1
BACKOFF = 0.4
#: Tokens of a chunk, at least, unless its partition has fewer; n-grams of a bucket, about.
CHUNK = 1_500_000
BUCKET = 1_000_000
ASKED = "bucket long, chunk string, n int, grams binary, counts binary"
ANSWERED = "chunk string, n int, bucket long, counts binary"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def extended(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams made longer by a word each."""
    with np.errstate(over="ignore"):
        x = (grams * np.uint64(0x9E3779B97F4A7C15)) ^ ((words << np.uint64(31)) | (words >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes, all of the first bytes first, as the higher ones are mostly alike."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def packed_set(values: np.ndarray) -> bytes:
    """Numbers in order, as their differences."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_set(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


class Chunk:
    """The documents of a chunk, from its pieces."""

    def __init__(self, pieces: pa.Table):
        self.pieces = pieces.sort_by("piece")
        read = lambda c, kind: np.concatenate([np.frombuffer(zstandard.decompress(x), kind) for x in self.pieces[c].to_pylist()] or [np.zeros(0, kind)])
        words = read("low", np.uint16) | read("high", np.uint16).astype(np.int64) << 16
        self.sizes = read("sizes", np.int32).astype(np.int64)
        self.hashes = read("vocabulary", np.uint64)[words]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(words)) - (np.cumsum(self.sizes) - self.sizes)[self.doc]

    def levels(self, order: int, found: dict[int, list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """For n from 1 to ``order``: (n, places where an n-gram ends that other documents may hold, the distinct ones,
        which of them ends at each of those places, and, if ``found`` has them, the counts of other documents there)."""
        grams, held = self.hashes, np.full(len(self.hashes), True)
        for n in range(1, order + 1):
            if n > 1:
                grams = extended(np.roll(grams, 1), self.hashes)
            use = self.place >= n - 1
            at = np.flatnonzero(use & held & np.roll(held, 1) if n > 2 else use)
            distinct, which = np.unique(grams[at], return_inverse=True)
            others = None
            if n in found or not len(at):
                counts = np.concatenate([np.zeros(0, np.int64), *map(unpacked, found.get(n, []))])
                _, own, times = np.unique(self.doc[at] << 32 | which, return_inverse=True, return_counts=True)
                others = counts[which] - times[own]
                held = np.zeros(len(held), bool)
                held[at] = others > 0
            yield n, at, distinct, which, others


def answers_of(found: pa.Table) -> dict[int, list[bytes]]:
    """For each n the counts that the buckets answered, in the buckets' order."""
    rows = sorted(zip(found["n"].to_pylist(), found["bucket"].to_pylist(), found["counts"].to_pylist()))
    return {n: [x[2] for x in of] for n, of in itertools.groupby(rows, key=lambda x: x[0])}


def chunks_of(docs: DataFrame, tokens: int = CHUNK) -> DataFrame:
    """Rows for the pieces of each chunk: documents' ids and sizes, their tokens as numbers in the chunk's vocabulary,
    the lower and the higher halves apart, as most of the higher are zero, and the hashes of words new in the piece."""
    kind = docs.schema["doc_id"].dataType
    of_ids = pa.list_(to_arrow_type(kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, piece, held, known = TaskContext.get().partitionId(), 0, 0, 0, defaultdict(itertools.count().__next__)
        for rows, texts in text_slices(batches):
            before = len(known)
            words = [words_of(t) for t in texts]
            sizes = np.array([len(w) for w in words], np.int32)
            codes = np.fromiter((known[w] for ws in words for w in ws), np.int32, int(sizes.sum()))
            new = np.fromiter((xxhash.xxh64_intdigest(w) for w in itertools.islice(known, before, None)), np.uint64, len(known) - before)
            parts = [zstandard.compress(x.tobytes(), 1) for x in (sizes, codes.astype(np.uint16), (codes >> 16).astype(np.uint16), new)]
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays([rows.column(0)])).cast(of_ids)
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{chunk}"]), pa.array([piece], pa.int32()), ids, *(pa.array([x], pa.binary()) for x in parts)], ["chunk", "piece", "ids", "sizes", "low", "high", "vocabulary"])
            piece, held = piece + 1, held + len(codes)
            if held >= tokens:
                chunk, piece, held, known = chunk + 1, 0, 0, defaultdict(itertools.count().__next__)

    schema = f"chunk string, piece int, ids array<{kind.simpleString()}>, sizes binary, low binary, high binary, vocabulary binary"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def asked(chunk: str, levels: Iterator[tuple], bits: int) -> pa.Table:
    """Rows for the buckets: a chunk's distinct n-grams of a hash range, in order, and their counts in the chunk."""
    rows = []
    for n, _, grams, which, _ in levels:
        if len(grams):
            counts = np.bincount(which, minlength=len(grams)).astype(np.int64)
            of = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            cuts = np.flatnonzero(np.diff(of)) + 1
            parts = zip(of[np.append(0, cuts)].tolist(), np.split(grams, cuts), np.split(counts, cuts))
            rows += [(b, chunk, n, packed_set(g), packed(c)) for b, g, c in parts]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["bucket", "chunk", "n", "grams", "counts"])


def summed(rows: pa.Table) -> pa.Table:
    """A bucket's counts, for each row that asked, of its n-grams in their order."""
    out = []
    of = sorted(range(len(rows)), key=(n := rows["n"].to_pylist()).__getitem__)
    chunk, bucket, grams, counts = (rows[c].to_pylist() for c in ("chunk", "bucket", "grams", "counts"))
    for k, same in itertools.groupby(of, key=n.__getitem__):
        same = list(same)
        parts = [unpacked_set(grams[i]) for i in same]
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(which, np.concatenate([unpacked(counts[i]) for i in same])).astype(np.int64)[which]
        ends = np.cumsum([len(x) for x in parts])[:-1]
        out += [(chunk[i], k, bucket[i], packed(x)) for i, x in zip(same, np.split(total, ends))]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["chunk", "n", "bucket", "counts"])


def ask_longer(n: int, bits: int):
    """The rows for the buckets of a chunk's n-grams of ``n`` words, once those of fewer words are answered."""
    return lambda t, found: asked(t["chunk"][0].as_py(), itertools.islice(Chunk(t).levels(n, answers_of(found)), n - 1, n), bits)


def count_answers(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(chunk, n, bucket, counts): the corpus's counts of each chunk's n-grams in each bucket, in hash order."""
    counted = lambda rows: rows.groupBy("bucket").applyInArrow(summed, ANSWERED)
    first = lambda t: asked(t["chunk"][0].as_py(), Chunk(t).levels(min(order, 2), {}), bits)
    answers = counted(chunks.groupBy("chunk").applyInArrow(first, ASKED))
    for n in range(3, order + 1):
        longer = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_longer(n, bits), ASKED)
        answers = answers.union(counted(longer))
    return answers


def score(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, tokens: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, tokens, log_score, mean_log_score) for each row of ``docs``, against the counts of the others."""
    total = docs.agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long"))).first()[0] or 0
    bits = math.ceil(math.log2(max(1, order * total / bucket)))
    chunks = chunks_of(docs, tokens)
    kind = docs.schema["doc_id"].dataType

    def weigh(t: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(t)
        value, prior = np.zeros(len(chunk.doc)), np.zeros(len(chunk.doc))
        for n, at, _, _, others in chunk.levels(order, answers_of(found)):
            counts = np.zeros(len(value))
            counts[at] = others
            if n == 1:
                value = np.log(np.maximum(counts, 1) / np.maximum(total - chunk.sizes[chunk.doc], 1))
            else:
                known = counts >= max(least, 1)
                ratio = np.where(known, counts, 1) / np.where(known, np.roll(prior, 1), 1)
                value = np.where(chunk.place < n - 1, value, np.where(known, np.log(ratio), value + math.log(backoff)))
            prior = counts
        sums = np.bincount(chunk.doc, value, len(chunk.sizes))
        mean = pa.array(sums / np.maximum(chunk.sizes, 1), mask=chunk.sizes == 0)
        ids = chunk.pieces["ids"].combine_chunks().flatten()
        return pa.table([ids, pa.array(chunk.sizes), pa.array(sums), mean], ["doc_id", "tokens", "log_score", "mean_log_score"])

    both = chunks.groupBy("chunk").cogroup(count_answers(chunks, order, bits).groupBy("chunk"))
    return both.applyInArrow(weigh, f"doc_id {kind.simpleString()}, tokens long, log_score double, mean_log_score double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


LM_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
words AS (SELECT r, len(ws) AS size, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
grams AS (SELECT r, size, i, w AS g1,
  CASE WHEN i > 1 THEN lag(w) OVER p || ' ' || w END AS g2, CASE WHEN i > 2 THEN lag(w, 2) OVER p || ' ' || lag(w) OVER p || ' ' || w END AS g3
  FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, size, i,
  count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS c1,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) END AS c2,
  CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) END AS c3,
  (SELECT count(*) FROM words) - size AS others FROM grams),
prior AS (SELECT *, lag(c1) OVER p AS p1, lag(c2) OVER p AS p2 FROM counted WINDOW p AS (PARTITION BY r ORDER BY i)),
one AS (SELECT *, ln(greatest(c1, 1)::DOUBLE / greatest(others, 1)) AS v1 FROM prior),
two AS (SELECT *, CASE WHEN c2 >= {LEAST} THEN ln(c2::DOUBLE / p1) WHEN i > 1 THEN v1 + ln({BACKOFF}) ELSE v1 END AS v2 FROM one),
three AS (SELECT r, CASE WHEN c3 >= {LEAST} THEN ln(c3::DOUBLE / p2) WHEN i > 2 THEN v2 + ln({BACKOFF}) ELSE v2 END AS v FROM two),
sums AS (SELECT r, sum(v) AS s FROM three GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS tokens, round(coalesce(s, 0), 4) AS log_score, round(s / len(ws), 6) AS mean_log_score FROM docs LEFT JOIN sums USING (r)
"""
