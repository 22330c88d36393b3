"""Grouping of spelling variants (operator 13): full neighbourhoods, hash-joined to the vocabulary.

Words are counted in tasks first, then over all documents. For each word of the vocabulary all its distinct deletions,
replacements and insertions over the observed alphabet are emitted, as hashes: a polynomial over a word's code points
makes each of them out of the sums before and after the edit, so that none is spelled out. A candidate whose hash is in
the vocabulary and which is spelled as the word found there is a near word; nothing is left to measure.

The join is partitioned so that no candidate is shuffled. An edit at one of the first ``AFFIX`` places leaves all code
points after them alone, any other edit leaves the first ``AFFIX`` alone. So words go twice to bins, by what they begin
with, for edits behind that, and by their last code points, for edits in front; a candidate's words are always in its
own bin. Many beginnings share a bin of some ``BIN`` words. One that is too frequent for a bin gets several: each holds
a part of its words as the table to be looked up, and all its words pass by as a stream. A task holds the table of one
bin and a block of candidates, and gives for each word how many near words it found and the best of them, so pairs
aren't written out either.

Defined cases: null texts have no runs; a null id deletes nothing; repeated rows are counted as often as they come; an
empty table gives an empty result; equal counts go by code-point order; words of any length are whole; other columns of
the input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import text_slices, written
from docmill.session import checkpointed

#: Code points of a word, at least, and occurrences.
SHORTEST = 7
LEAST = 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: One run of so many loses a code point.
ERRORS = 31
#: Code points at a word's beginning that part the two kinds of edits.
AFFIX = 3
#: Words of a bin's table, about; rows that a task counts before it hands them on; candidates at a time.
BIN = 100_000
HELD = 400_000
BLOCK = 1 << 18
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, shortest: int = SHORTEST, errors: int = ERRORS, held: int = HELD) -> DataFrame:
    """(word, n) of all words of ``shortest`` code points or more, with the errors that ``errors`` makes."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")  # maximal ones, as they are found greedily from the left

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch, texts in text_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes know no case beyond A-Z
                    if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % errors == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < shortest:
                            continue
                    counts[run] += n
            if len(counts) >= held:
                yield table(counts)
                counts = Counter()
        yield table(counts)

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Words as code points, one after another, with the polynomial hash of each and of all its beginnings."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.of = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.of)) - self.starts[self.of]
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(self.size.max(initial=0)) + 1, BASE, np.uint64))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.codes * self.power[self.place], dtype=np.uint64)])
        self.before = sums[:-1] - sums[self.starts[self.of]]  # of the code points before each place
        self.hash = sums[self.ends] - sums[self.starts]


class Candidates:
    """A block of candidates, a row for each place of a word and a column for each code point: hashes, and which count."""

    def __init__(self, kind: str, hashes: np.ndarray, use: np.ndarray, of: np.ndarray, place: np.ndarray, letters: np.ndarray | None = None):
        self.kind, self.hashes, self.use, self.of, self.place, self.letters = kind, hashes, use, of, place, letters

    def spelled(self, words: list[str], row: int, column: int) -> str:
        word, place = words[self.of[row]], self.place[row]
        if self.kind == "delete":
            return word[:place] + word[place + 1 :]
        return word[:place] + chr(self.letters[column]) + word[place + (self.kind == "replace") :]


def neighbours(words: Words, alphabet: np.ndarray, front: bool, affix: int = AFFIX) -> Iterator[Candidates]:
    """All distinct words that are one edit away from each word, at one of its first ``affix`` places (``front``) or
    behind them. Of edits that give one word, as in a run of one code point, the first counts."""
    base, back = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    letters = alphabet.astype(np.uint64)[None, :]
    step = max(1, BLOCK // max(1, len(alphabet)))
    places = np.flatnonzero((words.place < affix) == front)
    for at in range(0, len(places), step):
        part = places[at : at + step]
        of, place, code, before = words.of[part], words.place[part], words.codes[part][:, None], words.before[part][:, None]
        whole, here = words.hash[of][:, None], code * words.power[place][:, None]
        after = whole - before - here
        previous = np.where(place == 0, np.uint64(0), words.codes[part - 1])[:, None]  # no word has a code point 0
        gain = letters * words.power[place][:, None]
        yield Candidates("delete", before + after * back, previous != code, of, place)
        yield Candidates("replace", whole - here + gain, letters != code, of, place, alphabet)
        yield Candidates("insert", before + (here + after) * base + gain, letters != previous, of, place, alphabet)
    for at in range(0, 0 if front else len(words.words), step):  # behind the last place
        of = np.arange(at, min(at + step, len(words.words)))
        hashes = words.hash[of][:, None] + letters * words.power[words.size[of]][:, None]
        yield Candidates("insert", hashes, letters != words.codes[words.ends[of] - 1][:, None], of, words.size[of], alphabet)


class Table:
    """Words to be looked up by their hashes; a bitmap, 64 times as large, keeps most candidates from being searched for."""

    def __init__(self, words: list[str], counts: np.ndarray):
        hashes = Words(words).hash
        order = np.argsort(hashes, kind="stable")
        self.words, self.counts, self.hash = [words[i] for i in order], counts[order], hashes[order]
        self.shift = np.uint64(64 - max(6, (len(words) * 64 - 1).bit_length()))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[self.bit(self.hash)] = True
        self.alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)).astype(np.int64)

    def bit(self, hashes: np.ndarray) -> np.ndarray:
        return hashes * np.uint64(0xD6E8FEB86659FD93) >> self.shift

    def near(self, asked: list[str], front: bool, affix: int = AFFIX) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """For each word that is asked for: its near words in the table, the largest of their counts, and the first of
        them in code-point order that has it."""
        number, most, best = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), [None] * len(asked)
        for block in neighbours(Words(asked), self.alphabet, front, affix):
            row, column = np.nonzero(self.map[self.bit(block.hashes)] & block.use)
            hashes = block.hashes[row, column]
            at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            same = self.hash[at] == hashes
            for r, c, k in zip(row[same].tolist(), column[same].tolist(), at[same].tolist()):
                word, h, i = block.spelled(asked, r, c), self.hash[k], block.of[r]
                while k < len(self.words) and self.hash[k] == h and self.words[k] != word:  # words of one hash
                    k += 1
                if k < len(self.words) and self.words[k] == word:
                    number[i] += 1
                    n = self.counts[k]
                    if n > most[i] or (n == most[i] and word < best[i]):
                        most[i], best[i] = n, word
        return number, most, best


def binned(words: DataFrame, total: int, size: int, shortest: int = SHORTEST, affix: int = AFFIX) -> DataFrame:
    """(bin, front, asks, word, n): ``words`` as tables (asks: false) and as what is asked for, for both kinds of edits."""
    keys = F.array(
        F.struct(F.lit(False).alias("front"), F.substring("word", 1, affix).alias("key")),
        F.struct(F.lit(True).alias("front"), F.substring("word", affix - shortest, shortest - affix).alias("key")),
    )
    rows = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")
    large = rows.groupBy("front", "key").agg(F.count("*").alias("size")).filter(F.col("size") * 4 > size)  # 8 * total / size at most
    large = large.select("front", "key", F.ceil(F.col("size") / size).cast("int").alias("parts"), F.lit(True).alias("own"))
    shared = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // size)))).cast("string")
    rows = rows.join(F.broadcast(large), ["front", "key"], "left")
    name = F.when(F.col("own"), F.col("key")).otherwise(shared).alias("name")
    rows = rows.select("front", "word", "n", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("own", F.lit(False)).alias("own"), name)
    of = lambda i: F.concat_ws(":", "front", "own", "name", i)
    table = rows.select(of(F.pmod(F.xxhash64("word"), F.col("parts"))).alias("bin"), "front", F.lit(False).alias("asks"), "word", "n")
    asked = rows.select("front", "own", "name", "word", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return table.union(asked.select(of(F.col("part")).alias("bin"), "front", F.lit(True).alias("asks"), "word", "n"))


def near_words(words: DataFrame, size: int = BIN, shortest: int = SHORTEST, affix: int = AFFIX) -> DataFrame:
    """(word, n, n_near, most, near) for each of ``words`` (word, n): the number of near words, and of those with the
    largest count, ``most``, the first; null without any."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_, table, words, counts = None, None, [], []
        for batch in batches:
            names, asks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1] or asks[i] != asks[i - 1]]
            for a, b in zip(edges, [*edges[1:], len(names)]):
                if names[a] != bin_:
                    bin_, table, words, counts = names[a], None, [], []
                part = batch.slice(a, b - a)
                if not asks[a]:  # a bin's table comes before what is asked of it
                    words += part.column(3).to_pylist()
                    counts.append(part.column(4).to_numpy())
                    continue
                if table is None and words:
                    table, words, counts = Table(words, np.concatenate(counts)), [], []
                if table is None:
                    continue
                number, most, best = table.near(part.column(3).to_pylist(), part.column(1)[0].as_py(), affix)
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(number), pa.array(most), pa.array(best, pa.string())], ["word", "n", "n_near", "most", "near"])

    dealt = binned(words, words.count(), size, shortest, affix).repartition("bin").sortWithinPartitions("bin", "asks")
    found = dealt.mapInArrow(look, "word string, n long, n_near long, most long, near string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("near").alias("near"))).alias("best")
    every = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    return every.select("word", "n", "n_near", F.when(F.col("n_near") > 0, -F.col("best.less")).alias("most"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): where the forms' chain ends. Steps are doubled each time."""
    at = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("_root"), F.col("root").alias("_next"))
        further = at.join(on, at["root"] == on["_root"], "left")
        at = checkpointed(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, errors: int = ERRORS, size: int = BIN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``shortest`` code points and ``least`` occurrences."""
    words = written(word_counts(docs, shortest, errors).filter(F.col("n") >= least), "words")
    near = written(near_words(words, size, shortest), "near-words")
    formed = F.coalesce(F.col("most") >= ratio * F.col("n"), F.lit(False))
    rows = near.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("most")).alias("form_n"))
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SPELLING_SQL = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY i) AS crcs
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
runs AS (
  SELECT doc_id, run, count(*)::BIGINT AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE len(run) >= 7 GROUP BY doc_id, run),
summed AS (
  SELECT run, n,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT)),
                         lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs), crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM summed)
  WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT DISTINCT word, place, word[1:place - 1] || word[place + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS place FROM words)),
near AS (
  SELECT c.word, w.word AS other FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word),
best AS (
  SELECT near.word, count(*)::BIGINT AS n_near, max(w.n) AS most, arg_min(near.other, (-w.n, near.other)) AS other
  FROM near JOIN words w ON near.other = w.word GROUP BY near.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN other END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.at = formed.word WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, chain.at AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chain USING (word) JOIN formed ended ON ended.word = chain.at AND ended.form IS NULL
"""
