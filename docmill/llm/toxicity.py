"""Toxicity (operator 3): a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine.

The kernel of two strings sums, over the character triples that both hold in order, with gaps, the decays of their
spans; a mark at the string's start counts as a character. It is normalised by both strings' lengths in feature space
and sharpened by a power, which keeps it positive definite. An insult with gaps or inserted characters keeps most of
its triples, at some decay, so it stays close to the plain one.

A document is the set of its strings: its distinct tokens (whole text; runs of single characters are also read as one
token, very long tokens through overlapping windows). The kernel of two documents is the sum of the kernels of their
strings. Landmarks are strings that labelled toxic documents hold far more often than clean ones. The Nyström features
of a document are the sums of its strings' kernels with the landmarks, whitened by the landmarks' own kernel matrix;
a linear SVM with class weights, solved by Newton steps, gives the margin.

Learning reads a bounded sample of labelled rows, ``sample`` rows (a parameter), the first by a hash of the id;
everything else covers all rows. The power, the number of landmarks, the class weights and the cost are chosen inside the rows that may be learned from:
landmarks and a trial machine come from three quarters of them, and the settings that tell both classes best on the last
quarter count. No held-out row is read for any of it.

Defined cases: null is the empty text, which gets the score of a text without any similarity; every row gives a row,
repeated rows too; labels that are null, or of rows whose id is null, are not learned from; of rows with one id the
first text is learned from; without both classes to learn from the score is the one class's label, or 0; other columns
of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import derived, held_out, kept_rows, learnable, text_slices
from docmill.llm.simhash import shingle_hashes
from docmill.session import checkpointed

SPAN = 6  # of a triple, at most
DECAY = 0.75
POWERS = (4, 6)  # to choose from
COSTS = (0.5, 5.0, 50.0)  # of the SVM, to choose from
NUMBERS = (16, 48)  # of landmarks, to choose from, the most telling first
WEIGHTS = (0.0, 0.5)  # powers of how rare a class is, to choose from
LONGEST = 24  # of a token read at once
GRAMS = (4, 5, 6, 7, 8, 9)  # lengths of strings that can be landmarks
SAMPLE = 12_000
ROWS_OF_FILE = 500  # of the sample, at least, so that many partitions don't leave a file and a cold memory of tokens each
KEEP = 200_000  # tokens that a task remembers; then it begins anew, at the price of time
CHARS = 250_000  # of texts whose tokens are held at once
TRIPLES = 100_000  # of strings that are compared at once
SINGLES = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){2,}")
STRIP = string.punctuation


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text in lower case, as written."""
    low = text.lower()
    return {*low.split(), *("".join(m[0].split()) for m in SINGLES.finditer(low))}


def pieces(token: str) -> list[str]:
    """What the kernel reads of a token: without marks around it, with and without the non-letters in it, long ones in
    overlapping windows."""
    token = token.strip(STRIP)
    read = {token, "".join(filter(str.isalpha, token))} if not token.isalpha() else {token}
    step = LONGEST // 2
    return ["^" + t[i : i + LONGEST] for t in sorted(read) if len(t) > 1 for i in range(0, max(1, len(t) - step), step)]


def with_insertions(text: str) -> str:
    """A text with a character put somewhere into every longer token, for learning what such tokens look like."""
    salt = zlib.crc32(text.encode("utf-8", "surrogatepass"))

    def put(token: str) -> str:
        if len(token) < 4:
            return token
        mix = zlib.crc32(token.encode("utf-8", "surrogatepass"), salt)
        at = 1 + mix % (len(token) - 1)
        return token[:at] + "xq*-z.j_"[mix >> 20 & 7] + token[at:]

    return " ".join(map(put, text.split()))


@functools.cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the triples in a string of ``n`` characters, and their decays."""
    places = [(i, j, k) for i in range(n) for j, k in itertools.combinations(range(i + 1, min(n, i + SPAN)), 2)]
    places = np.array(places, np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1).astype(float)


def points(strings: list[str]) -> np.ndarray:
    """Code points of strings of one length, a row each."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(strings), -1).astype(np.int64)


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, triple, weight) of the distinct triples of strings of one length; a triple is a number."""
    places, decay = triples(len(strings[0]))
    chars = points(strings)
    codes = (chars[:, places[:, 0]] << 42) | (chars[:, places[:, 1]] << 21) | chars[:, places[:, 2]]
    order = np.argsort(codes, axis=1, kind="stable")
    codes, weights = np.take_along_axis(codes, order, axis=1), decay[order]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return starts // max(1, codes.shape[1]), codes.ravel()[starts], np.add.reduceat(weights.ravel(), starts)


class Kernel:
    """Similarities of strings to landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        held: dict[int, list[tuple[int, float]]] = {}
        for j, landmark in enumerate(landmarks):
            _, codes, weights = features([landmark])
            length = np.sqrt((weights**2).sum())
            for code, weight in zip(codes.tolist(), weights.tolist()):
                held.setdefault(code, []).append((j, weight / length))
        self.codes = np.array(sorted(held), np.int64)
        self.sizes = np.array([len(held[c]) for c in self.codes.tolist()], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        pairs = [x for c in self.codes.tolist() for x in held[c]]
        self.columns = np.array([j for j, _ in pairs], np.int64)
        self.weights = np.array([w for _, w in pairs])

    def similarities(self, strings: list[str]) -> np.ndarray:
        """A row for each string, a column for each landmark."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(i)
        for n, rows in by_length.items():
            if n < 3 or not len(self.codes):
                continue
            step = max(1, TRIPLES // len(triples(n)[0]))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                row, code, weight = features([strings[i] for i in part])
                length = np.sqrt(np.bincount(row, weight**2, len(part)))
                place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = np.flatnonzero(self.codes[place] == code)
                sizes = self.sizes[place[hit]]
                inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pair = np.repeat(self.starts[place[hit]], sizes) + inner
                cell = np.repeat(row[hit], sizes) * len(self.landmarks) + self.columns[pair]
                dots = np.bincount(cell, np.repeat(weight[hit], sizes) * self.weights[pair], len(part) * len(self.landmarks))
                out[part] = dots.reshape(len(part), -1) / length[:, None]
        return out


class Pooler:
    """Sums of documents' kernels with the landmarks; keeps what it knows of tokens while a task runs. With ``weights`` of the
    landmarks it keeps one number a token and gives one column, the weighted sum."""

    def __init__(self, landmarks: list[str], powers: tuple[int, ...], keep: int = KEEP, weights: np.ndarray | None = None):
        self.kernel, self.powers, self.keep, self.weights = Kernel(landmarks), powers, keep, weights
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}  # of a token without marks around it, its row
        # room for some more than are kept: what isn't used yet takes no memory, and nothing is copied as it fills
        columns, kind = (len(self.powers) * len(self.kernel.landmarks), np.float32) if self.weights is None else (1, np.float64)
        self.values = np.empty((self.keep + self.keep // 4, columns), kind)

    def learn(self, new: list[str]) -> None:
        """The sum of the similarities of each new token's strings, raised to each power once and not wherever it occurs."""
        lists = [pieces(t) for t in new]
        places: dict[str, int] = {}
        flat = np.array([places.setdefault(s, len(places)) for of in lists for s in of], np.int64)
        near = self.kernel.similarities([*places])
        near = np.hstack([near**power for power in self.powers])
        sizes = np.array([len(of) for of in lists], np.int64)
        start = len(self.rows)
        self.rows.update(zip(new, range(start, start + len(new))))
        if len(self.rows) > len(self.values):
            grown = np.empty((2 * len(self.rows), self.values.shape[1]), self.values.dtype)
            grown[:start] = self.values[:start]
            self.values = grown
        told = self.values[start : start + len(new)]
        weighed, told = told, told if self.weights is None else np.empty((len(new), near.shape[1]), np.float32)
        told[:] = 0
        held = np.flatnonzero(sizes)
        if len(held):
            told[held] = np.add.reduceat(near[flat], (np.cumsum(sizes) - sizes)[held], axis=0)
        if self.weights is not None:
            weighed[:, 0] = told @ self.weights

    def pool(self, texts: list[str]) -> np.ndarray:
        """A row for each text: for each power, a column for each landmark, or their weighted sum."""
        if len(self.rows) > self.keep:
            self.forget()
        found = [tokens(x) for x in texts]
        read = (t.strip(STRIP) for of in found for t in of)  # tokens that differ in marks around them count each
        coded = pa.array(read, pa.string()).dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn(sorted(t for t in names if t not in self.rows))
        rows = np.fromiter((self.rows[t] for t in names), np.int64, len(names))[codes]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        order = np.lexsort((rows, owner))  # sums don't depend on the order of a set
        rows, owner = rows[order], owner[order]
        out = np.zeros((len(texts), self.values.shape[1]))
        held, starts = np.unique(owner, return_index=True)
        ends = np.append(starts[1:], len(rows))
        for at in range(0, len(held), 64):
            part = slice(at, at + 64)
            of = self.values[rows[starts[at] : ends[part][-1]]]
            out[held[part]] = np.add.reduceat(of, starts[part] - starts[at], axis=0)
        return out


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    power: int
    weights: np.ndarray  # of summed kernels; the whitening is multiplied in
    bias: float

    def scores(self, weighed: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(2 * (weighed + self.bias), -50, 50)))

    def scorer(self):
        pooler = Pooler(self.landmarks, (self.power,), weights=self.weights)
        return lambda texts: self.scores(pooler.pool(texts)[:, 0])


def one_of_copies(rows: DataFrame, sketches: int = 4) -> DataFrame:
    """The first of the sample's rows (text, toxic, trial) that share one of a few min-hashes of word triples: near copies
    go, but for one in some hundred."""
    odd = [2 * 0x9E3779B97F4A7C15 * (i + 1) + 1 for i in range(sketches)]

    def sketch(texts: list[str]) -> list:
        hashes = [np.array(shingle_hashes(x) or [0], np.uint64) for x in texts]
        return [[[int((h * np.uint64(o % 2**64)).min()) >> 1 for o in odd] for h in hashes]]

    kept = derived(rows.withColumn("copy", F.col("text")), "sketch array<bigint>", lambda: sketch)
    for i in range(sketches):
        row = F.min(F.struct("copy", "trial", "sketch")).alias("x")
        kept = kept.groupBy(F.col("sketch")[i].alias("one"), "toxic").agg(row).select("toxic", "x.*")
    return kept.select(F.col("copy").alias("text"), "toxic", "trial")


def string_counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, clean, tokens): the documents of either kind that hold a string in one of their tokens, and the
    tokens of toxic documents that hold it."""

    def sums(toxic: Counter, clean: Counter, held: Counter) -> pa.RecordBatch:
        grams = [*toxic, *(g for g in clean if g not in toxic)]
        counts = [pa.array([c[g] for g in grams], pa.int64()) for c in (toxic, clean, held)]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *counts], ["gram", "toxic", "clean", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, held = Counter(), Counter(), Counter()
        for batch, texts in text_slices(batches):
            for text, label in zip(texts, batch.column(1).to_pylist()):
                marked = [p for t in tokens(text) for p in pieces(t)]
                grams = [p[i : i + n] for p in marked for n in GRAMS for i in range(len(p) - n + 1)]
                (toxic if label else clean).update(set(grams))
                if label:
                    held.update(grams)
                if len(toxic) + len(clean) > 200_000:  # Spark adds the parts up
                    yield sums(toxic, clean, held)
                    toxic, clean, held = Counter(), Counter(), Counter()
        yield sums(toxic, clean, held)

    counted = rows.select("text", "toxic").mapInArrow(count, "gram string, toxic long, clean long, tokens long")
    return counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "tokens")])


def pick_landmarks(counts: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """Strings that toxic documents' tokens hold far more often, the most frequent first; of overlapping strings with
    about the same counts, which are parts of one word, only the first."""
    often = F.col("toxic") / n_toxic >= 5 * (F.col("clean") + 0.5) / n_clean
    purity = F.col("toxic") / (F.col("toxic") + F.col("clean") * (n_toxic / n_clean))
    best = counts.filter((F.col("toxic") >= max(3, int(n_toxic**0.5 / 2), n_toxic // 100)) & often)
    best = best.orderBy(F.desc(F.round(F.col("toxic") * purity * purity, 6)), F.desc(F.length("gram")), "gram").limit(20 * most).collect()
    picked: dict[str, int] = {}
    for r in best:
        parts = {r["gram"][i : i + 3] for i in range(len(r["gram"]) - 2)}
        alike = any(n <= 1.15 * r["tokens"] and any(x in g for x in parts) for g, n in picked.items())
        if len(picked) < most and not alike:
            picked[r["gram"]] = r["tokens"]
    return list(picked)


def train_svm(x: np.ndarray, y: np.ndarray, rare: float = 0.5, cost: float = 0.5, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge loss, classes weighted by a power of how rare they are), by Newton
    steps over the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    costs = cost * (len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))) ** rare
    value = lambda w: w @ w / 2 + costs @ np.maximum(1 - y * (x @ w), 0) ** 2
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        part = x[inside] * costs[inside, None]
        step = np.linalg.solve(np.eye(len(w)) + 2 * part.T @ x[inside], 2 * part.T @ y[inside]) - w
        size = next((s for s in 0.5 ** np.arange(20) if value(w + s * step) < value(w)), 0.0)
        w = w + size * step
        if size * np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def whitening(landmarks: list[str], power: int) -> np.ndarray:
    """The inverse square root of the landmarks' kernel matrix, without directions it hardly has (Nyström)."""
    kernel = Kernel(landmarks).similarities(landmarks).astype(float) ** power
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    use = values > 1e-4 * values.max()
    return vectors[:, use] @ np.diag(values[use] ** -0.5) @ vectors[:, use].T


def merit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Mean of the shares of both classes that are told right, then the logistic loss, negative."""
    right = [(c * margins[y == c] > 0).mean() for c in (-1, 1)]
    return float(np.mean(right)), -float(np.logaddexp(0, -2 * y * margins).mean())


def pooled(rows: DataFrame, landmarks: list[str]) -> DataFrame:
    """(toxic, trial, x) for the rows (text, toxic, trial) and for each of them with insertions: sums for all powers."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(landmarks, POWERS, KEEP // len(POWERS))  # as many numbers as a scorer keeps
        for batch, texts in text_slices(batches, chars=CHARS):
            for read in (texts, [*map(with_insertions, texts)]):
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(pooler.pool(read).tolist(), pa.list_(pa.float64()))], ["toxic", "trial", "x"])

    return rows.select("text", "toxic", "trial").mapInArrow(pool, "toxic int, trial boolean, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = max(NUMBERS)) -> Model:
    """A model from the labelled rows that may be learned from, ``sample`` of them at most, a third of them toxic."""
    usable = labels.filter(learnable(F.col("doc_id")) & F.col("toxic").isNotNull())
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = lambda toxic, n: usable.filter(F.col("toxic") == toxic).orderBy(*first).limit(n)
    chosen = part(1, sample // 3).union(part(0, sample - sample // 3))
    chosen = chosen.withColumn("trial", F.crc32(F.col("doc_id").cast("string")) % 5 == 4)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` short rows
    rows = met.groupBy("doc_id", "toxic", "trial").agg(F.min("text").alias("text")).select("text", "toxic", "trial")
    rows = checkpointed(one_of_copies(rows).coalesce(1 + sample // ROWS_OF_FILE))
    known = rows.filter(~F.col("trial"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model([], 1, np.zeros(0), 25.0 if rows.filter("toxic = 1").head(1) and not rows.filter("toxic = 0").head(1) else -25.0)
    landmarks = pick_landmarks(string_counts(known), sizes[1], sizes[0], most)
    if not landmarks:
        return Model([], 1, np.zeros(0), -25.0)
    found = pooled(rows, landmarks).toArrow()  # 2 * ``sample`` rows at most, a number for each landmark and power
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(found), len(POWERS), -1)
    y, trial = np.where(found["toxic"].to_numpy() > 0, 1.0, -1.0), found["trial"].to_numpy()
    order = np.lexsort(np.column_stack([x[:, 0], y]).T)  # the rows' order doesn't matter
    x, y, trial = x[order], y[order], trial[order]
    choices = list(itertools.product(range(len(POWERS)), NUMBERS, WEIGHTS, COSTS))

    def fitted(choice: tuple, rows: np.ndarray) -> tuple[np.ndarray, float]:
        k, n, rare, cost = choice
        whiten = whitening(landmarks[:n], POWERS[k])
        weights, bias = train_svm(x[rows, k, :n] @ whiten, y[rows], rare, cost)
        return whiten @ weights, bias

    def tried(choice: tuple) -> tuple[float, float]:
        weights, bias = fitted(choice, ~trial)
        return merit(x[trial, choice[0], : choice[1]] @ weights + bias, y[trial])

    both = len(set(y[trial])) > 1 and len(set(y[~trial])) > 1
    best = max(choices, key=tried) if both else choices[0]
    weights, bias = fitted(best, np.full(len(y), True))
    k, n = best[:2]
    return Model(landmarks[:n], POWERS[k], weights, bias)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; the score is from 0 to 1."""
    return derived(docs.select("doc_id", "text"), "score double", lambda: (lambda score: lambda texts: [score(texts)])(model.scorer()), chars=CHARS)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is under one half, with all their columns."""
    return kept_rows(docs, lambda: (lambda score: lambda texts: (score(texts) < 0.5).tolist())(model.scorer()), chars=CHARS)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
