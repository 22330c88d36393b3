"""Language identification with hyperdimensional profiles (operator 2).

Every letter has a random vector of +1 and -1, made from its code point alone. A letter and its two neighbours (a
non-letter counts as a blank) are bound into a trigram vector: the product of their vectors, permuted by two, one and
no places. Documents and languages are bundles, sums of their trigrams' vectors; a document gets the language whose
prototype has the largest cosine with it. Bundles are linear, so tasks add up what they read to one vector for each
language, and Spark adds those; only languages x dimensions numbers come to the driver.

Defined cases: a null text, or one without letters, gets ``und`` and score 0, and so does everything if nothing can be
learned from; rows with a null id are scored but not learned from; equal cosines go to the smaller language name;
every row of the input gives a row, with its id as it is, of any type; other columns of the input are not looked at;
whole texts count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import derived, held_out, learnable, text_slices

DIMENSIONS = 1024
UNKNOWN = "und"
#: Trigrams whose vectors are held at once: texts of many letters have many.
BLOCK = 8192


def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """Of a code point; code point 0 stands for the blank."""
    return np.random.default_rng([7, letter]).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


class Bundler:
    """Turns texts into bundles; keeps the letters' vectors of a worker."""

    def __init__(self, dimensions: int):
        self.dimensions, self.letters = dimensions, {}

    def vectors(self, letters: np.ndarray) -> np.ndarray:
        for x in letters.tolist():
            if x not in self.letters:
                self.letters[x] = letter_vector(x, self.dimensions)
        return np.stack([self.letters[x] for x in letters.tolist()])

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, trigram) index of every letter, the trigrams that occur as rows of three letters' numbers, and the
        letters' vectors, by number; the blank is 0."""
        low = [x.lower() for x in texts]
        points = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.flatnonzero(np.bincount(points))
        seen = np.array([x for x in seen.tolist() if chr(x).isalpha()], np.int64)
        ids = np.zeros(int(points.max()) + 1, np.int64)
        ids[seen] = np.arange(1, len(seen) + 1)
        ids = ids[points]
        at = np.flatnonzero(ids)
        n = len(seen) + 1
        codes = (ids[at - 1] * n + ids[at]) * n + ids[at + 1]
        if n**3 <= 1 << 22:
            grams = np.flatnonzero(np.bincount(codes, minlength=n**3))
            place = np.zeros(n**3, np.int64)
            place[grams] = np.arange(len(grams))
            codes = place[codes]
        else:
            grams, codes = np.unique(codes, return_inverse=True)
        starts = np.cumsum([1, *(len(x) + 1 for x in low)])
        letters = np.stack([grams // (n * n), grams // n % n, grams % n])
        return np.searchsorted(starts, at, side="right") - 1, codes, letters, self.vectors(np.concatenate([[0], seen]))

    def bundles(self, texts: list[str], groups: np.ndarray | None = None) -> np.ndarray:
        """A row for each text, or for each of the groups that texts are given to."""
        text, gram, letters, base = self.trigrams(texts)
        groups = np.arange(len(texts)) if groups is None else groups
        rows, width = int(groups.max(initial=-1)) + 1, letters.shape[1]
        row, out = groups[text], np.zeros((rows, self.dimensions), np.float32)
        if width > BLOCK:
            order = np.argsort(gram, kind="stable")
            row, gram = row[order], gram[order]
        twice, once = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        for at in range(0, width, BLOCK):
            a, b, c = letters[:, at : at + BLOCK]
            bound = (twice[a] * once[b] * base[c]).astype(np.float32)
            low, high = (0, len(gram)) if width <= BLOCK else np.searchsorted(gram, [at, at + BLOCK])
            counts = np.bincount(row[low:high] * len(a) + gram[low:high] - at, minlength=rows * len(a)).reshape(rows, len(a))
            out += counts.astype(np.float32) @ bound
        return out


def learn_prototypes(docs: DataFrame, which: Column, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language over the rows that ``which`` picks, all of them, whole texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dimensions), {}
        for rows, texts in text_slices(batches):
            langs = rows.column(1).to_pylist()
            names = sorted(set(langs))
            for name, bundle in zip(names, bundler.bundles(texts, np.array([names.index(x) for x in langs])).astype(np.float64)):
                sums[name] = sums.get(name, 0) + bundle
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()])], ["lang", "bundle"])

    rows = docs.filter(which & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = rows.mapInArrow(add, "lang string, bundle array<double>").select("lang", F.posexplode("bundle"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("bundle"))
    return {r["lang"]: np.array([x["x"] for x in r["bundle"]]) for r in whole.collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; score is the cosine, 0 if negative."""
    names = sorted(n for n, x in prototypes.items() if np.any(x))
    units = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else np.zeros((0, dimensions))

    def start() -> Callable[[list[str]], list]:
        bundler = Bundler(dimensions)

        def predict(texts: list[str]) -> list:
            bundles = bundler.bundles(texts).astype(np.float64)
            length = np.linalg.norm(bundles, axis=1)
            known = (length > 0) & bool(names)
            cosines = bundles @ units.T / np.maximum(length, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
            best = cosines.argmax(axis=1)
            score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
            return [[names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())], score]

        return predict

    return derived(docs.select("doc_id", "text"), "lang_pred string, score double", start)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn_prototypes(docs, learnable(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
