"""Embeddings by hashed character n-grams, exactly as existing vector tables have them (BLAKE2b, Arrow batches), and
any other model as a function from texts to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hash_vectors(texts: list[str], dims: int = 1024) -> np.ndarray:
    """A unit vector for each text: marked characters, pairs and triples, longer features weighing more."""
    out = np.zeros((len(texts), dims))
    known: dict[str, int] = {}
    for row, text in zip(out, texts):
        flat = "".join((text or "").split()).lower()
        grams = ["#" + c for c in flat] + [flat[i : i + n] for n in (2, 3) for i in range(len(flat) - n + 1)]
        for g in grams:
            if g not in known:
                known[g] = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=4).digest(), "big") % dims
            row[known[g]] += 1 + 0.3 * (len(g) - 1)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


def embedded(rows: DataFrame, key: str, model: Callable[[list[str]], np.ndarray] = hash_vectors, batch: int = 256) -> DataFrame:
    """(key, embedding) of ``rows`` (key, text) by a model that maps texts to vectors, some at a time."""

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                texts = [t if isinstance(t, str) else "" for t in part["text"].tolist()]
                yield pd.DataFrame({key: part[key].values, "embedding": [*model(texts)]})

    return rows.select(key, "text").mapInPandas(embed, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")
