"""The best entry of a knowledge table for each text, by the keywords that occur in it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Characters of the keywords that one automaton holds.
CHARS = 4_000_000


def _best(entries: Broadcast, kind: StructType) -> Column:
    @F.pandas_udf(kind)
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        owners: dict[str, list[int]] = {}
        for i, (_, words) in enumerate(entries.value):
            for w in words:
                owners.setdefault(w, []).append(i)
        automaton = ahocorasick.Automaton()
        for w, held in owners.items():
            automaton.add_word(w, w)
        if owners:
            automaton.make_automaton()
        for batch in texts:
            less, names = [], []
            for text in batch:
                scores: dict[int, int] = {}
                for w in {w for _, w in automaton.iter(text)} if owners and text else ():
                    for i in owners[w]:
                        scores[i] = scores.get(i, 0) + len(w)
                found = min(((-s, i) for i, s in scores.items()), default=(0, None))
                less.append(found[0])
                names.append(None if found[1] is None else entries.value[found[1]][0])
            yield pd.DataFrame({"less": pd.Series(less, dtype="int64"), "entry": pd.Series(names, dtype=object)})

    return best


def best_entries(texts: DataFrame, keywords: DataFrame, chars: int = CHARS) -> DataFrame:
    """``texts`` (with a column text) with the entry whose ``keywords`` (entry, keyword) weigh most in each, and its score:
    the summed length of the keywords that occur in the text, each once for each time it is listed. Of equals the first
    entry counts; null and 0 without any.

    Keywords may be any number: entries are dealt into automata of bounded size, all of which read a text in one pass,
    without a shuffle of texts.
    """
    spark = texts.sparkSession
    listed = keywords.filter("entry is not null and keyword <> ''").groupBy("entry").agg(F.collect_list("keyword").alias("words"), F.sum(F.length("keyword")).alias("chars"))
    blocks = max(1, math.ceil((listed.agg(F.sum("chars")).first()[0] or 0) / chars))
    part = F.pmod(F.xxhash64("entry"), F.lit(blocks))
    kind = StructType([StructField("less", LongType()), StructField("entry", keywords.schema["entry"].dataType)])
    found = []
    for i in range(blocks):
        rows = [(r["entry"], r["words"]) for r in listed.filter(part == i).orderBy("entry").collect()]  # some ``chars`` characters
        found.append(_best(spark.sparkContext.broadcast(rows), kind)(F.trim("text")))
    best = F.array_min(F.array(*found))
    rows = texts.withColumn("_best", best)
    return rows.select(*texts.columns, F.when(F.col("_best.less") < 0, F.col("_best.entry")).alias("entry"), (-F.col("_best.less")).alias("score"))
