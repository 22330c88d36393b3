"""Benchmark decontamination (operator 7): pigeonhole pieces, then Myers' bit-parallel distance.

A test item of m characters may occur in a document with up to m * rate edits. Cut into one piece more than that, at
least one piece occurs unchanged. An Aho-Corasick pass over the document finds pieces; each hit says where the item
would have to lie, and there, in a window wider by the budget, the item is looked for with Myers' algorithm. Before
that, windows are ruled out by the item's quadruples of characters side by side: an edit spoils one of them at most.

Texts are compared in lower case, white space as single blanks; positions are given in the text as it is.

Benchmarks are small beside the corpus. Their size is checked: items go to automata of bounded size by a hash, one for
an ordinary benchmark. The driver holds one list of items at a time: where there are more, each is a pass of its own
over the documents, whose result is written before the next list is read.

Defined cases: null is the empty text; items that are null or blank, or have no id, are not looked for; those of fewer
than ``SHORT`` characters count where they are unchanged and whole words, the text's own; every row of
the documents is searched, repeated rows too, as a whole; of several places of an item in a text the one with the
fewest edits counts, then the first; ids of any type pass
as they are; other columns of the inputs are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docmill.llm.common import kept_rows, text_slices, written

RATE = 0.1
#: Characters of the items in one automaton.
AUTOMATON = 4_000_000
#: Items of fewer characters, in normal form, have to occur as they are and between word edges, as they come up by chance.
SHORT = 16


def lowered(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def places(text: str) -> list[int]:
    """Of each character of ``normal(text)``, the position in ``text``; one more for its end."""
    at, low, out = 0, lowered(text), []
    for word in low.split():
        start = low.index(word, at)
        if out:
            out.append(at)
        at = start + len(word)
        out += range(start, at)
    return [*out, at]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of ``pattern`` to a stretch of ``text``, end of the first stretch that has it)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        across = eq | down
        eq |= ((eq & up) + up & every) ^ up
        plus, minus = (down | ~(eq | up)) & every, up & eq
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & every, minus << 1 & every
        up, down = (minus | ~(across | plus)) & every, plus & across
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Looks for test items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, n) for i, t in items if (n := normal(t))]
        self.budgets = [math.floor(len(n) * rate) if len(n) >= SHORT else 0 for _, n in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, ((_, text), budget) in enumerate(zip(self.items, self.budgets)):
            cuts = [round(p * len(text) / (budget + 1)) for p in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.quads = [[n[i : i + 4] for i in range(0, len(n) - 3, 4)] for _, n in self.items]

    def at(self, k: int, text: str, start: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of item ``k`` around ``start`` in a normal text."""
        item, budget = self.items[k][1], self.budgets[k]
        end = start + len(item)
        if len(item) < SHORT:
            inside = (start and text[start - 1 : start + 1].isalnum()) or text[end - 1 : end + 1].isalnum() and end < len(text)
            return None if inside else (0, start, end)
        if text.startswith(item, max(start, 0)) and start >= 0:
            return 0, start, end
        low, high = max(0, start - budget), start + len(item) + budget
        window = text[low:high]
        missed = 0
        for quad in self.quads[k]:
            if quad not in window:
                missed += 1
                if missed > budget:
                    return None
        edits, end = myers(item, window)
        if edits > budget:
            return None
        _, back = myers(item[::-1], window[:end][::-1])
        return edits, low + end - back, low + end

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of each item that ``text`` holds."""
        if not self.items:
            return []
        flat = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for last, (length, owners) in self.automaton.iter(flat):
            for k, offset in owners:
                start = last + 1 - length - offset
                if start in (seen := tried.setdefault(k, set())):
                    continue
                seen.add(start)
                if k in best and best[k][0] == 0:
                    continue
                if (found := self.at(k, flat, start)) and found < best.get(k, (math.inf, 0, 0)):
                    best[k] = found
        if not best:
            return []
        where = places(text)
        return sorted((self.items[k][0], where[a], where[b - 1] + 1, edits) for k, (edits, a, b) in best.items())


def item_lists(items: DataFrame) -> Iterator[list[tuple]]:
    """The items, dealt out into lists of bounded size, each for one automaton; only one is held at a time."""
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(chars / AUTOMATON)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        yield [tuple(r) for r in rows.filter(part == i).orderBy("item_id", "text").collect()]


def contamination(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for each row of ``docs`` and each item in it."""
    kind, item_kind = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start long, end long, edits int"
    kinds = [to_arrow_type(item_kind), pa.int64(), pa.int64(), pa.int32()]

    def of(part: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(part)  # at most about AUTOMATON characters

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, rate)
            for batch, texts in text_slices(batches):
                found = [(i, *x) for i, t in enumerate(texts) for x in finder.find(t)]
                if found:
                    row, *cells = zip(*found)
                    ids = batch.column(0).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cells, kinds)], ["doc_id", "item_id", "start", "end", "edits"])

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    found, before = None, None
    for part in item_lists(items):
        if before is not None:  # the list before is done with
            before = written(before, "leaks")
            found = before if found is None else found.union(before)
        before = of(part)
    if before is None:
        return docs.sparkSession.createDataFrame([], schema)
    return before if found is None else found.union(before)


def without_items(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    rows = docs
    for i, part in enumerate(item_lists(items)):
        rows = written(rows, "fair") if i else rows
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def start(sent=sent):
            finder = Finder(sent.value, rate)
            return lambda texts: [not finder.find(x) for x in texts]

        rows = kept_rows(rows, start)
    return rows


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
