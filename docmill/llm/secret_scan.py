"""Secret scans (operator 6).

Assignments of passwords and tokens, access keys and hex runs are found by their form. Beside them, a window slides
over every candidate string (a long run of key-like characters): counts of the window's characters change by one
character in and one out, and with them the sum of c*log2(c), so that the Shannon entropy of each window costs O(1).
Windows above the entropy of their character class make spans, unless an allow-list knows all that they cover.

Defined cases: null is the empty text and has no spans; every row of the input gives a row, repeated rows too, with its
id as it is, of any type; other columns of the input are not looked at; whole texts are scanned, of any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import derived, reworked, text_slices

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What an assignment may start with, in lower case: texts without any need no closer look.
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Width of the window; least entropy of a window, in bits, by character class.
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "upper": 3.4, "mixed": 3.7}
#: Harmless stretches of a candidate: identifiers of the UUID form, and digests named as such.
HARMLESS = re.compile(r"(?ai)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|sha(1|256|512)[-_=][A-Za-z0-9+/]+=*")
#: Harmless parts between separators: numbers, words in lower, upper or camel case with a few digits after them, and
#: placeholders.
PART = re.compile(r"[^/_=+-]+")
HARMLESS_PART = re.compile(r"[0-9]+|([a-z]+|[A-Z]+|[A-Za-z]?[a-z]{2,}([A-Z][a-z]+)*)[0-9]{0,4}|(?i:.*(example|placeholder|changeme|xxxx).*)")
#: c * log2(c), for counts up to the window's width
C_LOG_C = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def character_class(text: str) -> str:
    """Of the characters a secret may be drawn from, the least class that holds them all."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "upper" if re.fullmatch(r"[0-9A-Z]+", text) else "mixed"


def dense_windows(text: str, width: int = WINDOW, least: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Maximal stretches of ``text`` covered by windows whose entropy reaches the least of the text's class."""
    bits = (least or LEAST_BITS)[character_class(text)]
    counts: dict[str, int] = {}
    held, stretches = 0.0, []
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        held += C_LOG_C[c + 1] - C_LOG_C[c]
        counts[char] = c + 1
        if i >= width - 1:
            if math.log2(width) - held / width >= bits - 1e-9:
                start = i - width + 1
                if stretches and stretches[-1][1] >= start:
                    stretches[-1][1] = i + 1
                else:
                    stretches.append([start, i + 1])
            out = text[i - width + 1]
            c = counts[out]
            held += C_LOG_C[c - 1] - C_LOG_C[c]
            counts[out] = c - 1
    return [(a, b) for a, b in stretches]


def suspicious(candidate: str) -> list[tuple[int, int]]:
    """The parts between a candidate's separators that the allow-list doesn't cover; a part after ``your`` is a placeholder."""
    spared = [m.span() for m in HARMLESS.finditer(candidate)]
    out, before = [], ""
    for m in PART.finditer(candidate):
        if not (HARMLESS_PART.fullmatch(m[0]) or before == "your" or any(a <= m.start() and m.end() <= b for a, b in spared)):
            out.append(m.span())
        before = m[0].lower()
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in ``text``, by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        if dense := dense_windows(m[0]):
            parts = suspicious(m[0])
            found += [("entropy", m.start() + a, m.start() + b) for a, b in dense if any(x < b and y > a for x, y in parts)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row of ``docs``."""
    spans = "spans array<struct<kind: string, start: bigint, end: bigint>>"
    return derived(docs.select("doc_id", "text"), spans, lambda: lambda texts: [[find_secrets(x) for x in texts]])


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in a text replaced by a mark, and ``n_chars`` brought up to date; the other columns,
    and texts without secrets, as they are."""

    text, chars = (docs.columns.index(c) if c in docs.columns else None for c in ("text", "n_chars"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, f"c{text}"):
            spans = [find_secrets(x) for x in texts]
            new = [redact(t, s) if s else t for t, s in zip(texts, spans)]
            columns = batch.columns
            columns[text] = pa.array(new, columns[text].type, mask=columns[text].is_null().to_numpy(zero_copy_only=False))
            if chars is not None:
                counts = [len(y) if s else n for n, y, s in zip(columns[chars].to_pylist(), new, spans)]
                columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return reworked(docs, clean)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, a count for each of ``kinds``, base_sha256, spans) of spans; the base is those of ``kinds``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS[:3])
