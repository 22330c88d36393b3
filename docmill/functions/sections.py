"""Sections and chunks of documents: one row to many, small Python per document behind Arrow."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions.text import strip

HEADING = re.compile(r"^#{1,4}\s*(?P<title>.+?)\s*$", re.M)
BARE = re.compile(r"^\s*(?P<title>" + "|".join(sorted(rules.SECTION_NAMES, key=len, reverse=True)) + r")\s*$", re.M)
#: Where a chunk may end, and how much is kept after such a place.
BREAKS, KEPT = ("\n\n", "\n", "。", "；", "！", "？", ". "), 2


def sections_of(text: str) -> list[tuple[str, str]]:
    """(title, body) of each section with a body; headings count before bare section names."""
    heads = [*HEADING.finditer(text)] or [*BARE.finditer(text)]
    edges = [(0, 0, "")] + [(m.start(), m.end(), m["title"].strip()) for m in heads] + [(len(text), len(text), "")]
    found = [(title, text[end:to].strip()) for (_, end, title), (to, _, _) in zip(edges, edges[1:])]
    return [x for x in found if x[1]] if heads and any(b for _, b in found) else [("", text)]


def spans_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows, each but the last ended at its last break in the second half."""
    at, n = 0, len(text)
    while at < n:
        to = min(at + size, n)
        if to < n and (cut := max(text.rfind(b, at + size // 2, to) for b in BREAKS)) >= 0:
            to = cut + KEPT
        yield at, to
        if to >= n:
            return
        at = max(to - overlap, at + 1)


def chunks_of(text: str, size: int = rules.DEFAULTS.chunk_size, overlap: int = rules.DEFAULTS.chunk_overlap) -> list[str]:
    if len(text) <= size:
        return [text]
    return [c for a, b in spans_of(text, size, overlap) if (c := text[a:b].strip())]


def chunk_spans(docs: DataFrame, key: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, n, start, stop) of each chunk before it is stripped."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, a, b) for k, t in zip(f[key].tolist(), f["text"].tolist()) if isinstance(t, str) for n, (a, b) in enumerate([(0, len(t))] if len(t) <= size else spans_of(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "n", "start", "stop"]).astype({"n": "int64", "start": "int64", "stop": "int64"})

    return docs.select(key, "text").mapInPandas(cut, f"{key} {docs.schema[key].dataType.simpleString()}, n long, start long, stop long")


def plain_chunks(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """As ``build_chunks``, but of whole texts: no sections, no names before them."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t or "", size, overlap))

    rows = docs.select("doc_id", "doc_name", F.posexplode(F.filter(cut("text"), lambda x: x != "")).alias("chunk_index", "text"))
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return rows.select("doc_id", "doc_name", name.alias("chunk_id"), "chunk_index", F.lit("").alias("section"), "text")


def sectioned(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, section, body) for each section of ``docs``."""

    @F.pandas_udf("array<struct<section: string, body: string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"section": s, "body": b} for s, b in sections_of(t or "")])

    return docs.select(key, F.posexplode(split("text")).alias("n", "x")).select(key, "n", "x.section", "x.body")


#: Column heads of a table of laws; two of them make a chunk one of that section.
BASIS_MARKS, BASIS = ["依据文号", "法律法规名称", "条款号", "颁布机关"], "实施依据"


def corrected_section(section: Column, chunk: Column) -> Column:
    marks = F.size(F.filter(F.array(*map(F.lit, BASIS_MARKS)), lambda m: F.contains(chunk, m)))
    return F.when(~section.isin(rules.BASIS_SECTIONS) & (marks >= 2), F.lit(BASIS)).otherwise(section)


def _laid_out(docs: DataFrame, pieces: Callable, section: Column) -> DataFrame:
    """(doc_id, doc_name, chunk_id, chunk_index, section, text) of ``docs`` (doc_id, doc_name, text): what ``pieces`` makes of
    each text, with its document's and section's name before it. A document is cut where it is, without a shuffle."""
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = docs.filter(strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", "doc_name", F.posexplode(pieces("text")).alias("chunk_index", "x"))
    rows = rows.select("doc_id", "doc_name", "chunk_index", "x.section", "x.chunk").withColumn("section", section)
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id")
    return rows.select("doc_id", "doc_name", name, "chunk_index", "section", F.concat_ws("\n", none("doc_name"), none("section"), "chunk").alias("text"))


def build_chunks(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """(doc_id, doc_name, chunk_id, chunk_index, section, text) of cleaned ``docs`` (doc_id, doc_name, text): sections,
    corrected by content, in overlapping chunks, each with its document's and section's name before it."""

    @F.pandas_udf("array<struct<section: string, chunk: string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"section": s, "chunk": c} for s, b in sections_of(t) for c in chunks_of(b, size, overlap)])

    return _laid_out(docs, pieces, corrected_section(F.col("section"), F.col("chunk")))


#: Where a text is cut, the first separator that it has; the last cuts anywhere.
SEPARATORS = ["\n\n", "\n", "。", "；", "！", "？", "，", " ", ""]


def recursive_pieces(text: str, size: int = 500, overlap: int = 100, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters where separators allow it, cut at the first separator that a text has, and
    only what is still too long at the ones after it. Parts begin with their separator; neighbours are merged up to the
    size, and a new piece begins with as many of the parts before as fit in ``overlap``."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark = separators[at]
    first, *rest = re.split(f"({re.escape(mark)})", text) if mark else [""]
    parts = [p for p in [first, *(a + b for a, b in zip(rest[::2], rest[1::2]))] if p] if mark else list(text)
    out: list[str] = []
    run: list[str] = []
    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        out += merged(run, size, overlap)
        run = []
        out += recursive_pieces(part, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    return out + merged(run, size, overlap)


def merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to ``size`` characters, pieces sharing up to ``overlap`` at their edges."""
    out, held, total = [], deque(), 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    out.append("".join(held).strip())
    return [p for p in out if p]


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Chunks by ``recursive_pieces``; sections stay as their headings say."""

    @F.pandas_udf("array<struct<section: string, chunk: string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"section": s, "chunk": c} for s, b in sections_of(t) for c in recursive_pieces(b, size, overlap)])

    return _laid_out(docs, pieces, F.col("section"))


# Words that tell a section by its content, with their weights.
HINTS = {
    "材料清单": {"原件": 2, "复印件": 2, "纸质": 1, "电子化": 1, "免提交": 2, "空白表格": 2, "示例样本": 2, "材料类型": 2, "材料形式": 1, "填报须知": 1, "来源渠道": 1},
    "实施依据": {"法律法规名称": 3, "依据文号": 3, "条款号": 3, "颁布机关": 3, "实施日期": 2, "条款内容": 2, "设定依据": 2},
    "办理流程": {"网上办理流程": 2, "线下办理流程": 2, "窗口办理": 2, "网上办理": 1, "现场办理": 1, "受理": 1, "审查": 1, "决定": 1},
    "收费信息": {"收费项目信息": 3, "不收费": 3, "收费标准": 3, "收费依据": 2, "元/": 2},
    "咨询方式": {"咨询方式与监督方式": 3, "咨询方式": 2, "监督方式": 2, "投诉": 1, "办理地点：": 2},
    "受理条件": {"受理条件": 2, "申请条件": 2, "符合下列": 2, "受理范围": 2},
    "基础信息": {"事项名称": 3, "事项类型": 2, "承诺办结时限": 3, "法定办结时限": 2, "实施主体": 2, "日常用语": 2, "到办事现场次数": 2},
    "审批信息": {"行使层级": 3, "权力来源": 2, "审批服务形式": 2, "联办机构": 2, "业务系统": 1, "委托部门": 1},
}
ALIASES = {"收费项目信息": "收费信息", "收费标准": "收费信息", "咨询方式与监督方式": "咨询方式"}


def hinted_section(text: Column, least: int = rules.DEFAULTS.hint_least) -> Column:
    """The section whose words weigh most in a text, the first of equals; null under a least weight."""
    scored = []
    for i, (name, hints) in enumerate(HINTS.items()):
        pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in hints.items()])
        score = F.aggregate(pairs, F.lit(0), lambda a, p: a + F.when(F.contains(text, p["w"]), p["x"]).otherwise(0))
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] >= least, best["name"])


def normal_section(section: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[section], section)


def last_heading(text: Column) -> Column:
    """The last line of a text that is a section's name, under its usual name; null without any."""
    lines = F.transform(F.split(text, "\n"), strip)
    names = F.filter(lines, lambda x: x.isin([*rules.SECTION_NAMES, *ALIASES]))
    return normal_section(F.try_element_at(names, F.lit(-1)))


def inherited_sections(chunks: DataFrame, none: str = "正文") -> DataFrame:
    """Chunks (doc_id, chunk_index, section), null sections replaced by the last one before in their document."""
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(before), F.lit(none)))
