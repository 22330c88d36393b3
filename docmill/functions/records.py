"""Small records: material lists from models and users, file names, settings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docmill.functions.text import strip

#: Names under which a record's lists and texts come.
ALIASES = {
    "required": ["required", "必备材料", "materials", "材料清单"],
    "optional": ["optional", "可选材料"],
    "steps": ["steps", "办理流程", "process"],
    "tips": ["tips", "温馨提示", "notes"],
    "department": ["department", "受理部门"],
    "legal_time": ["legal_time", "承诺时限", "办理时限"],
    "fee": ["fee", "收费标准"],
    "channel": ["channel", "办理渠道"],
}


def bullets(text: Column) -> Column:
    """Lines of a list without their bullets and numbers."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•·]|\d+[.、)])\s*", "")))
    return F.filter(lines, lambda x: x != "")


# The fields of a record by kind, as its schema has them.
TEXTS, ITEMS, LISTS = ["title", "department", "legal_time", "fee", "channel"], ["required", "optional"], ["steps", "tips"]
ITEM = "array<struct<name: string, desc: string, count: string>>"
RECORD = ", ".join([*(f"{f}: string" for f in TEXTS), *(f"{f}: {ITEM}" for f in ITEMS), *(f"{f}: array<string>" for f in LISTS)])


def _of(value: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{field}", kind)


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def valid_record(value: Column, skipped: tuple[str, ...] = ()) -> Column:
    """Whether a variant is a record: fields may lack, but those that are there have their kind (null is none)."""
    lacks = lambda f: _of(value, f).isNull()
    text = lambda x, f, needed: (F.lit(not needed) & _of(x, f).isNull()) | F.coalesce(_is(_of(x, f), "STRING"), F.lit(False))
    item = lambda x: _is(x, "OBJECT") & text(x, "name", True) & text(x, "desc", False) & text(x, "count", False)
    each = lambda f, fine: lacks(f) | (_is(_of(value, f), "ARRAY") & F.coalesce(F.forall(_of(value, f, "array<variant>"), fine), F.lit(False)))
    fine = [text(value, f, False) for f in TEXTS] + [each(f, item) for f in ITEMS if f not in skipped] + [each(f, lambda x: _is(x, "STRING")) for f in LISTS]
    out = F.coalesce(_is(value, "OBJECT"), F.lit(False))
    for x in fine:
        out = out & F.coalesce(x, F.lit(False))
    return out


def record_of(raw: Column, found: Column) -> Column:
    """The record in a generated one (JSON text), completed by what was ``found`` (of the same fields; null without any).

    Without a generated record, or with an empty one, it is what was found. If it requires nothing, required items are
    the found ones, and optional ones too where it has none. Null if it isn't valid then.
    """
    value = F.try_parse_json(raw)
    given = F.from_json(raw, f"struct<{RECORD}>")
    some = F.coalesce(_is(value, "OBJECT") & (F.schema_of_variant(value) != "OBJECT<>"), F.lit(False))
    empty = lambda f: _of(value, f).isNull() | F.is_variant_null(_of(value, f)) | F.coalesce(F.size(_of(value, f, "array<variant>")) == 0, F.lit(False))
    filled = empty("required") & F.coalesce(F.size(found["required"]) > 0, F.lit(False))
    also = filled & empty("optional") & F.coalesce(F.size(found["optional"]) > 0, F.lit(False))
    fine = F.when(also, valid_record(value, ("required", "optional"))).when(filled, valid_record(value, ("required",))).otherwise(valid_record(value))
    items = lambda c: F.transform(F.coalesce(c, F.array().cast(ITEM)), lambda x: F.struct(x["name"].alias("name"), *[F.coalesce(x[f], F.lit("")).alias(f) for f in ("desc", "count")]))
    merged = F.struct(
        *[F.coalesce(given[f], F.lit("")).alias(f) for f in TEXTS],
        items(F.when(filled, found["required"]).otherwise(given["required"])).alias("required"),
        items(F.when(also, found["optional"]).otherwise(given["optional"])).alias("optional"),
        *[F.coalesce(given[f], F.array().cast("array<string>")).alias(f) for f in LISTS],
    )
    return F.when(~some, found).when(fine, merged)


def _path(name: str) -> str:
    return f"$['{name}']"


def _items(raw: Column, names: list[str]) -> Column:
    """A list of names: of an array's strings or its objects' name fields, or of a text's lines."""
    found = F.coalesce(*[F.get_json_object(raw, _path(n)) for n in names])
    each = F.from_json(found, "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$['名称']"))).otherwise(strip(x))
    parsed = F.filter(F.transform(each, name), lambda x: x.isNotNull() & (x != ""))
    return F.when(found.startswith("["), parsed).when(found.isNotNull(), bullets(found)).otherwise(F.array().cast("array<string>"))


def material_record(raw: Column) -> Column:
    """A record of materials from a JSON object, a JSON string of one, or a plain list (its required materials)."""
    text = strip(F.coalesce(raw, F.lit("")))
    inner = F.when(text.startswith('"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]).otherwise(text)
    is_object = inner.startswith("{") & F.try_parse_json(inner).isNotNull()
    lists = {k: F.when(is_object, _items(inner, ALIASES[k])).otherwise(bullets(inner) if k == "required" else F.array().cast("array<string>")) for k in ("required", "optional", "steps", "tips")}
    texts = {k: F.when(is_object, F.coalesce(*[F.get_json_object(inner, _path(n)) for n in ALIASES[k]], F.lit(""))).otherwise(F.lit("")) for k in ("department", "legal_time", "fee", "channel")}
    return F.struct(*[c.alias(k) for k, c in {**texts, **lists}.items()])


@F.pandas_udf(StringType())
def safe_file_name(name: pd.Series) -> pd.Series:
    """A file name without folders and unsafe characters, of 80 characters at most, its suffix in lower case."""

    def safe(n: str) -> str:
        base = unicodedata.normalize("NFKC", n or "").replace("\\", "/").rsplit("/", 1)[-1]
        stem, dot, suffix = base.rpartition(".")
        stem, suffix = (stem, suffix) if dot else (base, "")
        kept = "".join(c if c.isalnum() or c in "-_." else "_" for c in stem).strip("._")[:80] or "document"
        return f"{kept}.{suffix.lower()}" if suffix else kept

    return name.map(safe)


def text_file_name(title: Column) -> Column:
    """The name of the text file that a pasted text is kept as: its title's, whatever suffix that has."""
    base = strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\.(txt|md|markdown|pdf|docx)$", ""))
    return F.concat(safe_file_name(F.when(base == "", F.lit("text")).otherwise(base)), F.lit(".txt"))


def settings(files: DataFrame) -> DataFrame:
    """(file, key, value) of KEY=VALUE and KEY: ${KEY:-default} lines of files (file, text); comments don't count."""
    lines = files.select("file", F.explode(F.split("text", "\r?\n")).alias("l")).select("file", F.trim("l").alias("l"))
    form = r"^(?:-\s*)?([A-Z][A-Z0-9_]*)\s*[=:]\s*(.*)$"
    rows = lines.filter(~F.col("l").startswith("#") & F.col("l").rlike(form))
    value = F.regexp_extract("l", form, 2)
    default = F.regexp_extract(value, r"^[\"']?\$\{[A-Z0-9_]+:-(.*)\}[\"']?$", 1)
    plain = F.regexp_replace(value, r"^[\"']|[\"']$", "")
    return rows.select("file", F.regexp_extract("l", form, 1).alias("key"), F.when(value.rlike(r"\$\{.*:-"), default).otherwise(plain).alias("value"))


def differing_settings(found: DataFrame) -> DataFrame:
    """(key, values) of keys that files give different values."""
    return found.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values")).filter(F.size("values") > 1)
