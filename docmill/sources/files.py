"""Documents from files: text, Markdown, DOCX and (where a PDF library is installed) PDF, with a status for each."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import cleaned, document_id, strip, title_of_file

SUFFIXES = ("txt", "md", "markdown", "docx", "pdf")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))


def pdf_text(data: bytes) -> str:
    """Pages of a PDF file, joined by line ends."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, suffix, text, status) of all files under a folder: status is ok or what went wrong; a bad file
    doesn't stop the rest. Bytes that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.select("path", F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"), suffix.alias("suffix"), "content")
    files = files.filter(F.col("suffix").isin(*suffixes))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for kind, data in zip(f["suffix"].tolist(), f["content"].tolist()):
                try:
                    known = {"docx": docx_text, "pdf": pdf_text}
                    rows.append((known[kind](data) if kind in known else bytes(data).decode("utf-8", "ignore"), "ok"))
                except Exception as e:  # whatever a broken file makes its parser raise becomes its status
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield f[["path", "name", "suffix"]].assign(text=[t for t, _ in rows], status=[s for _, s in rows])

    return files.mapInPandas(read, "path string, name string, suffix string, text string, status string")


def resolved_title(name, text, given=None):
    """A title: given, else from the file's name, else the first of eight lines that is none of a URL or a header."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 8), lambda x: strip(F.regexp_replace(x, "^#+", "")))
    line = F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.rlike("^https?://|^www\\.|页眉|页脚")), F.lit(1))
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    title = F.coalesce(given if given is not None else F.lit(None).cast("string"), title_of_file(name), line, stem)
    return F.substring(title, 1, 120)


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, doc_name, source, text) of well-read files: cleaned, titled and named by their file name."""
    good = files.filter("status = 'ok'").withColumn("text", cleaned(F.col("text"))).filter("text <> ''")
    return good.select(document_id(F.col("name")).alias("doc_id"), resolved_title(F.col("name"), F.col("text")).alias("doc_name"), F.col("path").alias("source"), "text")


def pasted(spark: SparkSession, title: str, content: str) -> DataFrame:
    """A document of pasted text, for the same pipeline; ValueError where it is too short or long."""
    title, content = title.strip(), content.strip()
    if len(title) < 2 or not 20 <= len(content) <= 200_000:
        raise ValueError("a title of two characters and a text of 20 to 200,000 are needed")
    row = spark.createDataFrame([(title, f"{title}\n\n{content}")], "doc_name string, text string")
    return row.select(document_id(F.concat("doc_name", F.lit(".txt"))).alias("doc_id"), "doc_name", F.lit("uploaded").alias("source"), "text")


def embedding_export(spark: SparkSession, path: str, dims: int, excluded: tuple[str, ...] = ("GD00",)) -> DataFrame:
    """(id, text, embedding, doc_id, chunk_index) of a JSON export {model, dim, count, items}; vectors of another size
    are an error, documents whose id starts with an excluded prefix are left out."""
    schema = "model string, dim int, count long, items array<struct<id: string, text: string, embedding: array<float>, metadata: struct<doc_id: string, chunk_index: int, char_len: int>>>"
    items = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("items"))
    rows = items.select("id", "text", "embedding", "metadata.doc_id", "metadata.chunk_index")
    for prefix in excluded:
        rows = rows.filter(~F.col("doc_id").startswith(prefix))
    fine = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector hasn't {dims} dimensions")))
    return rows.withColumn("embedding", fine)


def document_of_id(doc_id):
    """A document's name from its id: without the number before and the site's name after, blanks for underscores."""
    name = F.regexp_replace(F.regexp_replace(doc_id, r"^GD\d+[a-zA-Z]?_", ""), "_广东政务网$", "")
    name = strip(F.translate(name, "_", " "))
    return F.when(name != "", name).otherwise(doc_id)


