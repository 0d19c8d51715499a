"""File sources: sniffing, guards, dispatch by format, content-addressed storage."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and formats of uploads.
MOST_MB, MOST_PAGES, MOST_UNZIPPED_MB = 50, 300, 100
FORMATS = {"pdf": "%PDF-", "docx": "PK\x03\x04"}
PAGES = "path string, page_no int, text string, ok boolean, reason string"
TABLES = "path string, table_index int, rows array<array<string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, pattern: str = "*.*") -> DataFrame:
    """path, content, length and modificationTime of every file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def sniff(path: Column, content: Column) -> Column:
    """pdf or docx where the name's ending and the first bytes agree, else null."""
    head = F.substring(content, 1, 5)
    name = F.lower(path)
    pdf = F.endswith(name, F.lit(".pdf")) & (F.substring(head, 1, 5) == F.lit(b"%PDF-"))
    docx = F.endswith(name, F.lit(".docx")) & (F.substring(head, 1, 4) == F.lit(b"PK\x03\x04"))
    return F.when(pdf, "pdf").when(docx, "docx")


def admitted(files: DataFrame) -> DataFrame:
    """Files with their format, digest and, where they can't be taken, the reason."""
    kind = sniff(F.col("path"), F.col("content"))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_MB << 20, "too_large").when(kind.isNull(), "unsupported_type")
    return files.withColumn("format", kind).withColumn("sha256", F.sha2("content", 256)).withColumn("reason", reason)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """One file per digest that isn't known yet."""
    return files.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def unzipped_size(content: bytes) -> int:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return sum(i.file_size for i in z.infolist())


def docx_parts(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraph texts outside tables, and tables as rows of cell texts."""
    if unzipped_size(content) > MOST_UNZIPPED_MB << 20:
        raise ValueError("archive_too_large")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [text(p) for p in body.findall(f"{_W}p")]
    tables = [[[" ".join(text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return lines, tables


def _pdf_streams(content: bytes) -> Iterator[bytes]:
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            yield zlib.decompress(m[1])
        except zlib.error:
            yield m[1]


def _pdf_string(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
    plain = re.sub(rb"\\([nrtbf()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m[1], m[1]), plain)
    return plain[2:].decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("cp1252", "replace")


def pdf_pages(content: bytes) -> list[str]:
    """Texts of the pages' content streams: simple text layers, without font encodings of their own."""
    if re.search(rb"/Encrypt\b", content):
        raise ValueError("encrypted")
    if not content.startswith(b"%PDF-") or b"%%EOF" not in content[-2048:]:
        raise ValueError("corrupt")
    if len(re.findall(rb"/Type\s*/Page\b", content)) > MOST_PAGES:
        raise ValueError("too_many_pages")
    pages = []
    for stream in _pdf_streams(content):
        if not re.search(rb"\bBT\b", stream):
            continue
        lines: list[str] = []
        for m in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\\.|[^\]])*)\]\s*TJ|(T\*|Td|TD|ET)", stream, re.S):
            if m[3]:
                lines.append("")
                continue
            parts = [m[1]] if m[1] is not None else re.findall(rb"\(((?:\\.|[^\\()])*)\)", m[2], re.S)
            if not lines:
                lines.append("")
            lines[-1] += "".join(_pdf_string(p) for p in parts)
        pages.append("\n".join(x for x in lines if x))
    return pages


def _read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, kind, content in zip(batch.path, batch.format, batch.content, strict=True):
            try:
                pages = pdf_pages(content) if kind == "pdf" else ["\n".join(docx_parts(content)[0])]
                rows += [(path, i + 1 if kind == "pdf" else None, text, True, None) for i, text in enumerate(pages)]
            except Exception as e:  # a bad file is a row with its reason, not a failed job
                rows.append((path, None, None, False, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "page_no", "text", "ok", "reason"]).astype({"page_no": "Int32"})


def extract_pages(files: DataFrame) -> DataFrame:
    """A row per page of pdf and docx files, or one row with a reason for a file that can't be read."""
    return files.where(F.col("format").isNotNull()).select("path", "format", "content").mapInPandas(_read_pages, PAGES)


def _read_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.path, batch.content, strict=True):
            try:
                rows += [(path, i, t) for i, t in enumerate(docx_parts(content)[1])]
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                continue  # extract_pages gives the reason
        yield pd.DataFrame(rows, columns=["path", "table_index", "rows"])


def extract_tables(files: DataFrame) -> DataFrame:
    return files.where("format = 'docx'").select("path", "content").mapInPandas(_read_tables, TABLES)


def write_version(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the versions that rows holds, and only those."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Audit and usage logs only grow."""
    rows.write.mode("append").parquet(path)
