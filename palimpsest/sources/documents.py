"""Office documents as text units: paragraphs of DOCX, pages of PDF."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glob import extension
from ..functions.text import token_count, windows
from ..session import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Unpacked bytes of a document's text beyond which it isn't read.
MAX_XML_BYTES = 200 * 1024 * 1024


def docx_text(data: bytes) -> str:
    """The non-blank paragraphs of a DOCX file, a line each; empty where it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if z.getinfo("word/document.xml").file_size > MAX_XML_BYTES:
                return ""
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(x for x in lines if x.strip())


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page, by the optional library pypdf; none without it or where it can't read the file."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return []
    try:
        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]
    except Exception:  # the library raises many kinds on broken files
        return []


def units(files: DataFrame) -> DataFrame:
    """(rel_path, unit, text) of scanned .docx files (unit 0) and .pdf files (a unit per page); blank units are left out."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = [docx_text(data)] if path.lower().endswith(".docx") else pdf_pages(data)
                rows += [(path, i, t) for i, t in enumerate(texts) if t.strip()]
            c = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string())], ["rel_path", "unit", "text"])

    some = files.where(extension(F.col("rel_path")).isin(".docx", ".pdf")).select("rel_path", "content")
    return some.mapInArrow(run, "rel_path string, unit int, text string")


def ingest_units(found: DataFrame, target: int = 200, overlap: int = 30) -> DataFrame:
    """(rel_path, unit, chunk_index, content): a PDF page of up to twice the target stays whole, everything else is cut into windows."""
    whole = (token_count(F.col("text")) <= 2 * target) & F.lower("rel_path").endswith(".pdf")
    parts = F.when(whole, F.array(F.struct(F.lit(0).alias("chunk_index"), F.trim("text").alias("content")))).otherwise(F.transform(windows(F.col("text"), target, overlap), lambda w: F.struct(w["chunk_index"].cast("int").alias("chunk_index"), w["content"].alias("content"))))
    return found.select("rel_path", "unit", F.explode(parts).alias("p")).select("rel_path", "unit", "p.chunk_index", "p.content")
