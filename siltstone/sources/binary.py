"""Text of binary documents: DOCX, XLSX and, where the optional reader is installed, PDF."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages of a PDF that are read, and bytes of one part of an archive.
PDF_PAGES, PART_BYTES = 30, 64 << 20


def _part(archive: zipfile.ZipFile, name: str) -> str:
    with archive.open(name) as f:
        return f.read(PART_BYTES).decode("utf-8", "replace")


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, one per line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml")
    runs = re.compile(r"<w:t(?: [^>]*)?>([^<]*)</w:t>|<w:tab/>")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", body, re.DOTALL)
    lines = ("".join(m.group(1) if m.group(1) is not None else "\t" for m in runs.finditer(p)) for p in paragraphs)
    return unescape("\n".join(x for x in lines if x.strip()))


def xlsx_text(data: bytes) -> str:
    """Cells of all sheets of an XLSX file, tab-separated, one row per line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(re.findall(r"<t(?: [^>]*)?>([^<]*)</t>", s)) for s in re.findall(r"<si>.*?</si>", _part(z, "xl/sharedStrings.xml"), re.DOTALL)]
        rows = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in re.findall(r"<row[ >].*?</row>", _part(z, name), re.DOTALL):
                cells = []
                for attrs, inner in re.findall(r"<c([^>]*)>(.*?)</c>", row, re.DOTALL):
                    value = re.search(r"<(?:v|t)(?: [^>]*)?>([^<]*)</(?:v|t)>", inner)
                    text = value.group(1) if value else ""
                    cells.append(shared[int(text)] if 't="s"' in attrs and text.isdigit() and int(text) < len(shared) else text)
                rows.append("\t".join(cells))
    return unescape("\n".join(r for r in rows if r.strip()))


def pdf_text(data: bytes) -> str | None:
    """Text of the first PDF_PAGES pages; None where no reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages[:PDF_PAGES])


def cut_short(kind: str, data: bytes) -> bool:
    """Whether a file has more than the bounds let be read: pages of a PDF, bytes of a part of an archive."""
    if kind != "pdf":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return any(part.file_size > PART_BYTES for part in z.infolist() if part.filename.endswith(".xml"))
    try:
        from pypdf import PdfReader
    except ImportError:
        return False
    return len(PdfReader(io.BytesIO(data)).pages) > PDF_PAGES


READERS = {"docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("truncated", T.BooleanType()), T.StructField("error", T.StringType())]))
def _text(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    texts, cut, errors = [], [], []
    for path, data in zip(paths, contents):
        try:
            kind = path.rsplit(".", 1)[-1].lower()
            text, short, error = READERS[kind](data), cut_short(kind, data), None
        except Exception as e:  # a broken file is a row with its error
            text, short, error = None, None, f"{type(e).__name__}: {e}"[:200]
        texts.append(text)
        cut.append(short)
        errors.append(error)
    return pd.DataFrame({"text": texts, "truncated": cut, "error": errors}, dtype=object)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, truncated, error) of the DOCX, XLSX and PDF files below a folder; a file that cannot be read keeps its
    error, and truncated tells that it has more than PDF_PAGES or PART_BYTES let be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx,pdf}").load(path)
    return files.select("path", _text("path", "content").alias("t")).select("path", "t.*")
