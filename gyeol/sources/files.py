"""Files as tables: FAQ lines, FAQ pages, verdict tables in Markdown, PDF where a reader is there."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.text import LABELS

FAQ_FIELDS = "faq_id string, bank_code string, bank_name string, category string, question string, answer string, source_url string, collected_at string, status string"


def read_faq_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines): one JSON object a line; blank lines are skipped, broken ones kept aside."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", FAQ_FIELDS + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("r._broken").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_broken"), parsed.where(bad).select("value")


class _Pairs(HTMLParser):
    """Question and answer of definition lists and of items that hold both; and the plain text."""

    def __init__(self):
        super().__init__()
        self.pairs, self.text, self._open, self._buf, self._q = [], [], "", [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("dt", "dd"):
            self._open, self._buf = tag, []

    def handle_endtag(self, tag):
        if tag == self._open:
            body = clean_label("".join(self._buf))
            if tag == "dt":
                self._q = body
            elif self._q and body:
                self.pairs.append((self._q, body))
                self._q = ""
            self._open = ""

    def handle_data(self, data):
        self.text.append(data)
        if self._open:
            self._buf.append(data)


def clean_label(text: str) -> str:
    return re.sub(LABELS, "", " ".join((text or "").split())).strip()


def question_pairs(html: str | None) -> list[tuple[str, str]]:
    """Pairs from the markup, else from texts marked 'Q. 질문' and 'A. 답변'."""
    p = _Pairs()
    p.feed(html or "")
    if p.pairs:
        return p.pairs
    out = []
    for block in re.split(r"Q\.\s*질문", "\n".join(p.text))[1:]:
        halves = [clean_label(x) for x in re.split(r"A\.\s*답변", block, maxsplit=1)]
        if len(halves) == 2 and all(halves):
            out.append((halves[0], halves[1]))
    return out


def read_faq_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, pos, question, answer; a page that can't be read gives nothing and breaks nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, html in zip(pdf["id"], pdf["html"]):
                try:
                    rows += [(k, i, q, a) for i, (q, a) in enumerate(question_pairs(html))]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["id", "pos", "question", "answer"])

    src = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
    return src.mapInPandas(run, "id string, pos int, question string, answer string")


def read_verdict_table(spark: SparkSession, path: str, valid: tuple[str, ...] = ("pass", "fail", "na")) -> DataFrame:
    """id, criterion, verdict of the Markdown table rows whose cells behind the id are all valid."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|.*\|\s*$") & ~F.col("value").rlike(r"^[\s|:\-]+$"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select(cells.alias("c")).where(F.size("c") > 1).select(F.element_at("c", 1).alias("id"), F.slice("c", 2, 100).alias("v"))
    ok = rows.where(F.forall("v", lambda x: F.lower(x).isin(*valid)))
    return ok.select("id", F.posexplode("v").alias("criterion", "verdict")).select("id", "criterion", F.lower("verdict").alias("verdict"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """path, n_pages, text, error of PDF files, if the reader pdfplumber is installed. A file that can't be
    read is a row with its error and breaks nothing."""
    try:
        import pdfplumber  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber, which isn't installed") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    with pdfplumber.open(io.BytesIO(content)) as doc:
                        rows.append((p, len(doc.pages), "\n".join(x.extract_text() or "" for x in doc.pages), None))
                except Exception as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"[:120]))
            yield pd.DataFrame(rows, columns=["path", "n_pages", "text", "error"]).astype({"n_pages": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, n_pages int, text string, error string")


#: Readers by what they can read; the first that says yes reads.
READERS: list[tuple[Callable[[str], bool], Callable]] = [
    (lambda p: p.lower().endswith(".jsonl") and "faq" in p.lower(), lambda s, p: read_faq_lines(s, p)[0]),
    (lambda p: p.lower().endswith(".pdf"), read_pdf),
    (lambda p: p.lower().endswith(".parquet"), lambda s, p: s.read.parquet(p)),
]


def register(can_read: Callable[[str], bool], reader: Callable) -> None:
    """Put a reader before all others."""
    READERS.insert(0, (can_read, reader))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    for can, reader in READERS:
        if can(path):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")
