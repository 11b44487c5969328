"""The test tables, and plain readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The columns of the register of documents.
REGISTRY_COLUMNS = (
    "doc_id", "bank_code", "doc_type", "category", "title", "subtitle", "display_name", "structure", "effective_date", "compliance_no", "compliance_date", "is_parsable", "exclusion_reason", "title_confidence",
    "page_count", "char_count", "n_tables", "content_hash", "is_latest", "superseded_by", "source_url", "source_path", "orig_filename", "parsed_at",
)


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The last of the files that match a pattern, by name: reports carry their date in it."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or [])
    return found[-1] if found else None


def cache_name(*parts: object) -> str:
    """The name of a cache after model and settings, without dots."""
    return "_".join(str(p) for p in parts).replace(".", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv_bom(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header whose first column name may carry a byte order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def pick(df: DataFrame, name: str, *aliases: str) -> DataFrame:
    """Column `name` from the first alias with a non-blank value; null where none has one."""
    have = [F.nullif(F.trim(F.col(f"`{a}`").cast("string")), F.lit("")) for a in (name, *aliases) if a in df.columns]
    return df.withColumn(name, F.coalesce(*have) if have else F.lit(None).cast("string"))


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """A parquet sink that refuses to overwrite unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True)
