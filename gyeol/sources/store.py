"""Index tables on disk: saved together, checked when loaded, listed by what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("postings", "terms", "stats")


def save_sparse(index: tuple[DataFrame, DataFrame, DataFrame], path: str, force: bool = False) -> None:
    """Postings, terms and stats side by side; refuses to overwrite unless forced."""
    for part, df in zip(PARTS, index):
        df.write.mode("overwrite" if force else "errorifexists").parquet(f"{path}/{part}")


def load_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{p}") for p in PARTS)


def save_dense(vectors: DataFrame, id_col: str, vector_col: str, path: str, force: bool = False) -> None:
    """Ids and vectors, with the number of rows and the dimension beside them. All must have one dimension."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    found = v.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("dim"))
    r = found.first()
    if r.n and r.lo != r.dim:
        raise ValueError(f"dimensions from {r.lo} to {r.dim}")
    mode = "overwrite" if force else "errorifexists"
    v.write.mode(mode).parquet(f"{path}/vectors")
    found.select("n", "dim").write.mode(mode).parquet(f"{path}/meta")


def load_dense(spark: SparkSession, path: str) -> DataFrame:
    """id, vector; fails if rows are missing."""
    v, meta = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta").first()
    if v.count() != meta.n:
        raise ValueError(f"{path}: {v.count()} vectors, {meta.n} were saved")
    return v


def save_catalog(entries: DataFrame, path: str, force: bool = False) -> None:
    """The catalog as JSON lines; refuses to overwrite unless forced."""
    entries.write.mode("overwrite" if force else "errorifexists").json(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, bucket string, name string, key string, doc_type string, category string").json(path)


def index_name(chunks: str) -> str:
    """The name of an index after the file of its chunks: chunks.jsonl is the base."""
    stem = chunks.rsplit("/", 1)[-1].split(".", 1)[0]
    return "base" if stem == "chunks" else stem.removeprefix("chunks_")
