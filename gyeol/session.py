"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gyeol", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. Clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the session leaves it unset (tests, local runs) is a temporary folder made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rstrip("/")
        own = tempfile.mkdtemp(prefix="gyeol-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of any file system removed when the driver ends."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and the rows
    survive the loss of executors. Used where a result is read more than once or steps iterate. The
    table is removed when the driver ends, or before by drop_materialized."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gyeol-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files of a table made by materialize that nothing reads any more."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/gyeol-" in f:
            fs, p = _file_system(df.sparkSession, f)
            fs.delete(p, True)


def fingerprint(df: DataFrame) -> str:
    """What the files of a table are now: names, sizes and times."""
    spark, h = df.sparkSession, hashlib.md5()
    for f in sorted(df.inputFiles()):
        fs, p = _file_system(spark, f)
        st = fs.getFileStatus(p)
        h.update(f"{f} {st.getLen()} {st.getModificationTime()}\n".encode())
    return h.hexdigest()


def stored(spark: SparkSession, name: str, key: str, build: Callable[[], Sequence[DataFrame]]) -> list[DataFrame]:
    """The tables of build(), written to the shared folder once per application and key and read from
    there. The key has to say what they are made of (see fingerprint), so changed inputs build anew."""
    base = f"{shared_dir(spark)}/gyeol-{name}-{spark.sparkContext.applicationId}-{key}"
    if not exists(spark, f"{base}/done"):
        for i, df in enumerate(tables := list(build())):
            df.write.mode("overwrite").parquet(f"{base}/{i}")
        spark.createDataFrame([(len(tables),)], "n int").write.mode("overwrite").parquet(f"{base}/done")
        drop_at_exit(spark, base)
    n = spark.read.parquet(f"{base}/done").first().n
    return [spark.read.parquet(f"{base}/{i}") for i in range(n)]


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a few files give fewer partitions than there are cores. What comes in so
    few partitions is cheap to move; other tables stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
