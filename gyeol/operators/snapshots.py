"""What changed between full snapshots of a table, for any number of snapshots at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.operators.history import latest_per


def snapshot_changes(df: DataFrame, snapshot: str, key: str, compared: dict[str, Column], delivered: str, tie: Sequence[str] = ()) -> DataFrame:
    """snapshot, key, change_kind (added, removed, changed), the snapshot being the later one.

    Snapshots are numbered in order; per key, a gap in those numbers is a removal and a later
    addition, and a differing hash of the neighbouring states a change. Of several rows for a key in
    a snapshot the one delivered last counts (null delivery first; ties by `tie`, then by the
    compared values). Rows without key or snapshot are no records. Nulls in compared values are
    values. Rows are reduced to one per key and snapshot by a partial aggregate, so a key that holds
    a third of all rows costs no more than another; a window then sees at most one row per snapshot.
    """
    names = [f"_c{i}" for i in range(len(compared))]
    rows = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(
        F.col(snapshot).alias("_s"), F.col(key).alias("_k"), F.col(delivered).alias("_at"),
        *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)],
        *[c.alias(n) for n, c in zip(names, compared.values())],
    )
    last = latest_per(rows, ["_s", "_k"], [F.col("_at"), *[F.col(f"_t{i}") for i in range(len(tie))]], names)
    numbers = (
        rows.groupBy("_s").agg(F.lit(1).alias("_one"))
        .withColumn("_i", F.row_number().over(Window.partitionBy("_one").orderBy("_s")))
        .withColumn("_next", F.lead("_s").over(Window.partitionBy("_one").orderBy("_s")))
        .drop("_one")
    )
    # one row per snapshot: a register of deliveries, which Spark broadcasts if it is small
    seen = last.withColumn("_h", F.struct(*names)).join(numbers, "_s")
    w = Window.partitionBy("_k").orderBy("_i")
    seen = seen.select("_k", "_s", "_i", "_next", F.lag("_i").over(w).alias("_pi"), F.lag("_h").over(w).alias("_ph"), F.lead("_i").over(w).alias("_ni"), "_h")
    came = F.when((F.col("_i") > 1) & (F.col("_pi").isNull() | (F.col("_pi") < F.col("_i") - 1)), F.struct(F.col("_s").alias("s"), F.lit("added").alias("c")))
    went = F.when(F.col("_next").isNotNull() & (F.col("_ni").isNull() | (F.col("_ni") > F.col("_i") + 1)), F.struct(F.col("_next").alias("s"), F.lit("removed").alias("c")))
    differs = F.when((F.col("_pi") == F.col("_i") - 1) & ~F.col("_h").eqNullSafe(F.col("_ph")), F.struct(F.col("_s").alias("s"), F.lit("changed").alias("c")))
    return seen.select("_k", F.explode(F.array_compact(F.array(came, went, differs))).alias("_e")).select(
        F.col("_e.s").alias(snapshot), F.col("_k").alias(key), F.col("_e.c").alias("change_kind")
    )
