"""History of changing attributes: a bitemporal ledger with valid and recorded time.

An update says: from day `valid` on, key has this state; it was recorded at `recorded`. At any
recorded time R the state of day v is that of the update with the largest valid day <= v among the
updates recorded up to R; of several for one day the one recorded last counts. The ledger holds
rectangles (valid_from, valid_to) x (recorded_from, recorded_to): a late update splits the interval
it falls into, which is closed in recorded time and written again, shorter; nothing is overwritten.

The sweep: the days of a key are break points, each known since its first record. The end of an
interval that starts at day d, as R grows, is the smallest later day known at R, so it only ever
shrinks: scanning the days after d, only those known earlier than all between d and them ever bound
it, up to the first that is known no later than d itself. That staircase is found with one stack per
key, from which what a day passes is taken, so all staircases together are linear in the days. A key has at most one break point per calendar
day, so the arrays that are gathered per key are bounded by the calendar, not by the rows; rows are
reduced to one per (key, day, recorded time) by partial aggregates before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_OF_TIME = "9999-12-31"


def _staircases(days: pd.Series, known: pd.Series) -> pd.Series:
    """For each day the later days that bound it at some recorded time since it is known, nearest first."""
    out = []
    for ds, ks in zip(days, known):
        n = len(ds)
        steps: list = [None] * n
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            row, best = [], None
            for j in reversed(stack):
                if best is None or ks[j] < best:
                    row.append({"day": int(ds[j]), "since": int(ks[j])})
                    best = ks[j]
                if best <= ks[i]:
                    break
            steps[i] = row
            while stack and ks[stack[-1]] >= ks[i]:
                stack.pop()
            stack.append(i)
        out.append(steps)
    return pd.Series(out)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """One row per keys, the greatest by `order`, by a partial aggregate (no hot group is gathered).
    Nulls sort before all values; rows that tie in all of `order` and `values` are the same row."""
    packed = F.struct(*order, *[F.col(v) for v in values])
    return (
        df.select(*keys, packed.alias("_p"))
        .groupBy(*keys)
        .agg(F.max("_p").alias("_p"))
        .select(*keys, *[F.col(f"_p.{v}").alias(v) for v in values])
    )


def bitemporal_ledger(df: DataFrame, key: str, valid: str, recorded: str, state: Sequence[str], tie: str | None = None) -> DataFrame:
    """key, *state, valid_from, valid_to, recorded_from, recorded_to (dates and timestamps).

    Rows without key or valid day state nothing and are left out; a null recorded time counts as
    earlier than any. Of rows with the same key, day and recorded time the one with the greater
    `tie`, then the greater state (null least), counts. valid_to is 9999-12-31 and recorded_to null
    while open. Repeated rows and updates that change nothing leave no trace. Columns of df other
    than those named are ignored. An empty input gives an empty ledger.
    """
    state = list(state)
    clean = df.where(F.col(key).isNotNull() & F.col(valid).isNotNull()).select(
        F.col(key).alias("_k"),
        F.col(valid).cast("date").alias("_d"),
        F.coalesce(F.col(recorded).cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("_r"),
        (F.col(tie) if tie else F.lit(0)).alias("_t"),
        *[F.col(c).alias(f"_s{i}") for i, c in enumerate(state)],
    )
    names = [f"_s{i}" for i in range(len(state))]
    # orderable states only: one row per key, day and recorded time, reduced before any shuffle
    ups = latest_per(clean, ["_k", "_d", "_r"], [F.col("_t")], names)
    by_day = Window.partitionBy("_k", "_d").orderBy("_r")
    packed = F.struct(*names)
    ups = (
        ups.withColumn("_same", F.coalesce(F.lag(packed).over(by_day).eqNullSafe(packed), F.lit(False)))
        .where(~F.col("_same"))
        .withColumn("_rto", F.lead("_r").over(by_day))
    )
    breaks = ups.groupBy("_k", "_d").agg(F.min("_r").alias("_since"))
    arrays = breaks.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct(F.unix_date("_d").alias("day"), F.unix_micros("_since").alias("since")))).alias("_b"))
    stairs = F.pandas_udf(_staircases, "array<array<struct<day:int,since:bigint>>>")
    steps = (
        arrays.select("_k", F.col("_b.day").alias("_days"), F.col("_b.since").alias("_knowns"))
        .withColumn("_steps", stairs("_days", "_knowns"))
        .select("_k", F.explode(F.arrays_zip("_days", "_steps")).alias("_z"))
        .select("_k", F.date_from_unix_date("_z._days").alias("_d"), F.col("_z._steps").alias("_steps"))
    )
    # nearest first with ever earlier 'since': step j bounds from its since until the since of step j-1
    joined = ups.join(steps, ["_k", "_d"])
    far = F.array(F.struct(F.unix_date(F.lit(END_OF_TIME).cast("date")).alias("day"), F.lit(None).cast("bigint").alias("since")))
    spans = F.transform(
        F.concat("_steps", far),
        lambda x, i: F.struct(
            F.date_from_unix_date(x["day"]).alias("vto"),
            F.timestamp_micros(x["since"]).alias("rfrom"),
            F.timestamp_micros(F.when(i > 0, F.element_at("_steps", F.greatest(i, F.lit(1)))["since"])).alias("rto"),
        ),
    )
    cut = joined.select("_k", "_d", "_r", "_rto", *names, F.explode(spans).alias("_x")).select(
        "_k", "_d", *names, F.col("_x.vto").alias("_vto"),
        F.greatest(F.col("_r"), F.col("_x.rfrom")).alias("_rf"),
        F.least(F.col("_rto"), F.col("_x.rto")).alias("_re"),
    )
    return cut.where(F.col("_re").isNull() | (F.col("_rf") < F.col("_re"))).select(
        F.col("_k").alias(key),
        *[F.col(n).alias(c) for n, c in zip(names, state)],
        F.col("_d").alias("valid_from"), F.col("_vto").alias("valid_to"),
        F.col("_rf").alias("recorded_from"), F.col("_re").alias("recorded_to"),
    )


def versions(ledger: DataFrame, key: str, state: Sequence[str], as_of: str | None = None) -> DataFrame:
    """The versions known now, or at the recorded time `as_of`: key, version_no, *state, valid_from,
    valid_to. Consecutive equal states are one version; a state that returns later is a new one."""
    if as_of is None:
        known = ledger.where(F.col("recorded_to").isNull())
    else:
        t = F.lit(as_of).cast("timestamp")
        known = ledger.where((F.col("recorded_from") <= t) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > t)))
    w = Window.partitionBy(key).orderBy("valid_from")  # at most a row per calendar day
    packed = F.struct(*state)
    starts = known.withColumn("_new", ~F.coalesce(F.lag(packed).over(w).eqNullSafe(packed), F.lit(False))).where("_new")
    return starts.select(
        key,
        F.row_number().over(w).alias("version_no"),
        *state,
        "valid_from",
        F.coalesce(F.lead("valid_from").over(w), F.lit(END_OF_TIME).cast("date")).alias("valid_to"),
    )
