"""Titles from a table of positioned words, lines that repeat over pages, and sequential assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.functions import text as T

#: Lines that are never a title or a subtitle.
NOT_TITLE = r"준법감시인|심의필|심사필|보존년한|페이지|Page|\d+\s*/\s*\d+|^\(cid:"
NOT_SUBTITLE = r"이\s*(설명서|약정서|계약서)는|참고자료|알려드리기\s*위한|이해를\s*돕|내부통제기준|(합니다|입니다|한다|됩니다|바랍니다)\s*[.]?\s*$"


def lines_by_font(words: DataFrame, k: int = 2) -> DataFrame:
    """doc_id, place, size, line: the k lines of the largest letters, then the upper ones. words: doc_id,
    top, x0, size, text of a first page; a line is the words of one rounded height, left to right."""
    w = words.withColumn("row", F.round("top"))
    g = w.groupBy("doc_id", "row").agg(F.avg("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("line"))
    g = g.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t\xa0　]+", " ")))
    ok = g.where(F.length("line").between(3, 60) & ~F.col("line").rlike(NOT_TITLE) & F.col("line").rlike("[가-힣A-Za-z]"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("size"), "row", F.desc("line"))
    return ok.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("doc_id", "place", "size", "line")


def reconcile_titles(by_font: DataFrame, by_keyword: DataFrame) -> DataFrame:
    """doc_id, title, subtitle, confidence from the two largest lines and the line with a kind word
    (doc_id, title_found). A subtitle has at least 0.7 of the title's size, is no notice, no repeat."""
    at = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    f = by_font.groupBy("doc_id").agg(at(1, "line").alias("t"), at(1, "size").alias("ts"), at(2, "line").alias("s"), at(2, "size").alias("ss"))
    j = f.join(by_keyword, "doc_id", "full_outer")
    t, s, k = T.collapse_letter_spacing("t"), T.collapse_letter_spacing("s"), F.col("title_found")
    j = j.withColumn("t", t).withColumn("s", s)
    keep = (F.col("ss") / F.col("ts") >= 0.7) & ~F.col("s").rlike(NOT_SUBTITLE) & (F.length("s") <= 60) & (T.squash(F.col("s")) != T.squash(F.col("t")))
    a, b = T.squash(F.col("t")), T.squash(k)
    agree = F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False))
    title = F.when(F.col("t").isNull(), k).when(agree & (F.length(b) > F.length(a)), k).otherwise(F.col("t"))
    confidence = F.when(F.col("t").isNotNull() & agree, "high").when(F.col("t").isNotNull() | k.isNotNull(), "medium").otherwise("manual")
    return j.select("doc_id", F.coalesce(title, F.lit("")).alias("title"), F.when(keep, F.col("s")).otherwise(F.lit("")).alias("subtitle"), confidence.alias("confidence"))


def repeated_page_lines(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """doc_id, line, n_pages of lines on at least `share` of a document's pages. pages: doc_id, page, text."""
    lines = pages.select("doc_id", "page", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    total = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    n = lines.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("n_pages"))
    return n.join(total, "doc_id").where(F.col("n_pages") >= F.col("total") * share).select("doc_id", "line", "n_pages")


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows of each group, evenly spaced in its order: the sample is the feature."""
    from gyeol.operators.quality import numbered

    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    r = numbered(df, group, order, "_i").join(n, list(group))
    step = F.greatest(F.col("_n") / k, F.lit(1.0))
    slot = F.floor((F.col("_i") - 1) / step)
    return r.where((slot < k) & ((F.col("_i") == 1) | (slot != F.floor((F.col("_i") - 2) / step)))).drop("_n", "_i")


def assign_by_deficit(kinds: Column, allowed: dict[str, Sequence[str]], mix: dict[str, float]) -> Column:
    """For an ordered array of kinds the level of each: of those allowed, the one farthest below its share
    of all so far, the first named if level. Sequential by nature, hence one fold per array."""
    names = list(mix)
    total = F.size(kinds)
    state = F.struct(F.array().cast("array<string>").alias("out"), *[F.lit(0).alias(n) for n in names])

    def step(a: Column, kind: Column) -> Column:
        lack = lambda n: a[n] - F.lit(float(mix[n])) * total
        best = F.lit(None).cast("string")
        for k, opts in allowed.items():
            pick = F.array_min(F.array(*[F.struct(lack(n).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(opts)]))["n"]
            best = F.when(kind == k, pick).otherwise(best)
        best = F.coalesce(best, F.lit(names[len(names) // 2]))
        return T.let(best, lambda b: F.struct(F.concat(a["out"], F.array(b)).alias("out"), *[(a[n] + (b == n).cast("int")).alias(n) for n in names]))

    return F.aggregate(kinds, state, step, lambda a: a["out"])


def mismatch_tally(reviewed: DataFrame, by: str) -> DataFrame:
    """by, n, n_real, precision of findings reviewed as (class, is_real)."""
    real = F.coalesce("is_real", F.lit(False))
    return reviewed.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(real, 1)).alias("n_real"), F.round(F.avg(real.cast("double")), 4).alias("precision"))
