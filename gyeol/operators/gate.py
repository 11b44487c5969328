"""When evidence is too weak: question rules, retrieval signals, verdicts from a cache; and what
measures them: confusion, area under the curve, agreement, threshold grids, fronts and plateaus.

Thresholds are rows of a table, not constants of code: a grid is joined to the signals and summed in
one aggregate. The question set and the grid are small stated sets; no corpus table meets them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.functions import text as T

#: What a question's wording shows, in the order in which rules are tried.
OWN_ATTRIBUTE = r"제\s*(\S+\s+)?(신용|연체|거래|소득|급여|자산|한도|등급|기록|명의)"
OWN_ACCOUNT = r"(제|내)\s*(계좌|통장|카드|예금|적금|대출|보유|신용|등급|소득|한도)"
FIRST_PERSON = r"(제가|저는|내가|저에게|제게)\s"
ASKS_PERSONAL = r"얼마(까지|나|인가)|한도는|몇\s*(퍼센트|%|원)|받을\s*수\s*있|가능한(가|지)|해당(하나|되나|하는지)|받았(나|는지)|되어\s*있(나|는지)|등록(됐|되었|돼)|위험이\s*큰|적합한|맞나요|금액은|손실|예상|얼마인가요"
GENERAL_RULE = r"언제(부터|까지|까지나)|어떻게\s*(되나|하나|해야)|무엇을|어떤\s*(서류|절차|조건|방법)|문제가\s*생기|불이익|해야\s*하나|되나요\s*$"
TIME_VARIANT = r"현재|오늘|지금|이번\s*(주|달|분기|년)|올해|내년|작년|최근|당장|실시간|요즘"
OUT_OF_SCOPE = r"타\s*은행|타행|다른\s*은행|경쟁력|비교(해|하면|하여|해서)|우수한|장점은|어떤\s*점이|내부\s*(심사|정책|기준|규정)|심사\s*기준|추천(해|하나|할까)|좋을까요|어느\s*것이\s*나"
VALUE_QUESTION = r"얼마|몇\s*(퍼센트|%|원|년|개월|일|회)|요율|이율|금액은|비용은|수수료는|얼마인가|어떻게\s*되나|정해지나|산정되나"


def question_rule(question: Column) -> Column:
    """personalized, time_variant, out_of_scope or null."""
    q = T.strip(question)
    personal = q.rlike(OWN_ATTRIBUTE) | ((q.rlike(OWN_ACCOUNT) | q.rlike(FIRST_PERSON)) & q.rlike(ASKS_PERSONAL) & ~q.rlike(GENERAL_RULE))
    return F.when(personal, "personalized").when(q.rlike(TIME_VARIANT), "time_variant").when(q.rlike(OUT_OF_SCOPE), "out_of_scope")


def signals(queries: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per query: score_top1, gap_1_2, gap_1_5 (0 with fewer hits), std_top5 (population),
    blank_ratio and doc_concentration of the first five, n_hits. hits: query_id, id, rank, score;
    texts: id, text."""
    marked = hits.join(texts.select("id", T.has_blank(F.col("text")).alias("blank")), "id", "left")
    top = F.col("rank") <= 5
    s = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    g = marked.groupBy("query_id").agg(
        s(1).alias("s1"), s(2).alias("s2"), s(5).alias("s5"), F.stddev_pop(F.when(top, F.col("score"))).alias("std"),
        F.sum(F.when(top & F.col("blank"), 1).otherwise(0)).alias("blanks"), F.count(F.when(top, 1)).alias("n5"),
        F.countDistinct(F.when(top, T.chunk_to_doc(F.col("id")))).alias("doc_concentration"), F.count("*").alias("n_hits"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    j = queries.join(g, "query_id", "left")
    return j.select(
        *queries.columns, z(F.col("s1")).alias("score_top1"), z(F.col("s1") - F.col("s2")).alias("gap_1_2"), z(F.col("s1") - F.col("s5")).alias("gap_1_5"), z(F.col("std")).alias("std_top5"),
        z(F.col("blanks") / F.nullif(F.col("n5"), F.lit(0))).alias("blank_ratio"), F.coalesce("doc_concentration", F.lit(0)).alias("doc_concentration"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
    )


def signal_rule(question: Column, top1: Column | float, gap15: Column | float, blank: Column | float) -> Column:
    """out_of_scope, low_confidence, blank_value or null (undecided)."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return (
        F.when(F.col("n_hits") == 0, "out_of_scope")
        .when((F.col("score_top1") < as_col(top1)) & (F.col("gap_1_5") < as_col(gap15)), "low_confidence")
        .when((F.col("blank_ratio") >= as_col(blank)) & question.rlike(VALUE_QUESTION), "blank_value")
    )


def judge(rows: DataFrame, verdicts: DataFrame | None, top1: float, gap15: float, blank: float) -> DataFrame:
    """query_id, decision, stage, reason: rules, then signals, then the cached verdict (query_id,
    verdict); a missing verdict, or none at all, refuses."""
    r = rows.withColumn("r0", question_rule(F.col("question"))).withColumn("r1", signal_rule(F.col("question"), top1, gap15, blank))
    r = r.join(verdicts, "query_id", "left") if verdicts is not None else r.withColumn("verdict", F.lit(None).cast("string"))
    answered = F.upper(F.coalesce("verdict", F.lit(""))).startswith("ANSWER")
    last = "llm" if verdicts is not None else "retrieval_fallback"
    return r.select(
        "query_id",
        F.when(F.col("r0").isNotNull() | F.col("r1").isNotNull() | ~answered, "refuse").otherwise("answer").alias("decision"),
        F.when(F.col("r0").isNotNull(), "pattern").when(F.col("r1").isNotNull(), "retrieval").otherwise(last).alias("stage"),
        F.coalesce("r0", "r1", F.when(~answered, "no_evidence" if verdicts is not None else "low_confidence")).alias("reason"),
    )


def confusion(df: DataFrame, expected: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates with refusing as the positive; rates without a base are 0."""
    c = lambda cond, n: F.count(F.when(cond, 1)).alias(n)
    g = df.groupBy(*by).agg(c(expected & predicted, "tp"), c(expected & ~predicted, "fn"), c(~expected & predicted, "fp"), c(~expected & ~predicted, "tn"))
    return rates(g)


def rates(g: DataFrame) -> DataFrame:
    tp, fn, fp, tn = (F.col(x).cast("double") for x in ("tp", "fn", "fp", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    far, over = div(fn, tp + fn), div(fp, fp + tn)
    precision, recall = div(tp, tp + fp), div(tp, tp + fn)
    return g.select(
        "*", F.round(div(tp + tn, tp + fn + fp + tn), 4).alias("accuracy"), F.round(far, 4).alias("false_answer_rate"), F.round(over, 4).alias("over_refusal_rate"), F.round(precision, 4).alias("precision"),
        F.round(div(2 * precision * recall, precision + recall), 4).alias("f1"), F.round((div(tp, tp + fn) + div(tn, tn + fp)) / 2, 4).alias("balanced_accuracy"),
    )


def auc(df: DataFrame, positive: str, values: Sequence[str]) -> DataFrame:
    """signal, auc: chance that a positive's value exceeds a negative's, ties a half, 0.5 if one side
    is empty. Rows are counted by value first; the window runs over distinct values of a signal."""
    long = df.select(F.col(positive).alias("p"), F.explode(F.array(*[F.struct(F.lit(v).alias("signal"), F.col(v).cast("double").alias("v")) for v in values])).alias("x"))
    c = long.select("p", "x.*").groupBy("signal", "v").agg(F.sum(F.col("p").cast("bigint")).alias("np"), F.sum((~F.col("p")).cast("bigint")).alias("nn"))
    below = F.coalesce(F.sum("nn").over(Window.partitionBy("signal").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = c.withColumn("w", F.col("np") * (below + F.col("nn") / 2)).groupBy("signal").agg(F.sum("w").alias("w"), F.sum("np").alias("n1"), F.sum("nn").alias("n0"))
    return g.select("signal", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.round(F.col("w") / (F.col("n1") * F.col("n0")), 6)).otherwise(F.lit(0.5)).alias("auc"))


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, agreement and Cohen's kappa of two raters; 1 if agreement by chance is certain, 0 without rows."""
    cells = df.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    n = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("c")).otherwise(0)).alias("same"))
    side = lambda c, name: cells.groupBy(*by, F.col(c).alias("l")).agg(F.sum("c").alias(name))
    both = side("x", "cx").join(side("y", "cy"), [*by, "l"])
    chance = both.groupBy(*by).agg(F.sum(F.col("cx").cast("double") * F.col("cy")).alias("prod"))
    j = n.join(chance, list(by), "left") if by else n.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("prod", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return j.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(po, F.lit(0.0)), 6).alias("agreement"), F.round(F.when(F.col("n").isNull(), 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def grid(spark: SparkSession, top1: Sequence[float], gap15: Sequence[float], blank: Sequence[float]) -> DataFrame:
    rows = [(float(a), float(b), float(c)) for a in top1 for b in gap15 for c in blank]
    return spark.createDataFrame(rows, "hard_top1 double, hard_gap15 double, hard_blank double")


def sweep(rows: DataFrame, points: DataFrame, expected: Column, verdicts: DataFrame | None = None) -> DataFrame:
    """Confusion and number left to the last stage for each point of a grid: one aggregate. Undecided
    rows take the cached verdict, a missing one refuses; without verdicts they count as answered."""
    r = rows.withColumn("r0", question_rule(F.col("question")).isNotNull()).withColumn("expected", expected)
    r = r.join(verdicts, "query_id", "left") if verdicts is not None else r.withColumn("verdict", F.lit("ANSWER"))
    x = F.broadcast(points).crossJoin(r)  # both are stated sets: points of a grid, questions of an evaluation
    r1 = signal_rule(F.col("question"), F.col("hard_top1"), F.col("hard_gap15"), F.col("hard_blank")).isNotNull()
    undecided = ~F.col("r0") & ~r1
    refused = F.col("r0") | r1 | ~F.upper(F.coalesce("verdict", F.lit(""))).startswith("ANSWER")
    c = lambda cond, n: F.count(F.when(cond, 1)).alias(n)
    e = F.col("expected")
    g = x.groupBy("hard_top1", "hard_gap15", "hard_blank").agg(c(undecided, "to_llm"), c(e & refused, "tp"), c(e & ~refused, "fn"), c(~e & refused, "fp"), c(~e & ~refused, "tn"))
    return rates(g)


def with_cost(swept: DataFrame, weight: float, per_call: float) -> DataFrame:
    n = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    return swept.withColumn("cost", F.round(F.col("false_answer_rate") * weight + F.col("over_refusal_rate") + per_call * (F.col("to_llm") / n), 5))


def best_per_weight(swept: DataFrame, weights: Sequence[float], per_call: float = 0.1) -> DataFrame:
    """The cheapest point for each weight; ties by balanced accuracy, then by the thresholds."""
    out = None
    for w in weights:
        one = with_cost(swept, w, per_call).orderBy("cost", F.desc("balanced_accuracy"), "hard_top1", "hard_gap15", "hard_blank").limit(1).withColumn("weight", F.lit(float(w)))
        out = one if out is None else out.union(one)
    return out


def pareto(points: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that no other beats in a and b (both to be small); equal rows all stay. The rows are first
    reduced to the least b per a; a point is beaten if a smaller a has b as small or its own a a smaller b."""
    least = points.groupBy(F.col(a).alias("pa")).agg(F.min(b).alias("pb"))
    w = Window.orderBy("pa").rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct value of a rate over a grid
    front = least.withColumn("before", F.min("pb").over(w)).where(F.col("before").isNull() | (F.col("pb") < F.col("before")))
    return points.join(front.select("pa", "pb"), (F.col(a) == F.col("pa")) & (F.col(b) == F.col("pb")), "left_semi")


def plateau(swept: DataFrame, best: DataFrame) -> DataFrame:
    """Points with the same errors and calls as the best."""
    key = best.select("fn", "fp", "to_llm").distinct()
    return swept.join(key, ["fn", "fp", "to_llm"], "left_semi")
