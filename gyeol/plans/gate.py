"""Queries of the gate and its measures. Signals come from the sparse search of the questions of
retrieval_eval; hard questions stand for those to be refused, and half the verdicts, by a hash of the
question id, for cached ones: this exercises arithmetic, not quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import text as T
from gyeol.operators import gate as G
from gyeol.plans.search import _CHUNK_INDEX, _QUESTIONS, _sparse, chunk_hits
from gyeol.plans.text import chunks_once
from gyeol.session import materialize
from gyeol.sources.tables import table

TOP1, GAP15, BLANK = 35.0, 4.0, 0.6
#: 9 x 7 x 8 points; scores here are sums of weights, so shares of a score are taken of 60.
WIDE = (tuple(60 * x / 100 for x in range(50, 95, 5)), tuple(60 * x / 100 for x in (2, 3, 5, 8, 12, 15, 20)), (0.05, 0.1, 0.15, 0.2, 0.35, 0.5, 0.6, 0.8))
GRID = ((25.0, 30.0, 35.0, 40.0, 45.0, 50.0), (1.0, 2.5, 4.0, 8.0), (0.2, 0.4, 0.6, 0.8))


def _signals(spark: SparkSession, d: str, hits: DataFrame | None = None) -> DataFrame:
    q = table(spark, d, "retrieval_eval").select("query_id", "question", "difficulty", "doc_type")
    hits = (materialize(chunk_hits(spark, d, 10), "hits") if hits is None else hits).select("query_id", "id", "rank", "score")
    wanted = hits.select(F.col("id").alias("chunk_id")).distinct()  # texts of hits only
    s = G.signals(q, hits, chunks_once(spark, d, "text").join(wanted, "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), "text"))
    return s.withColumn("expected", F.coalesce(F.col("difficulty") == "hard", F.lit(False)))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieval_eval").withColumn("h", F.md5("query_id")).where("h < 'c'")
    return r.select("query_id", F.when(F.col("h") < "8", "ANSWER").otherwise("REFUSE").alias("verdict"))


def gate_rules(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieval_eval")
    return r.select("query_id", G.question_rule(F.col("question")).alias("rule"), F.col("question").rlike(G.VALUE_QUESTION).alias("asks_value"))


def gate_signals(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d)
    return s.select("query_id", *[F.round(c, 4).alias(c) for c in ("score_top1", "gap_1_2", "gap_1_5", "std_top5")], F.round("blank_ratio", 2).alias("blank_ratio"), "doc_concentration", "n_hits")


def gate_decisions(spark: SparkSession, d: str, hits: DataFrame | None = None) -> DataFrame:
    return G.judge(_signals(spark, d, hits), _verdicts(spark, d), TOP1, GAP15, BLANK)


def gate_no_verdicts(spark: SparkSession, d: str) -> DataFrame:
    j = G.judge(_signals(spark, d), None, TOP1, GAP15, BLANK)
    return j.groupBy("decision", "stage", "reason").agg(F.count("*").alias("n"))


def gate_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Confusion with rules alone, with signals, and with verdicts."""
    s = materialize(_signals(spark, d).join(_verdicts(spark, d), "query_id", "left"), "signals")
    r0, r1 = G.question_rule(F.col("question")).isNotNull(), G.signal_rule(F.col("question"), TOP1, GAP15, BLANK).isNotNull()
    refused = ~F.upper(F.coalesce("verdict", F.lit(""))).startswith("ANSWER")
    x = s.select("expected", F.explode(F.array(*[F.struct(F.lit(n).alias("config"), c.alias("refused")) for n, c in (("0", r0), ("0+1", r0 | r1), ("0+1+2", r0 | r1 | refused))])).alias("c")).select("expected", "c.*")
    return G.confusion(x, F.col("expected"), F.col("refused"), ["config"])


def gate_auc(spark: SparkSession, d: str) -> DataFrame:
    names = ["score_top1", "gap_1_2", "gap_1_5", "std_top5", "blank_ratio", "doc_concentration"]
    s = _signals(spark, d).select("expected", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in names])  # else sums in another order part ties
    return G.auc(s, "expected", names)


def _swept(spark: SparkSession, d: str) -> DataFrame:
    return G.sweep(_signals(spark, d), G.grid(spark, *GRID), F.col("expected"), _verdicts(spark, d))


def gate_grid(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d)


def gate_grid_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide grid of 504 points."""
    return G.sweep(_signals(spark, d), G.grid(spark, *WIDE), F.col("expected"), _verdicts(spark, d))


def gate_best(spark: SparkSession, d: str) -> DataFrame:
    swept = materialize(_swept(spark, d), "swept")
    return G.best_per_weight(swept, (1, 1.5, 2, 3, 5)).select("weight", "hard_top1", "hard_gap15", "hard_blank", "cost", "fn", "fp", "to_llm")


def gate_pareto(spark: SparkSession, d: str) -> DataFrame:
    swept = materialize(_swept(spark, d), "swept")
    return G.pareto(swept, "false_answer_rate", "over_refusal_rate").select("hard_top1", "hard_gap15", "hard_blank", "false_answer_rate", "over_refusal_rate")


def gate_plateau(spark: SparkSession, d: str) -> DataFrame:
    """Points as good as the best for weight 2: their number, edges, the middle one, which is recommended,
    and whether an edge of the grid is touched, which is a warning."""
    swept = materialize(_swept(spark, d), "swept")
    p = G.plateau(swept, G.best_per_weight(swept, (2,)))
    edges = [F.min("hard_top1").alias("top1_from"), F.max("hard_top1").alias("top1_to"), F.min("hard_gap15").alias("gap_from"), F.max("hard_gap15").alias("gap_to")]
    points = F.array_sort(F.collect_list(F.struct("hard_top1", "hard_gap15", "hard_blank")))  # points of a grid
    middle = F.element_at(points, F.floor(F.size(points) / 2).cast("int") + 1)
    return p.agg(F.count("*").alias("n_points"), *edges, middle.alias("m")).select("*", "m.hard_top1", "m.hard_gap15", "m.hard_blank").drop("m").withColumn("at_edge", (F.col("top1_from") == min(GRID[0])) | (F.col("top1_to") == max(GRID[0])) | (F.col("gap_from") == min(GRID[1])) | (F.col("gap_to") == max(GRID[1])))


def gate_rule_change(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose rule differs without the general-rule exception."""
    r = table(spark, d, "retrieval_eval")
    q = F.col("question")
    stricter = F.when(q.rlike(G.OWN_ATTRIBUTE) | ((q.rlike(G.OWN_ACCOUNT) | q.rlike(G.FIRST_PERSON)) & q.rlike(G.ASKS_PERSONAL)), "personalized").otherwise(G.question_rule(q))
    x = r.select("query_id", G.question_rule(q).alias("was"), stricter.alias("now"))
    return x.where(~F.col("was").eqNullSafe(F.col("now")))


def agreement_structure(spark: SparkSession, d: str) -> DataFrame:
    """Declared against detected structure, over all documents and by type."""
    b = table(spark, d, "bank_documents").where("text is not null")
    x = b.select("doc_type", F.lower("structure").alias("declared"), T.structure(F.col("text")).alias("detected"))
    return G.kappa(x, "declared", "detected", ["doc_type"])


def agreement_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Expected against decided: agreement, refusals missed and refusals over, by difficulty."""
    hits = materialize(chunk_hits(spark, d, 10), "hits")
    s = _signals(spark, d, hits).select("query_id", "difficulty", "expected").join(gate_decisions(spark, d, hits), "query_id")
    r = F.col("decision") == "refuse"
    return s.groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg((r == F.col("expected")).cast("double")), 6).alias("agreement"), F.count(F.when(F.col("expected") & ~r, 1)).alias("missed"), F.count(F.when(~F.col("expected") & r, 1)).alias("over"))


QUERIES = {
    "gate_rules": gate_rules, "gate_signals": gate_signals, "gate_decisions": gate_decisions, "gate_no_verdicts": gate_no_verdicts, "gate_ablation": gate_ablation, "gate_auc": gate_auc,
    "gate_grid": gate_grid, "gate_grid_wide": gate_grid_wide, "gate_best": gate_best, "gate_pareto": gate_pareto, "gate_plateau": gate_plateau, "gate_rule_change": gate_rule_change,
    "agreement_structure": agreement_structure, "agreement_by_difficulty": agreement_by_difficulty,
}

_M = lambda p: f"regexp_matches(trim(question), '{p}')"
_R0 = f"CASE WHEN {_M(G.OWN_ATTRIBUTE)} OR (({_M(G.OWN_ACCOUNT)} OR {_M(G.FIRST_PERSON)}) AND {_M(G.ASKS_PERSONAL)} AND NOT {_M(G.GENERAL_RULE)}) THEN 'personalized' WHEN {_M(G.TIME_VARIANT)} THEN 'time_variant' WHEN {_M(G.OUT_OF_SCOPE)} THEN 'out_of_scope' END"
_R0S = f"CASE WHEN {_M(G.OWN_ATTRIBUTE)} OR (({_M(G.OWN_ACCOUNT)} OR {_M(G.FIRST_PERSON)}) AND {_M(G.ASKS_PERSONAL)}) THEN 'personalized' ELSE ({_R0}) END"
_BL = r"regexp_matches(coalesce(text, ''), '\(\s*\)|\(\s*%\s*\)|（\s*）|_{3,}|\.{5,}|☐|□')"
_SIG = f"""WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 10)},
hb AS (SELECT sp.*, {_BL} AS blank FROM sp LEFT JOIN c ON sp.id = c.chunk_id),
sg AS (SELECT r.query_id, any_value(question) AS question, any_value(difficulty) AS difficulty, coalesce(any_value(difficulty) = 'hard', false) AS expected, coalesce(max(score) FILTER (rank = 1), 0) AS score_top1,
  coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 0) AS gap_1_2, coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 5), 0) AS gap_1_5,
  coalesce(stddev_pop(score) FILTER (rank <= 5), 0) AS std_top5, coalesce(count(*) FILTER (rank <= 5 AND blank) / nullif(count(*) FILTER (rank <= 5), 0)::DOUBLE, 0) AS blank_ratio,
  count(DISTINCT regexp_replace(id, '_c[^_]*$', '')) FILTER (rank <= 5) AS doc_concentration, count(id) AS n_hits FROM retrieval_eval r LEFT JOIN hb ON r.query_id = hb.query_id GROUP BY r.query_id),
vd AS (SELECT query_id, CASE WHEN md5(query_id) < '8' THEN 'ANSWER' ELSE 'REFUSE' END AS verdict FROM retrieval_eval WHERE md5(query_id) < 'c')"""
_R1 = lambda a, b, c: f"CASE WHEN n_hits = 0 THEN 'out_of_scope' WHEN score_top1 < {a} AND gap_1_5 < {b} THEN 'low_confidence' WHEN blank_ratio >= {c} AND regexp_matches(question, '{G.VALUE_QUESTION}') THEN 'blank_value' END"
_JUDGED = _SIG + f", j AS (SELECT sg.*, {_R0} AS r0, {_R1(TOP1, GAP15, BLANK)} AS r1, coalesce(verdict, '') = 'ANSWER' AS ok FROM sg LEFT JOIN vd USING (query_id))"
_DECIDED = """SELECT query_id, CASE WHEN r0 IS NOT NULL OR r1 IS NOT NULL OR NOT ok THEN 'refuse' ELSE 'answer' END AS decision, CASE WHEN r0 IS NOT NULL THEN 'pattern' WHEN r1 IS NOT NULL THEN 'retrieval' ELSE 'llm' END AS stage, coalesce(r0, r1, CASE WHEN NOT ok THEN 'no_evidence' END) AS reason FROM j"""
_D = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0 END)"
_RATES = f"""round({_D('tp + tn', 'tp + fn + fp + tn')}, 4) AS accuracy, round({_D('fn', 'tp + fn')}, 4) AS false_answer_rate, round({_D('fp', 'fp + tn')}, 4) AS over_refusal_rate, round({_D('tp', 'tp + fp')}, 4) AS precision,
round({_D('2.0::DOUBLE * tp', '2 * tp + fp + fn')}, 4) AS f1, round(({_D('tp', 'tp + fn')} + {_D('tn', 'tn + fp')}) / 2, 4) AS balanced_accuracy"""
_COUNTS = "count(*) FILTER (expected AND refused) AS tp, count(*) FILTER (expected AND NOT refused) AS fn, count(*) FILTER (NOT expected AND refused) AS fp, count(*) FILTER (NOT expected AND NOT refused) AS tn"
_GRID = _SIG + ", gr AS (SELECT * FROM (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in GRID[0]) + "]) AS hard_top1), (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in GRID[1]) + "]) AS hard_gap15), (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in GRID[2]) + "]) AS hard_blank)), " + f"""
gx AS (SELECT gr.*, expected, ({_R0}) IS NOT NULL AS r0, ({_R1('hard_top1', 'hard_gap15', 'hard_blank')}) IS NOT NULL AS r1, coalesce(verdict, '') = 'ANSWER' AS ok FROM sg LEFT JOIN vd USING (query_id), gr),
gs AS (SELECT hard_top1, hard_gap15, hard_blank, to_llm, tp, fn, fp, tn, {_RATES} FROM (SELECT hard_top1, hard_gap15, hard_blank, count(*) FILTER (NOT r0 AND NOT r1) AS to_llm, {_COUNTS} FROM (SELECT *, r0 OR r1 OR NOT ok AS refused FROM gx) GROUP BY 1, 2, 3))"""
_points = lambda g: "gr AS (SELECT * FROM (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in g[0]) + "]) AS hard_top1), (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in g[1]) + "]) AS hard_gap15), (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in g[2]) + "]) AS hard_blank))"
_AUC = ["score_top1", "gap_1_2", "gap_1_5", "std_top5", "blank_ratio", "doc_concentration"]
_COST = "round(false_answer_rate * {0} + over_refusal_rate + 0.1::DOUBLE * (to_llm / (tp + fn + fp + tn)::DOUBLE), 5)"

SQL = {
    "gate_rules": f"SELECT query_id, {_R0} AS rule, regexp_matches(question, '{G.VALUE_QUESTION}') AS asks_value FROM retrieval_eval",
    "gate_signals": f"{_SIG} SELECT query_id, round(score_top1, 4) AS score_top1, round(gap_1_2, 4) AS gap_1_2, round(gap_1_5, 4) AS gap_1_5, round(std_top5, 4) AS std_top5, round(blank_ratio, 2) AS blank_ratio, doc_concentration, n_hits FROM sg",
    "gate_decisions": f"{_JUDGED} {_DECIDED}",
    "gate_no_verdicts": f"{_JUDGED} SELECT decision, stage, reason, count(*) AS n FROM (SELECT 'refuse' AS decision, CASE WHEN r0 IS NOT NULL THEN 'pattern' WHEN r1 IS NOT NULL THEN 'retrieval' ELSE 'retrieval_fallback' END AS stage, coalesce(r0, r1, 'low_confidence') AS reason FROM j) GROUP BY 1, 2, 3",
    "gate_ablation": f"{_JUDGED} SELECT config, tp, fn, fp, tn, {_RATES} FROM (SELECT config, {_COUNTS} FROM (SELECT '0' AS config, expected, r0 IS NOT NULL AS refused FROM j UNION ALL SELECT '0+1', expected, r0 IS NOT NULL OR r1 IS NOT NULL FROM j UNION ALL SELECT '0+1+2', expected, r0 IS NOT NULL OR r1 IS NOT NULL OR NOT ok FROM j) GROUP BY 1)",
    "gate_auc": f"{_SIG}, l AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, expected, round({s}::DOUBLE, 9) AS v FROM sg" for s in _AUC) + ") SELECT s.signal, coalesce(round(avg(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5::DOUBLE ELSE 0 END), 6), 0.5::DOUBLE) AS auc FROM (SELECT DISTINCT signal FROM l) s LEFT JOIN l a ON a.signal = s.signal AND a.expected LEFT JOIN l b ON b.signal = s.signal AND NOT b.expected GROUP BY 1",
    "gate_grid": f"{_GRID} SELECT * FROM gs",
    "gate_grid_wide": f"{_GRID.replace(_points(GRID), _points(WIDE))} SELECT * FROM gs",
    "gate_best": f"{_GRID}, w AS (SELECT unnest([1.0::DOUBLE, 1.5, 2, 3, 5]) AS weight), k AS (SELECT weight, gs.*, {_COST.format('weight')} AS cost FROM gs, w) SELECT weight, hard_top1, hard_gap15, hard_blank, cost, fn, fp, to_llm FROM (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY cost, balanced_accuracy DESC, hard_top1, hard_gap15, hard_blank) AS rn FROM k) WHERE rn = 1",
    "gate_pareto": f"{_GRID} SELECT hard_top1, hard_gap15, hard_blank, false_answer_rate, over_refusal_rate FROM gs a WHERE NOT EXISTS (SELECT 1 FROM gs b WHERE b.false_answer_rate <= a.false_answer_rate AND b.over_refusal_rate <= a.over_refusal_rate AND (b.false_answer_rate < a.false_answer_rate OR b.over_refusal_rate < a.over_refusal_rate))",
    "gate_plateau": f"{_GRID}, b AS (SELECT fn, fp, to_llm FROM gs ORDER BY {_COST.format('2.0')}, balanced_accuracy DESC, hard_top1, hard_gap15, hard_blank LIMIT 1), p AS (SELECT gs.* FROM gs JOIN b USING (fn, fp, to_llm)) SELECT count(*) AS n_points, min(hard_top1) AS top1_from, max(hard_top1) AS top1_to, min(hard_gap15) AS gap_from, max(hard_gap15) AS gap_to, min(hard_top1) = {min(GRID[0])} OR max(hard_top1) = {max(GRID[0])} OR min(hard_gap15) = {min(GRID[1])} OR max(hard_gap15) = {max(GRID[1])} AS at_edge, any_value(hard_top1) FILTER (i = n // 2 + 1) AS hard_top1, any_value(hard_gap15) FILTER (i = n // 2 + 1) AS hard_gap15, any_value(hard_blank) FILTER (i = n // 2 + 1) AS hard_blank FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY hard_top1, hard_gap15, hard_blank) AS i FROM p)",
    "gate_rule_change": f"SELECT * FROM (SELECT query_id, {_R0} AS was, {_R0S} AS now FROM retrieval_eval) WHERE was IS DISTINCT FROM now",
    "agreement_structure": r"""WITH n AS (SELECT doc_type, lower(structure) AS x, len(regexp_extract_all(text, '제[\s\p{Z}]*\p{Nd}+[\s\p{Z}]*조')) AS a, len(regexp_extract_all(text, '[①-⑯]')) AS c, len(regexp_extract_all(text, '(?m)^[\s\p{Z}]*\p{Nd}+\.[\s\p{Z}]')) AS m FROM bank_documents WHERE text IS NOT NULL),
        r AS (SELECT doc_type, x, CASE WHEN a >= 5 THEN 'article' WHEN c >= 10 THEN 'clause' WHEN m >= 5 THEN 'numbered' ELSE 'flat' END AS y FROM n), t AS (SELECT doc_type, count(*) AS n, count(*) FILTER (x = y) / count(*)::DOUBLE AS po FROM r GROUP BY 1),
        p AS (SELECT doc_type, sum(cx * cy) AS s FROM (SELECT doc_type, x AS l, count(*)::DOUBLE AS cx FROM r GROUP BY 1, 2) JOIN (SELECT doc_type, y AS l, count(*)::DOUBLE AS cy FROM r GROUP BY 1, 2) USING (doc_type, l) GROUP BY 1),
        k AS (SELECT doc_type, n, po, coalesce(s, 0) / (n * n)::DOUBLE AS pe FROM t LEFT JOIN p USING (doc_type)) SELECT doc_type, n, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k""",
    "agreement_by_difficulty": f"{_JUDGED}, dd AS (SELECT query_id, r0 IS NOT NULL OR r1 IS NOT NULL OR NOT ok AS r, expected, difficulty FROM j) SELECT difficulty, count(*) AS n, round(avg((r = expected)::INT), 6) AS agreement, count(*) FILTER (expected AND NOT r) AS missed, count(*) FILTER (NOT expected AND r) AS over FROM dd GROUP BY 1",
}
