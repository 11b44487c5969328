"""Evidence, answers and cached model calls, as batches over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.functions import text as T


def evidence(hits: DataFrame, chunks: DataFrame, top: int = 3, max_chars: int = 700) -> DataFrame:
    """query_id, evidence (array by rank) and block (numbered text) of the first `top` hits. hits:
    query_id, id, rank, score; chunks: chunk rows. A missing is_latest counts as latest."""
    c = chunks.select(
        F.col("chunk_id").alias("id"), T.clean_doc_name(F.col("doc_display_name")).alias("name"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("effective_date", F.lit("")).alias("date"),
        F.coalesce("text", F.lit("")).alias("text"), "doc_type", F.coalesce("metadata.is_latest", F.lit(True)).alias("is_latest"),
    )
    j = hits.where(F.col("rank") <= top).join(c, "id")
    dated = F.when(F.col("date") != "", F.concat(F.lit("("), F.col("date"), F.lit(" 시행)")))
    header = F.concat_ws(" ", T.filled(F.col("name")), F.when((F.col("section") != "") & (F.col("section") != "FAQ"), F.col("section")), dated)
    e = F.struct("rank", F.col("id").alias("chunk_id"), header.alias("header"), "text", "doc_type", "is_latest", F.round("score", 6).alias("score"))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(e)).alias("evidence"))  # at most `top` a question
    line = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["header"], F.lit("\n"), F.substring(x["text"], 1, max_chars))
    return g.withColumn("block", F.array_join(F.transform("evidence", line), "\n\n"))


def gate_evidence(hits: DataFrame, chunks: DataFrame, top: int = 3, max_chars: int = 700) -> DataFrame:
    """query_id, block: what a verdict is asked on. Unlike `evidence`, the name stands as it is, without a date."""
    c = chunks.select(F.col("chunk_id").alias("id"), F.concat_ws(" ", F.nullif("doc_display_name", F.lit("")), F.nullif("section", F.lit(""))).alias("header"), F.coalesce("text", F.lit("")).alias("text"))
    j = hits.where(F.col("rank") <= top).join(c, "id", "left")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("header", F.lit("")), F.lit("\n"), F.coalesce(F.substring("text", 1, max_chars), F.lit("")))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("e"))  # at most `top` a question
    return g.select("query_id", F.array_join(F.transform("e", lambda x: x["line"]), "\n\n").alias("block"))


def build_answers(decisions: DataFrame, evidence_rows: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """query_id, decision, stage, reason, answer, evidence, has_old, json. A refusal by wording has no
    evidence; an answer comes from `generated` (query_id, answer), and without one is the safe message."""
    j = decisions.join(evidence_rows.select("query_id", "evidence"), "query_id", "left")
    j = j.join(generated.select("query_id", F.col("answer").alias("g")), "query_id", "left") if generated is not None else j.withColumn("g", F.lit(None).cast("string"))
    shown = F.when(F.col("stage") == "pattern", None).otherwise(F.col("evidence"))
    empty = F.slice(F.col("evidence"), 1, 0)
    j = j.withColumn("evidence", F.coalesce(shown, empty, F.filter("evidence", lambda x: F.lit(False))))
    text = F.when(F.col("decision") == "answer", F.coalesce("g", F.lit("근거를 확인해 주십시오."))).otherwise(F.lit(""))
    old = F.coalesce(F.exists("evidence", lambda x: ~x["is_latest"]), F.lit(False))
    out = j.select("query_id", "decision", "stage", "reason", text.alias("answer"), F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), "evidence", old.alias("has_old"))
    return out.withColumn("json", F.to_json(F.struct("query_id", "decision", "stage", "reason", "answer", "evidence")))


#: Marks and headings of an answer as shown.
MARKS = "①②③④⑤⑥⑦⑧⑨⑩"
ANSWERED, REFUSED, EVIDENCE, STALE = "[답변]", "[답변 불가]", "[근거]", "  ※ 최신본이 아닐 수 있음"


def display(answers: DataFrame, max_chars: int = 600) -> DataFrame:
    """query_id, display: an answer, or why there is none, and its evidence as it stands, up to `max_chars`
    of each piece; what isn't the latest is marked. answers: rows of build_answers."""
    mark = lambda x: F.when(x["rank"] <= len(MARKS), F.substr(F.lit(MARKS), x["rank"], F.lit(1))).otherwise(F.concat(F.lit("["), x["rank"].cast("string"), F.lit("]")))
    body = lambda x: F.concat(F.substring(x["text"], 1, max_chars), F.when(F.length(x["text"]) > max_chars, " …").otherwise(""))
    one = lambda x: F.concat(F.lit("\n\n"), mark(x), F.lit(" "), x["header"], F.when(x["is_latest"], "").otherwise(STALE), F.lit("\n   "), body(x))
    why = F.concat(F.lit("\n\n(사유: "), "reason", F.lit(" / 판정: "), "stage", F.lit(")"))
    head = F.when(F.col("decision") == "answer", F.concat(F.lit(f"{ANSWERED}\n"), "answer")).otherwise(F.concat(F.lit(f"{REFUSED}\n"), "answer", F.coalesce(why, F.lit(""))))
    shown = F.when(F.size("evidence") > 0, F.concat(F.lit(f"\n\n{EVIDENCE}"), F.array_join(F.transform("evidence", one), ""))).otherwise("")
    return answers.select("query_id", F.concat(head, F.coalesce(shown, F.lit(""))).alias("display"))


def grown_cache(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache (key, ...) with the results (same columns) of keys it lacks; the first of each key by its values."""
    new = results.join(cache.select("key").distinct(), "key", "left_anti")
    rest = [c for c in cache.columns if c != "key"]
    first = new.groupBy("key").agg(F.min(F.struct(*rest)).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in rest])
    return cache.unionByName(first.select(*cache.columns))


def missing_calls(requests: DataFrame, cache: DataFrame, *parts: Column, separator: str = "|") -> DataFrame:
    """requests with their key, those that the cache (key, ...) lacks: only these need a call."""
    keyed = requests.withColumn("key", T.cache_key(*parts, separator=separator))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def sentence_support(verdicts: DataFrame) -> DataFrame:
    """id, n_sentences, n_unsupported, hallucinated, from (id, sentence, supported)."""
    bad = ~F.coalesce("supported", F.lit(False))
    return verdicts.groupBy("id").agg(F.count("*").alias("n_sentences"), F.count(F.when(bad, 1)).alias("n_unsupported"), F.max(bad).alias("hallucinated"))


def criterion_rates(scores: DataFrame, criteria: list[str], by: str) -> DataFrame:
    """by, criterion, n_pass, n_fail, n_na, pass_rate over those judged; unknown verdicts count as na."""
    long = scores.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.when(F.col(c).isin("pass", "fail", "na"), F.col(c)).otherwise("na").alias("v")) for c in criteria])).alias("x"))
    n = lambda v: F.count(F.when(F.col("x.v") == v, 1))
    g = long.groupBy(by, F.col("x.criterion").alias("criterion")).agg(n("pass").alias("n_pass"), n("fail").alias("n_fail"), n("na").alias("n_na"))
    return g.withColumn("pass_rate", F.round(F.when(F.col("n_pass") + F.col("n_fail") > 0, F.col("n_pass") / (F.col("n_pass") + F.col("n_fail"))).otherwise(F.lit(0.0)), 4))
