"""Rules, signals, thresholds and agreement against published results; fixed lists by small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gyeol import session
from gyeol.functions import text as T
from gyeol.operators import answer, catalog, gate, history, layout, quality
from gyeol.plans import quality as plans_quality
from gyeol.sources import tables
from gyeol.streaming import ingest
from tests import golden

NAMES = ("grounded", "same_product", "numbers", "unknown_told", "usable")
SCHEMA = "query_id string, question string, expected boolean, want string, stage string, reason string, score_top1 double, gap_1_2 double, gap_1_5 double, std_top5 double, blank_ratio double, doc_concentration int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(golden.QUESTIONS, SCHEMA).withColumn("n_hits", F.lit(10))


def test_rules_and_signals(spark, rows):
    none = spark.createDataFrame([], "query_id string, verdict string")
    got = {r.query_id: r for r in gate.judge(rows, none, 0.75, 0.08, 0.2).collect()}
    for k, _, _, want, stage, reason, *_ in golden.QUESTIONS:
        if stage != "llm":
            assert (got[k].decision, got[k].stage, got[k].reason) == (want, stage, reason), k
        else:
            assert got[k].stage == "llm", k


def test_confusion_by_stage(rows):
    r0, r1 = gate.question_rule(F.col("question")).isNotNull(), gate.signal_rule(F.col("question"), 0.75, 0.08, 0.2).isNotNull()
    for refused, want in ((r0, (22, 11, 0, 20, 0.3333, 0.0, 0.8, 0.8333)), (r0 | r1, (30, 3, 1, 19, 0.0909, 0.05, 0.9375, 0.9295)), (F.col("want") == "refuse", (32, 1, 2, 18, 0.0303, 0.1, 0.9552, 0.9348))):
        c = gate.confusion(rows, F.col("expected"), refused).first()
        assert (c.tp, c.fn, c.fp, c.tn, c.false_answer_rate, c.over_refusal_rate, c.f1, c.balanced_accuracy) == want


def test_auc_of_signals(rows):
    names = ["score_top1", "gap_1_2", "gap_1_5", "std_top5", "blank_ratio", "doc_concentration"]
    got = {r.signal: round(r.auc, 3) for r in gate.auc(rows.withColumn("answer", ~F.col("expected")), "answer", names).collect()}
    assert [got[n] for n in names] == [0.722, 0.72, 0.777, 0.758, 0.4, 0.37]


def test_grid_of_thresholds(spark, rows):
    points = spark.createDataFrame([g[:3] for g in golden.GRID], "hard_top1 double, hard_gap15 double, hard_blank double")
    got = {(r.hard_top1, r.hard_gap15, r.hard_blank, r.to_llm, r.tp, r.fn, r.fp, r.tn) for r in gate.sweep(rows, points, F.col("expected")).collect()}
    assert got == set(golden.GRID) and len(got) == 96


def test_agreement_of_raters(spark):
    cells = [(n, r[2 + 2 * i], r[3 + 2 * i]) for r in golden.RATINGS if not r[1] for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(cells, "criterion string, human string, drafted string")
    got = {r.criterion: (r.n, round(r.agreement, 3), round(r.kappa, 3)) for r in gate.kappa(df, "human", "drafted", ["criterion"]).collect()}
    assert got == {"grounded": (20, 0.55, 0.0), "same_product": (20, 0.75, 0.5), "numbers": (20, 0.85, 0.727), "unknown_told": (20, 0.75, 0.167), "usable": (20, 0.7, 0.118)}


def test_staircases_are_linear_and_right(spark):
    """Days recorded newest first gave a square of bounds."""
    import pandas as pd

    for n in (200, 2000):
        for knowns in (list(range(n, 0, -1)), list(range(n)), random.Random(n).sample(range(n), n)):
            steps = history._staircases(pd.Series([list(range(n))]), pd.Series([knowns]))[0]
            assert sum(len(s) for s in steps) <= 2 * n
    rng = random.Random(9)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    ups = [("k", x, dt.datetime(2024, 6, 1) + dt.timedelta(hours=i), rng.choice("xy")) for i, x in enumerate(reversed(days))]
    led = history.bitemporal_ledger(spark.createDataFrame(ups, "k string, d date, r timestamp, s string"), "k", "d", "r", ["s"]).collect()
    for i in range(0, 40, 3):
        at = dt.datetime(2024, 6, 1) + dt.timedelta(hours=i)
        known = sorted((u[1], u[3]) for u in ups if u[2] <= at)
        open_ = sorted((r.valid_from, r.s) for r in led if r.recorded_from <= at and (r.recorded_to is None or at < r.recorded_to))
        assert open_ == known


def test_words_titles_and_phrases(spark):
    df = spark.createDataFrame([("예금 이자는 언제 얼마 나오나요 하나은행",)], "q string")
    assert df.select(T.terms(F.col("q"))).first()[0] == ["예금", "이자", "나오나요"]
    line = lambda s: spark.createDataFrame([(s,)], "s string").select(F.col("s").rlike(layout.NOT_TITLE), F.col("s").rlike(layout.NOT_SUBTITLE)).first()
    assert tuple(line("준법감시인 심의필")) == (True, False) and tuple(line("이 약정서는 내용입니다")) == (False, True) and tuple(line("예금 안내")) == (False, False) and tuple(line("3 / 12")) == (True, False)
    long = "가나다라마바사 " * 30
    got = spark.createDataFrame([(long,), (long + "청약철회권",)], "t string").select(quality.suitable(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_families_of_general_terms(spark):
    docs = spark.createDataFrame([("a", "약관", "예금거래 기본약관", "deposit", True, True), ("b", "약관", "약관", "e_banking", True, True)], "doc_id string, doc_type string, title string, category string, is_parsable boolean, is_latest boolean")
    assert {r.doc_id: (r.bucket, r.name) for r in catalog.catalog(docs).collect()}["a"] == ("general", "예금")


def test_dates_and_labels_that_are_wrong(spark, tmp_path):
    """Rows for the checks that find nothing in the given tables."""
    day = dt.date
    docs = [("a", True, "약관", day(2024, 1, 1), day(2024, 3, 1)), ("b", True, "약관", day(2024, 1, 1), day(2021, 1, 1)), ("c", True, "약관", day(2024, 1, 1), day(2024, 1, 1)), ("d", True, "약관", None, day(2024, 1, 1)), ("e", False, "약관", day(2024, 1, 1), day(2021, 1, 1))]
    df = spark.createDataFrame(docs, "doc_id string, is_parsable boolean, doc_type string, effective_date date, compliance_date date")
    assert {(r.doc_id, r.gap_days, r.issue) for r in quality.date_issues(df).collect()} == {("a", -60, "approved_later"), ("b", 1095, "long_ago")}
    spark.createDataFrame([("c1",), ("c2",), (None,)], "chunk_id string").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = [("q1", "묻습니다", "c1|c1"), ("q1", "묻습니다", "c2"), ("q2", " ", "c9"), ("q3", "묻습니다", ""), ("q4", None, "c1")]
    spark.createDataFrame([(*r, None, None) for r in rows], "query_id string, question string, relevant_chunk_ids string, difficulty string, doc_type string").write.parquet(f"{tmp_path}/retrieval_eval.parquet")
    got = sorted((r.query_id, r.issue) for r in plans_quality.dq_eval_set(spark, str(tmp_path)).collect())
    assert got == [("q1", "label_twice"), ("q1", "repeated_id"), ("q2", "empty_question"), ("q2", "missing_chunk"), ("q3", "no_label"), ("q4", "empty_question")]


def test_triage_compliance(spark):
    t = "앞 2024 - 약관 - 0123 호 (2024.3.5) 뒤"
    r = spark.createDataFrame([(t,), ("2024-상품-1호 (2024.3.5)",)], "t string").select(T.compliance_date(F.col("t"), 30, T.TERMS_COMPLIANCE), T.compliance_date(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [(dt.date(2024, 3, 5), dt.date(2024, 3, 5)), (None, dt.date(2024, 3, 5))]


def test_expanded_labels(spark):
    src = spark.createDataFrame([("q", "a"), ("lost", "z"), ("none", None)], "query_id string, source string")
    hits = spark.createDataFrame([("q", c, i) for i, c in enumerate("bacdef", 1)] + [("lost", "b", 1)], "query_id string, chunk_id string, rank int")
    yes = spark.createDataFrame([("q", "c"), ("q", "b"), ("q", "f"), ("q", "c"), ("lost", "b")], "query_id string, chunk_id string")
    got = {r.query_id: (r.found_rank, r.n_added, r.relevant) for r in quality.expand_labels(src, hits, yes).collect()}
    assert got == {"q": (2, 2, "a|b|c"), "lost": (0, 0, "z"), "none": (0, 0, "")}


def test_evidence_of_the_gate(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "x", 3), ("q", "a", 4)], "query_id string, id string, rank int")
    c = spark.createDataFrame([("a", "약관", "제1조", "글" * 800), ("b", None, "", None)], "chunk_id string, doc_display_name string, section string, text string")
    assert answer.gate_evidence(hits, c).first().block == "[1] 약관 제1조\n" + "글" * 700 + "\n\n[2] \n\n\n[3] \n"


def test_streams_keep_no_state_of_rows(spark, tmp_path):
    for i, rows in enumerate(([("q1", "a1"), ("q2", "a2")], [("q1", "a1"), ("q3", "a3"), ("q3", "a3")], [("q2", "a2")])):
        spark.createDataFrame(rows, "question string, answer string").coalesce(1).write.parquet(f"{tmp_path}/faq_records.parquet/{i}")
    schema = "question string, answer string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/faq_records.parquet")
    got = ingest.run_new_to_table(ingest.new_faq(stream), "t", ["content_hash"])
    assert got.count() == 3 and got.columns == ["content_hash", "n_chars"]


def test_stored_tables_follow_their_files(spark, tmp_path):
    path, made = f"{tmp_path}/t", []

    def build():
        made.append(1)
        return [spark.read.parquet(path).selectExpr("sum(id) AS s")]

    spark.range(3).write.parquet(path)
    once = [session.stored(spark, "x", session.fingerprint(spark.read.parquet(path)), build)[0].first().s for _ in range(2)]
    spark.range(5).write.mode("overwrite").parquet(path)
    assert once == [3, 3] and session.stored(spark, "x", session.fingerprint(spark.read.parquet(path)), build)[0].first().s == 10 and len(made) == 2
    m = session.materialize(spark.range(2))
    session.drop_materialized(m)
    assert not [f for f in m.inputFiles() if session.exists(spark, f)]


def test_report_files(spark, tmp_path):
    for n in ("eval_2024-01-02.csv", "eval_2024-03-01.csv", "other.csv"):
        (tmp_path / n).write_text("a")
    assert tables.latest_file(spark, f"file://{tmp_path}/eval_*.csv").endswith("eval_2024-03-01.csv") and tables.latest_file(spark, f"file://{tmp_path}/none*") is None
    assert tables.cache_name("m-4.1", 0.5) == "m-41_05"
