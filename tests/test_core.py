"""Core operators against plain Python on small fixtures."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from gyeol.functions import text as T
from gyeol.operators import answer, catalog, chunking, gate, history, quality, retrieval, snapshots
from gyeol.sources import files, tables
from tests.conftest import SMALL

DAY = dt.date(2024, 1, 1)
NOW = dt.datetime(2024, 6, 1)
day = lambda n: DAY + dt.timedelta(days=n)
at = lambda n: NOW + dt.timedelta(hours=n)


# History


def state_at(updates, key, valid, recorded):
    """The state of a day as known at a recorded time, by definition."""
    known = [u for u in updates if u[0] == key and u[1] <= valid and u[2] <= recorded]
    return max(known, key=lambda u: (u[1], u[2]))[3] if known else None


def test_ledger_against_definition(spark):
    rng = random.Random(5)
    ups = list({(k, day(rng.randrange(12)), at(rng.randrange(200))): None for k in "ab" for _ in range(40)})
    ups = [(*u, rng.choice("xyz")) for u in ups]
    df = spark.createDataFrame(ups + ups[:7], "k string, d date, r timestamp, s string").withColumn("valid_from", F.lit(0)).withColumn("_k", F.lit("clash"))
    led = [tuple(r) for r in history.bitemporal_ledger(df, "k", "d", "r", ["s"]).select("k", "s", "valid_from", "valid_to", "recorded_from", "recorded_to").collect()]
    for k in "ab":
        for v in range(-1, 14):
            for r in range(-1, 202, 3):
                hit = [x[1] for x in led if x[0] == k and x[2] <= day(v) < x[3] and x[4] <= at(r) and (x[5] is None or at(r) < x[5])]
                want = state_at(ups, k, day(v), at(r))
                assert hit == ([want] if want else []), (k, v, r)


def test_versions(spark):
    rows = [("a", day(0), at(1), "x"), ("a", day(5), at(2), "x"), ("a", day(9), at(3), "y"), ("a", day(12), at(4), "x"), ("a", day(9), at(9), "z"), ("a", day(9), at(9), "z"), (None, day(1), at(1), "x"), ("b", None, at(1), "x"), ("c", day(3), None, None)]
    df = spark.createDataFrame(rows, "k string, d date, r timestamp, s string")
    led = history.bitemporal_ledger(df, "k", "d", "r", ["s"])
    got = sorted((r.k, r.version_no, r.s, str(r.valid_from), str(r.valid_to)) for r in history.versions(led, "k", ["s"]).collect())
    assert got == [("a", 1, "x", "2024-01-01", "2024-01-10"), ("a", 2, "z", "2024-01-10", "2024-01-13"), ("a", 3, "x", "2024-01-13", "9999-12-31"), ("c", 1, None, "2024-01-04", "9999-12-31")]
    then = [(r.s, str(r.valid_from)) for r in history.versions(led, "k", ["s"], as_of="2024-06-01 05:00:00").where("k = 'a'").orderBy("version_no").collect()]
    assert then == [("x", "2024-01-01"), ("y", "2024-01-10"), ("x", "2024-01-13")]
    assert history.bitemporal_ledger(df.limit(0), "k", "d", "r", ["s"]).count() == 0


def test_snapshot_changes(spark):
    rows = [
        (1, "a", "h", at(0)), (3, "a", "h", at(1)), (7, "a", None, at(2)), (1, "b", "h", at(0)), (7, "b", "h", at(0)), (3, "c", "h1", at(0)), (3, "c", "h2", at(5)), (7, "c", "H2 ", at(0)), (1, "d", "h", None), (1, "d", "q", at(0)), (3, "d", "q", at(0)),
        (None, "e", "h", at(0)), (3, None, "h", at(0)), (3, "a", "h", at(1)),
    ]
    df = spark.createDataFrame(rows, "n int, k string, h string, t timestamp").withColumn("_s", F.lit(1))
    got = {tuple(r) for r in snapshots.snapshot_changes(df, "n", "k", {"h": F.lower(F.trim("h"))}, "t").collect()}
    assert got == {(7, "a", "changed"), (3, "b", "removed"), (7, "b", "added"), (3, "c", "added"), (7, "d", "removed")}
    assert snapshots.snapshot_changes(df.limit(0), "n", "k", {"h": F.col("h")}, "t").count() == 0


# Chunking


LINE = "문장이 하나 더 있습니다. "
COLS = "doc_id string, text string, structure string, is_parsable boolean, title string, subtitle string, orig_filename string, effective_date date, source_url string, doc_type string, category string"


def chunks_of(spark, cases):
    rows = [(f"d{i:02}", t, s, True, "제목", None, "f", None, None, "약관", "loan") for i, (t, s) in enumerate(cases)]
    rows += [("no", "글 " * 100, "flat", False, "", None, "f", None, None, "약관", "loan"), ("nul", None, "flat", True, "", None, "f", None, None, "약관", "loan")]
    got = [[] for _ in cases]
    df = spark.createDataFrame(rows, COLS)
    for r in chunking.chunk_documents(df).orderBy("doc_id", "chunk_order").collect():
        assert r.chunk_id == f"{r.doc_id}_c{r.chunk_order:03d}" and r.char_count == len(r.text) and r.chunk_order == len(got[int(r.doc_id[1:])]) + 1
        got[int(r.doc_id[1:])].append((r.text, r.section))
    assert chunking.chunk_documents(df.limit(0)).count() == 0
    return got


def test_lengths_at_the_limits(spark):
    got = chunks_of(spark, [("가" * n, "flat") for n in (99, 100, 900, 901, 1050)] + [(" \n ", s) for s in ("flat", "article", "qa_pair")] + [("나" * 1200 + "다. " + LINE * 10, "flat")])
    assert [[len(t) for t, _ in g] for g in got[:8]] == [[], [100], [900], [500, 401], [500, 500], [], [], []]
    assert [t for t, _ in got[8]] == ["나" * 500, "나" * 500, "나" * 200 + "다.", (LINE * 10).strip()]


def test_sentences_are_packed_with_overlap(spark):
    (got,) = chunks_of(spark, [(LINE * 100, "flat")])
    texts = [t for t, _ in got]
    assert all(len(t) <= 500 for t in texts) and texts[0] == (LINE * 33).strip()
    for a, b in zip(texts, texts[1:]):
        assert b.startswith(a[-80:].strip())


def test_articles(spark):
    long = "제2조(정의) " + LINE * 20 + "① 하나 " + LINE * 20 + "② 둘 " + LINE * 30 + "③ 셋"
    got = chunks_of(spark, [
        ("머리말\n제1조(목적) " + LINE * 10 + "\n" + long, "article"),
        ("제1조(가) 짧다\n제2조(나) 짧다\n제3조(다) 짧은 조항들은 하나로 이어 붙는다 그래서 한 덩이가 된다 " + LINE, "article"),
        ("조항 없는 글입니다. " + LINE * 80, "article"),
        ("제1조 이것은 제목이 아니라 본문으로 이어지는 문장이다\n" + LINE * 5 + "\n제 2 조（이자）" + LINE * 10, "article"),
    ])
    assert [s for _, s in got[0]] == ["", "제2조(정의)", "제2조(정의)", "제2조(정의)"] and got[0][0][0].startswith("머리말\n제1조(목적)")
    assert got[0][1][0].startswith("제2조(정의)") and got[0][2][0].startswith("① 하나") and got[0][3][0].startswith("② 둘") and got[0][3][0].endswith("③ 셋")
    assert all(len(t) <= 900 for t, _ in got[0])
    assert got[1] == []  # joined to one piece, hence by length, and under the minimum
    assert len(got[2]) > 1 and {s for _, s in got[2]} == {""}
    assert [s for _, s in got[3]] == ["제1조", "제2조(이자)"]


def test_clauses_and_numbers(spark):
    got = chunks_of(spark, [
        ("① " + LINE * 20 + "② " + LINE * 5 + "③ " + LINE * 25 + "⑯ 열여섯은 표지가 아니다", "clause"),
        ("1. " + LINE * 20 + "\n2) 둘\n가. 셋 " + LINE * 20 + "\n\n  3. 넷 " + LINE * 20, "numbered"),
        ("표지 없는 글 " + LINE * 3, "clause"),
    ])
    assert [s for _, s in got[0]] == ["①", "③"] and got[0][0][0].startswith("① ") and "\n② " in got[0][0][0] and got[0][1][0].endswith("⑯ 열여섯은 표지가 아니다")
    assert [s for _, s in got[1]] == ["1", "가", "3"] and "2) 둘" in got[1][0][0]
    assert [s for _, s in got[2]] == [] or len(got[2]) <= 1


def test_faq_chunks(spark):
    head, answer_line = "Q. 묻나요?\nA. ", "답변 문장입니다. "
    got = chunks_of(spark, [(head + "답" * (700 - len(head)), "qa_pair"), (head + answer_line * 70, "qa_pair"), ("질문 없는 긴 글 " + answer_line * 80, "qa_pair"), (head + "답" * (701 - len(head)), "qa_pair")])
    assert [len(t) for t, _ in got[0]] == [700]
    assert len(got[1]) > 1 and all(t.startswith(head) and len(t) <= 500 + 10 for t, _ in got[1])
    assert len(got[2]) > 1 and not any(t.startswith("Q.") for t, _ in got[2])
    assert len(got[3]) == 2 and {s for g in got for _, s in g} == {"FAQ"}


def test_chunks_of_all_documents(spark):
    docs = tables.table(spark, SMALL, "bank_documents")
    texts = {r.doc_id: (r.text or "", r.structure.lower()) for r in docs.where("is_parsable").collect()}
    seen = set()
    for r in chunking.chunk_documents(docs).collect():
        text, structure = texts[r.doc_id]
        seen.add(r.doc_id)
        assert 20 <= len(r.text) <= 1000
        if structure not in ("qa_pair",):
            words = r.text.split()
            assert words[-1] in text and words[len(words) // 2] in text
    assert {k for k, (t, _) in texts.items() if len(t) >= 100} <= seen


# Text functions


def one(spark, column, schema="t string", *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.normalize_text("t"), "t string", "가\xa0 나　\t다  \n\n\n\n라 ", None, "") == ["가 나 다\n\n라", None, ""]
    assert one(spark, T.collapse_letter_spacing("t"), "t string", "대 출 거 래 약정서", "은행 여신", "가 나 다") == ["대출거래약정서", "은행 여신", "가나다"]
    assert one(spark, T.compliance_no(t), "t string", "심의필 제 2026-설명서-078호(2026.06.15)", "없음") == ["2026-설명서-078", None]
    assert [str(x) for x in one(spark, T.compliance_date(t), "t string", "제2026-약관-1호 (2026.6.5)", "제2026-약관-1호 (2026.13.5)", "제2026-약관-1호")] == ["2026-06-05", "None", "None"]
    five, four = "제1조 " * 5, "제1조 " * 4
    assert one(spark, T.structure(t), "t string", five, four, "①" * 10, "⑯" * 9, "1. 가\n" * 5, "1. 가\n" * 4) == ["article", "flat", "clause", "flat", "numbered", "flat"]
    assert [str(x) for x in one(spark, T.filename_date(t), "t string", "a_20240131.PDF", "a_20241331.pdf", "a.pdf")] == ["2024-01-31", "None", "None"]
    assert one(spark, T.has_blank(t), "t string", "( )", "(  % )", "____", "..", "☐", None) == [True, True, True, False, True, False]
    assert one(spark, T.clean_doc_name(t), "t string", "약관 - 가계용", "약관 - 본문: 이어짐", "약관") == ["약관 - 가계용", "약관", "약관"]
    assert one(spark, T.gram_set(t), "t string", "가 나", "가-나-다 라", "", None) == [["가나"], ["가나다", "나다라"], [], []]
    assert one(spark, T.guarded_restore(t, F.lit("가나 다")), "t string", "가나다", "가나라", "가 나 다") == ["가나 다", "가나라", "가 나 다"]
    assert one(spark, T.faq_label_free(t), "t string", "Q. 질문  왜\n요", "답변 A. 네", None) == ["왜 요", "네", ""]
    assert one(spark, T.chunk_to_doc(t), "t string", "a_c_b_c012") == ["a_c_b"]


def test_numbering_crosses_partitions(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", f"{i * 7919 % 1000:04}") for i in range(1000)]
    got = quality.numbered(spark.createDataFrame(rows, "k string, o string").repartition(7), ["k"], ["o"]).collect()
    want = {}
    for k, o in sorted(rows):
        want[k, o] = sum(1 for x in rows if x[0] == k and x[1] <= o)
    assert {(r.k, r.o): r.seq for r in got} == want


# Retrieval


def test_bm25_by_hand(spark):
    import math

    docs = {"a": "예금 예금 이자", "b": "대출 이자", "c": "예금 약관 해지 절차", "d": "", "e": None}
    df = spark.createDataFrame(list(docs.items()), "id string, t string")
    q = spark.createDataFrame([("q", "예금 예금 이자"), ("none", "없는 말")], "query_id string, q string")
    got = retrieval.bm25_search(retrieval.bm25_index(df, "id", T.word_tokens(F.col("t"))), retrieval.query_terms(q, "query_id", T.word_tokens(F.col("q"))), 10).collect()
    toks = {k: (v or "").split() for k, v in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    terms = {t for v in toks.values() for t in v}
    raw = {t: math.log(n - (d := sum(t in v for v in toks.values())) + 0.5) - math.log(d + 0.5) for t in terms}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    want = {k: sum(idf[t] * v.count(t) * 2.2 / (v.count(t) + 1.2 * (0.25 + 0.75 * len(v) / avg)) for t in "예금 예금 이자".split() if t in v) for k, v in toks.items()}
    assert {r.id: round(r.score, 9) for r in got} == {k: round(x, 9) for k, x in want.items() if x > 0}
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1))


def test_both_ways_of_searching_agree(spark):
    rng = random.Random(2)
    words = [f"말{i}" for i in range(40)]
    docs = [(f"d{i:04}", " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(700)] + [("n", None)]
    df = spark.createDataFrame(docs, "id string, t string").repartition(5)
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(30)] + [(99, "없음")], "query_id int, q string")
    index, terms = retrieval.bm25_index(df, "id", T.word_tokens(F.col("t"))), retrieval.query_terms(q, "query_id", T.word_tokens(F.col("q")))
    show = lambda x: {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in x.collect()}
    for k in (1, 7, 1000):
        assert show(retrieval.bm25_search(index, terms, k)) == show(retrieval.bm25_search(index[:3], terms, k))
    assert retrieval.bm25_search(index, terms.limit(0), 3).count() == 0
    assert retrieval.bm25_search(retrieval.bm25_index(df.limit(0), "id", T.word_tokens(F.col("t"))), terms, 3).count() == 0


def test_fusion_edges(spark):
    d = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.5)], "query_id string, id string, rank int, score double")
    s = spark.createDataFrame([("q", "b", 1, 3.0), ("q", "c", 2, 3.0), ("p", "z", 1, 1.0)], "query_id string, id string, rank int, score double")
    c = retrieval.candidates(d, s)
    w = {(r.query_id, r.id): (r["rank"], round(r.score, 6), r.source) for r in retrieval.fuse_weighted(c, 0.5, 10).collect()}
    assert w == {("q", "a"): (1, 0.5, "dense"), ("q", "b"): (2, 0.5, "both"), ("q", "c"): (3, 0.5, "sparse"), ("p", "z"): (1, 0.5, "sparse")}
    r = {(x.query_id, x.id): x["rank"] for x in retrieval.fuse_rrf(c, 0.5, 10).collect()}
    assert r["q", "b"] == 1 and r["q", "a"] == 2 and r["q", "c"] == 3
    z = {(x.query_id, x.id): round(x.score, 6) for x in retrieval.fuse_weighted(c, 0.0, 10, retrieval.z_sigmoid).collect()}
    assert z["q", "b"] == z["q", "c"] == 0.5 and z["q", "a"] == 0.0


def test_dense_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)] + [(9, None)], "id int, v array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in retrieval.dense_search(v, "id", "v", v.where("id < 3"), "id", "v", 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 1, 1), (1, 3, 2), (1, 5, 3), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
    assert retrieval.dense_search(v, "id", "v", v.limit(0), "id", "v", 3).count() == 0


def test_metrics_keep_queries_without_hits(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    rel = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "query_id string, id string")
    hits = spark.createDataFrame([("a", "n", 1, 2.0), ("a", "x", 2, 1.5), ("c", "x", 1, 1.0)], "query_id string, id string, rank int, score double")
    m = {r.query_id: r for r in retrieval.per_query(q, rel, hits).collect()}
    assert (m["a"].rr, m["a"].recall_1, m["a"].recall_5, m["a"].full_recall_5, m["a"].first_hit_rank, m["a"].score_gap) == (0.5, 0.0, 1.0, 0.5, 2, 0.5)
    assert m["b"].rr == 0 and m["c"].ndcg_10 == 0 and m["c"].top1_score == 1.0
    a = retrieval.averaged(retrieval.per_query(q, rel, hits), [], ["rr"]).collect()[0]
    assert (a.n, a.rr) == (3, 0.1667)


# Gate


def test_question_rules(spark):
    cases = {
        "제 신용등급으로 이용할 수 있나요?": "personalized", "내 계좌이체 시 보안매체 사용 여부는?": None, "제가 받을 수 있는 금액은 얼마인가요?": "personalized", "은행이 통보를 늦게 하면 저는 언제부터 갚아야 하나요?": None,
        "현재 금리는?": "time_variant", "다음달까지 제공되는 우대서비스는?": None, "다른 은행보다 나은가요": "out_of_scope", "수수료는 얼마인가요?": None,
    }
    assert one(spark, gate.question_rule(F.col("t")), "t string", *cases) == list(cases.values())


def test_signals_and_judgement(spark):
    q = spark.createDataFrame([("a", "수수료는 얼마인가요?"), ("b", "질문"), ("c", "현재?"), ("d", "수수료는 얼마인가요?")], "query_id string, question string")
    hits = spark.createDataFrame([("a", f"x_c{i}", i, 1.0 - 0.1 * i) for i in range(1, 7)] + [("d", f"y_c{i}", i, 0.9) for i in range(1, 4)], "query_id string, id string, rank int, score double")
    texts = spark.createDataFrame([("x_c1", "금리 (   )%"), ("x_c2", "글"), ("y_c1", "___")], "id string, text string")
    s = {r.query_id: r for r in gate.signals(q, hits, texts).collect()}
    assert round(s["a"].gap_1_5, 9) == 0.4 and s["a"].blank_ratio == 0.2 and s["a"].doc_concentration == 1 and s["d"].gap_1_5 == 0 and round(s["d"].blank_ratio, 3) == 0.333 and s["b"].n_hits == 0
    rows = gate.signals(q, hits, texts)
    v = spark.createDataFrame([("d", "ANSWER")], "query_id string, verdict string")
    got = {r.query_id: (r.decision, r.stage, r.reason) for r in gate.judge(rows, v, 0.75, 0.08, 0.5).collect()}
    assert got == {"a": ("refuse", "llm", "no_evidence"), "b": ("refuse", "retrieval", "out_of_scope"), "c": ("refuse", "pattern", "time_variant"), "d": ("answer", "llm", None)}
    assert {r.stage for r in gate.judge(rows, None, 0.75, 0.08, 0.5).collect()} == {"retrieval_fallback", "retrieval", "pattern"}


def test_auc_kappa_pareto(spark):
    df = spark.createDataFrame([(True, 3.0), (True, 1.0), (False, 1.0), (False, 0.0), (True, 2.0)], "p boolean, v double")
    assert gate.auc(df, "p", ["v"]).collect()[0].auc == round((2 + 2 + 1.5) / 6, 6)
    assert gate.auc(df.where("p"), "p", ["v"]).collect()[0].auc == 0.5
    k = gate.kappa(spark.createDataFrame([("y", "y")] * 3 + [("y", "n"), ("n", "n")], "a string, b string"), "a", "b").collect()[0]
    assert (k.n, k.agreement, k.kappa) == (5, 0.8, round((0.8 - 0.56) / 0.44, 6))
    assert gate.kappa(spark.createDataFrame([("y", "y")] * 2, "a string, b string"), "a", "b").collect()[0].kappa == 1
    pts = [(0.1, 0.5), (0.1, 0.5), (0.2, 0.2), (0.2, 0.3), (0.3, 0.2), (0.5, 0.0), (0.1, 0.6)]
    got = sorted(tuple(r) for r in gate.pareto(spark.createDataFrame(pts, "a double, b double"), "a", "b").collect())
    assert got == [(0.1, 0.5), (0.1, 0.5), (0.2, 0.2), (0.5, 0.0)]


# Catalog


@pytest.mark.parametrize(
    "title, want",
    [
        ("『별빛 적금』 상품설명서", ("별빛 적금", "specific_product")), ("환전지갑 서비스 설명서 (요약)", ("환전지갑", "product_family")), ("여신거래 기본약관 - 가계용", ("여신거래", "product_family")), ("약관 - 2020. 12. 10. 개정", ("", "product_family")),
        ("ISA 설명서 (AI 최고위험) 설명서", ("ISA", "product_family")), ("대출 - 아주 긴 이름의 상품 - 둘", ("아주 긴 이름의 상품 - 둘", "product_family")), (None, ("", "product_family")), ("", ("", "product_family")),
    ],
)
def test_product_names(spark, title, want):
    assert tuple(one(spark, catalog.product(F.col("t")), "t string", title)[0]) == want


def test_catalog_matching(spark):
    e = spark.createDataFrame([("d1", "별빛적금"), ("d2", "별빛적금플러스"), ("d3", "환전"), ("d4", "")], "doc_id string, key string")
    asked = spark.createDataFrame([("별빛 적금",), ("나의 별빛적금플러스 통장",), ("별빛적금플",), ("환전 지갑",), ("없는 상품",), ("!!",)], "name string")
    got = {r.name: (r.status, r.doc_id) for r in catalog.match_names(asked, e).collect()}
    assert got == {"별빛 적금": ("covered", "d1"), "나의 별빛적금플러스 통장": ("ambiguous", "d1"), "별빛적금플": ("ambiguous", "d1"), "환전 지갑": ("unmatched", None), "없는 상품": ("unmatched", None), "!!": ("none", None)}
    pairs = spark.createDataFrame([("청년 통장", "청년통장 설명서"), ("나래은행 적금", "나래은행 예금"), ("입출금", "입출금이 자유로운"), ("적금", "자유적금")], "a string, b string")
    same = [r[0] for r in pairs.select(catalog.same_product(F.col("a"), F.col("b"), F.array(F.lit("나래은행")))).collect()]
    assert same == [True, False, True, True]
    keys = ["가나", "가나다", "라", "", "나"]
    assert spark.range(1).select(catalog.n_distinct_products(F.array(*map(F.lit, keys)))).collect()[0][0] == 3


def test_query_analysis(spark):
    raw = ['{"product": " ", "product_granularity": "odd", "can_answer_with_general_terms": "false", "requires_product_specific_doc": true, "confidence": 7}', "broken", '{"product": "적금", "product_granularity": "specific_product", "requires_product_specific_doc": "yes", "confidence": "0.5"}', None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in raw], "t string").select(catalog.query_analysis(F.col("t"))).collect()]
    assert got == [(None, "none", False, True, 1.0), (None, "none", False, False, 0.0), ("적금", "specific_product", False, True, 0.5), (None, "none", False, False, 0.0)]
    a = catalog.query_analysis(F.col("t"))
    refused = [r[0] for r in spark.createDataFrame([(raw[2], s) for s in ("covered", "ambiguous", "unmatched", "none")] + [(raw[0], "unmatched")], "t string, s string").select(catalog.coverage_refusal(a, F.col("s"))).collect()]
    assert refused == [None, "ambiguous_product", "product_mismatch", None, None]


def test_product_verdict(spark):
    rows = [("적금", [True, True], ["a", "b"], 1, [True], False), ("적금", [True, False], ["a", "b"], 2, [True], False), ("적금", [False], ["a"], 1, [False], True), ("적금", [False], ["a"], 1, [False], False), ("", [False], ["a"], 2, [False], False), ("", [False], ["a"], 1, [False], False), ("적금", [], [], 0, [], False)]
    df = spark.createDataFrame(rows, "p string, h array<boolean>, c array<string>, n int, a array<boolean>, t boolean")
    c = F.col
    assert [r[0] for r in df.select(catalog.product_verdict(c("p"), c("h"), c("c"), c("n"), c("a"), c("t"))).collect()] == ["pass", "fail", "na", "fail", "fail", "na", "na"]


# Quality, answers, sources, streams


def test_versions_of_documents(spark):
    rows = [("d1", "제목", "부제", day(0), "h1", "f1"), ("d2", "제 목", "부제", day(5), "h2", "f2"), ("d3", "제목", "부제", day(3), "h2", "f3"), ("d4", "제목", "", day(9), "h4", "f4"), ("d5", "같은 날", "부", day(1), "h5", "f5"), ("d6", "같은 날", "부", day(1), "h6", "f6"), ("d7", "제목", "부제", day(4), "h1", "f0")]
    df = spark.createDataFrame([(*r, True, "약관") for r in rows], "doc_id string, title string, subtitle string, effective_date date, content_hash string, orig_filename string, is_parsable boolean, doc_type string")
    dup = quality.mark_duplicates(df)
    assert {(r.doc_id, r.is_duplicate) for r in dup.collect()} == {("d1", True), ("d7", False), ("d2", False), ("d3", True)}
    assert {tuple(r) for r in quality.mark_versions(df, dup).collect()} == {("d7", "d2")}
    assert quality.mark_duplicates(df.limit(0)).count() == 0


def test_answers(spark):
    d = spark.createDataFrame([("a", "refuse", "pattern", "time_variant"), ("b", "answer", "llm", None), ("c", "refuse", "retrieval", "low_confidence")], "query_id string, decision string, stage string, reason string")
    hits = spark.createDataFrame([(q, "k1", 1, 0.5) for q in "ab"] + [("b", "k2", 2, 0.4)], "query_id string, id string, rank int, score double")
    chunks = spark.createDataFrame([("k1", "이름", "제1조", "2024-01-01", "글", "약관", (None,)), ("k2", "이름 - 긴: 본문", "FAQ", "", None, "FAQ", (False,))], "chunk_id string, doc_display_name string, section string, effective_date string, text string, doc_type string, metadata struct<is_latest:boolean>")
    e = answer.evidence(hits, chunks)
    assert {r.query_id: r.block for r in e.collect()}["b"] == "[1] 이름 제1조 (2024-01-01 시행)\n글\n\n[2] 이름\n"
    got = {r.query_id: (r.answer, r.n_evidence, r.has_old) for r in answer.build_answers(d, e).collect()}
    assert got == {"a": ("", 0, False), "b": ("근거를 확인해 주십시오.", 2, True), "c": ("", 0, False)}
    rates = {(r.g, r.criterion): (r.n_pass, r.n_fail, r.n_na, r.pass_rate) for r in answer.criterion_rates(spark.createDataFrame([("g", "pass", "na"), ("g", "fail", "?")], "g string, x string, y string"), ["x", "y"], "g").collect()}
    assert rates == {("g", "x"): (1, 1, 0, 0.5), ("g", "y"): (0, 0, 2, 0.0)}


def test_files(spark, tmp_path):
    p = tmp_path / "faq_x.jsonl"
    p.write_text('{"faq_id": "1", "question": "q", "answer": "a"}\n\n{broken\n', encoding="utf-8")
    rows, bad = files.read_faq_lines(spark, str(p))
    assert [r.faq_id for r in rows.collect()] == ["1"] and [r.value for r in bad.collect()] == ["{broken"]
    assert files.read_any(spark, str(p)).count() == 1
    with pytest.raises(ValueError):
        files.read_any(spark, "x.unknown")
    html = ["<dl><dt>Q. 질문 왜요</dt><dd>A. 답변 그래서요</dd><dt>빈</dt><dd> </dd></dl>", "<p>Q. 질문 하나</p><p>A. 답변 둘</p>", "", None, "<dt>"]
    pages = spark.createDataFrame(list(enumerate(html)), "n int, html string")
    assert [(r.id, r.question, r.answer) for r in files.read_faq_pages(pages, "n", "html").collect()] == [("0", "왜요", "그래서요"), ("1", "하나", "둘")]
    c = tmp_path / "x.csv"
    c.write_text("﻿a,b\n1, \n", encoding="utf-8")
    df = tables.pick(tables.read_csv_bom(spark, str(c)), "z", "b", "a")
    assert [(r.a, r.z) for r in df.collect()] == [("1", "1")]
    m = tmp_path / "v.md"
    m.write_text("| id | x | y |\n|---|---|---|\n| k1 | Pass | na |\n| k2 | pass | ? |\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_verdict_table(spark, str(m)).collect()] == [("k1", 0, "pass"), ("k1", 1, "na")]
    out = str(tmp_path / "once")
    tables.write_once(df, out)
    with pytest.raises(Exception):
        tables.write_once(df, out)


# Similar questions, layout, stores


def test_similar_texts_against_all_pairs(spark):
    from difflib import SequenceMatcher

    from gyeol.operators import similar

    rng = random.Random(11)
    base = ["예금 가입 기간을 바꾸려면 어떤 서류가 필요한가요", "대출 한도를 늘리려면 얼마나 걸리나요?", "카드 분실 신고", "ab"]
    texts = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(3)] = rng.choice(["가", "", "나다", "x"])
        texts.append((f"f{i:03}", "".join(t)))
    rows = texts + [("n", None), ("e", ""), ("z", texts[0][1] + " ")]
    plain = {}
    for k, t in rows:
        if t and (s := "".join(t.split())):
            plain[s] = min(k, plain.get(s, k))
    items = sorted((k, s) for s, k in plain.items())
    want = {(a, b) for i, (a, s) in enumerate(items) for b, t in items[i + 1 :] if SequenceMatcher(None, s, t).ratio() >= 0.85}
    got = {(r.id_a, r.id_b) for r in similar.similar_texts(spark.createDataFrame(rows, "id string, q string"), "id", "q").collect()}
    assert got == want and len(want) > 50


def test_layout(spark):
    from gyeol.operators import layout

    words = [("d", 10.2, 5.0, 20.0, "예 금"), ("d", 9.8, 50.0, 20.0, "설명서"), ("d", 40.0, 1.0, 15.0, "가계용"), ("d", 60.0, 1.0, 30.0, "12"), ("e", 1.0, 1.0, 20.0, "제목입니다"), ("e", 2.6, 1.0, 9.0, "본문 글자")]
    f = layout.lines_by_font(spark.createDataFrame(words, "doc_id string, top double, x0 double, size double, text string"))
    assert {(r.doc_id, r.place, r.line) for r in f.collect()} == {("d", 1, "예 금 설명서"), ("d", 2, "가계용"), ("e", 1, "제목입니다"), ("e", 2, "본문 글자")}
    k = spark.createDataFrame([("d", "예 금 설명서 (가계용)"), ("x", "약관")], "doc_id string, title_found string")
    got = {r.doc_id: (r.title, r.subtitle, r.confidence) for r in layout.reconcile_titles(f, k).collect()}
    assert got == {"d": ("예 금 설명서 (가계용)", "가계용", "high"), "e": ("제목입니다", "", "medium"), "x": ("약관", "", "medium")}
    pages = spark.createDataFrame([("d", i, f"머리\n본문 {i}\n" + ("발" if i < 3 else "")) for i in range(5)], "doc_id string, page int, text string")
    assert {(r.line, r.n_pages) for r in layout.repeated_page_lines(pages).collect()} == {("머리", 5), ("발", 3)}
    some = layout.evenly_spaced(spark.createDataFrame([("g", i) for i in range(10)], "g string, i int"), ["g"], ["i"], 3)
    assert sorted(r.i for r in some.collect()) == [0, 4, 7]
    kinds = ["FAQ", "약관", "설명서", "FAQ", "기타", "약관"]
    allowed, mix = {"FAQ": ["easy", "medium"], "설명서": ["easy", "medium", "hard"], "약관": ["medium", "hard"]}, {"easy": 0.3, "medium": 0.5, "hard": 0.2}
    got = spark.range(1).select(layout.assign_by_deficit(F.array(*map(F.lit, kinds)), allowed, mix)).first()[0]
    assert got == ["medium", "medium", "easy", "medium", "medium", "hard"]
    tally = layout.mismatch_tally(spark.createDataFrame([("B", True), ("B", None), ("D", False)], "class string, is_real boolean"), "class").collect()
    assert {tuple(r) for r in tally} == {("B", 2, 1, 0.5), ("D", 1, 0, 0.0)}


def test_stores(spark, tmp_path):
    from gyeol.sources import store

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    store.save_dense(v, "k", "v", str(tmp_path / "d"))
    assert store.load_dense(spark, str(tmp_path / "d")).count() == 2
    with pytest.raises(Exception):
        store.save_dense(v, "k", "v", str(tmp_path / "d"))
    with pytest.raises(ValueError):
        store.save_dense(v.union(spark.createDataFrame([(3, [1.0])], v.schema)), "k", "v", str(tmp_path / "x"))
    docs = spark.createDataFrame([("a", "예금 이자"), ("b", "대출"), ("c", "약관")], "id string, t string")
    index = retrieval.bm25_index(docs, "id", T.word_tokens(F.col("t")))
    store.save_sparse(index, str(tmp_path / "s"))
    q = retrieval.query_terms(spark.createDataFrame([("q", "이자")], "query_id string, q string"), "query_id", T.word_tokens(F.col("q")))
    assert [r.id for r in retrieval.bm25_search(store.load_sparse(spark, str(tmp_path / "s")), q, 3).collect()] == ["a"]
    assert store.index_name("x/chunks.jsonl") == "base" and store.index_name("chunks_structural.jsonl") == "structural"


def test_encoders(spark):
    import numpy as np

    from gyeol.operators import encode

    df = spark.createDataFrame([("a", "예금 이자"), ("b", "예금이자"), ("c", ""), ("d", None), ("e", "대출")], "k string, t string")
    got = {r.id: np.array(r.vector) for r in encode.encode_texts(df, "k", "t", encode.hashing_encoder(64), 64).collect()}
    assert set(got) == set("abce") and np.allclose(got["a"], got["b"]) and not got["c"].any() and abs(np.linalg.norm(got["e"]) - 1) < 1e-6
    with pytest.raises(Exception, match="columns are due"):
        encode.encode_texts(df, "k", "t", encode.hashing_encoder(32), 64).collect()
    n = {r.id: r.n_tokens for r in encode.token_numbers(df, "k", "t", lambda: lambda texts: [len(t.split()) for t in texts]).collect()}
    assert n == {"a": 2, "b": 1, "c": 0, "d": 0, "e": 1}
