"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, hot groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gyeol.llm import leak, lines, neardup, residue, tokens

LONG = "나래은행 예금 약관은 고객이 알아야 할 내용을 차례로 적어 둔 글이며 "


def table(spark, rows, schema="id string, text string, node int, band int, uid int, kind string"):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], schema)


def empty(spark):
    return spark.createDataFrame([], "id string, text string, node int, band int, uid int, kind string")


# Near-duplicates


def sample_text(i: int, n: int = 60) -> str:
    return " ".join(f"{w}{(i * 7919 + k * 104729) % 9973}" for k, w in zip(range(n), ["가입", "해지", "이율", "한도"] * n))


def test_near_duplicates_edges(spark, monkeypatch):
    base = sample_text(1)
    rows = [("a", base), ("b", base.upper() + "\n"), ("c", base + " 끝"), ("d", sample_text(2)), ("e", None), (None, base), ("f", ""), ("g", "짧다"), ("a", base), ("h", base.replace(" ", "  "))]
    n = neardup.NearDuplicates(table(spark, rows), "id", "text")
    pairs = {(r.id_a, r.id_b) for r in n.pairs().collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("a", "h"), ("b", "c"), ("b", "h"), ("c", "h")}
    groups = {r.id: (r.group_id, r.n_links) for r in n.groups().collect()}
    assert {k: v[0] for k, v in groups.items()} == {"a": "a", "b": "a", "c": "a", "h": "a", "d": "d"} and groups["d"][1] == 0
    e = neardup.NearDuplicates(empty(spark), "id", "text")
    assert e.pairs().count() == 0 and e.groups().count() == 0


def test_an_id_with_two_texts(spark):
    """Its texts stay apart: one row per id and text, no row twice."""
    a, b = sample_text(5), sample_text(6)
    rows = [("a", a), ("a", b), ("b", a + " 끝"), ("c", b + " 끝"), ("d", b + " 또")]
    n = neardup.NearDuplicates(table(spark, rows), "id", "text")
    assert sorted((r.id, r.group_id, r.n_links) for r in n.groups().collect()) == [("a", "a", 1), ("a", "a", 2), ("b", "a", 1), ("c", "a", 2), ("d", "a", 2)]
    assert {(r.id_a, r.id_b) for r in n.pairs().collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("c", "d")}


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 20)
    rows = [(f"k{i}", sample_text(i)) for i in range(8)] + [("z", sample_text(1) + "!")]
    assert [(r.id_a, r.id_b) for r in neardup.NearDuplicates(table(spark, rows), "id", "text").pairs().collect()] == [("k1", "z")]


def test_hot_bucket_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MAX_RUN", 5)
    base = sample_text(3, 120)
    rows = [(f"k{i:02}", base + f" 덧붙임 {i}") for i in range(24)] + [("z", sample_text(4))]
    got = neardup.NearDuplicates(table(spark, rows), "id", "text")
    assert got.pairs().count() == 24 * 23 // 2
    assert got.groups().where("group_id = 'k00'").count() == 24


def test_runs_across_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    band = np.sort(rng.integers(0, 40, 3000))
    node = rng.integers(0, 10**6, 3000)
    for size in (1, 7, 100, 5000):
        old, neardup.MAX_RUN = neardup.MAX_RUN, 80
        try:
            parts = [pa.RecordBatch.from_arrays([pa.array(band[i : i + size]), pa.array(node[i : i + size])], ["band", "node"]) for i in range(0, 3000, size)]
            light, heavy = set(), set()
            for b in neardup._runs_to_pairs(iter(parts)):
                for k, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    (heavy if k else light).add((x, y))
        finally:
            neardup.MAX_RUN = old
        want, big = set(), set()
        for v in set(band.tolist()):
            m = sorted(set(node[band == v].tolist()))
            if len(m) > 80:
                big |= {(v, x) for x in m}
            else:
                want |= {(x, y) for i, x in enumerate(m) for y in m[i + 1 :]}
        assert light == want and heavy == big, size


# Lines


def block_rows(positions):
    return {(r.id, tuple(r.line_nos), r.n_docs) for r in positions.collect()}


def test_lines_edges(spark):
    note, foot = "이 안내가 도움이 되었다면 널리 알려 주십시오", "문의는 가까운 영업점에서 언제든 받습니다"
    rows = [(f"c{i}", f"본문 {i}번째 줄은 서로 다른 내용입니다 {'가나다라'[i % 4] * (i + 1)}\n{note} {i}!\n{foot}", f"d{i}", "약관", None) for i in range(6)]
    rows += [("x1", note, "d9", "FAQ", "loan"), ("x2", None, "d1", "약관", None), ("x3", "", "d2", "약관", None), ("c0", rows[0][1], "d0", "약관", None), ("x4", note, None, "약관", None), (None, foot, "d1", "약관", None), ("c1", foot, "d1", "약관", None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, doc_id string, doc_type string, category string").withColumn("src", F.lit(1)).withColumn("suffix", F.lit("r"))
    pos, blocks = lines.repeated_blocks(df, "chunk_id", "doc_id", "text", lines.source_key(F.col("doc_type"), F.col("category")))
    assert block_rows(pos) == {(f"c{i}", (2, 3), 6) for i in range(6)} | {(f"c{i}", (3,), 6) for i in range(6)} | {("x4", (1,), 6), (None, (1,), 6), ("c1", (1,), 6)}
    assert {(r.block_lines, r.n_docs) for r in blocks.collect()} == {(1, 6), (2, 6)}
    clean = {(r.chunk_id, r.text, r.n_removed) for r in lines.without_repeated(df, "chunk_id", "text", pos).collect()}
    assert {("x1", note, 0), ("x4", "", 1), ("x2", None, 0), ("x3", "", 0), (None, "", 1), ("c1", "", 1)} < clean
    assert len(clean) == 12 and sorted(n for k, t, n in clean if k and k.startswith("c") and t) == [2] * 6
    e = df.limit(0)
    assert lines.repeated_blocks(e, "chunk_id", "doc_id", "text", F.lit("s"))[0].count() == 0


def test_blocks_of_any_length(spark):
    """Three lines that repeat together are one block of three; two of them repeat more often."""
    a, b, c = "첫째 줄은 어디에나 적혀 있는 글입니다", "둘째 줄도 어디에나 적혀 있는 글입니다", "셋째 줄은 절반에만 적혀 있는 글입니다"
    rows = [(f"t{i}", f"{i}\n{a}\n짧음\n{b}\n{c}", f"d{i}") for i in range(5)] + [(f"u{i}", f"{a}\n{b}\n끝", f"e{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, doc_id string")
    pos, blocks = lines.repeated_blocks(df, "chunk_id", "doc_id", "text", F.lit("s"))
    want = {(f"t{i}", x, 5) for i in range(5) for x in ((2, 4, 5), (4, 5), (5,))} | {(f"u{i}", x, 10) for i in range(5) for x in ((1, 2), (2,))}
    assert block_rows(pos) == want and {r.block_lines for r in blocks.collect()} == {1, 2, 3}


def test_blocks_against_plain_python(spark):
    import random

    rng = random.Random(11)
    words = [f"{w} 줄이 여러 문서에 되풀이되어 나옵니다" for w in ("하나", "둘", "셋")]
    rows = [(f"c{i}", "\n".join(rng.choice([*words, f"혼자 있는 줄이라서 되풀이되지 않습니다 {'가나다라마바사'[i % 7] * (i // 7 + 1)}", "-"]) for _ in range(rng.randrange(1, 12))), f"d{i % 17}") for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, doc_id string")
    pos, _ = lines.repeated_blocks(df, "chunk_id", "doc_id", "text", F.lit("s"))
    seqs = {k: [(i, x) for i, x in enumerate(t.split("\n"), 1) if len(x) > 2] for k, t, _ in rows}
    docs = {}
    for k, _, d in rows:
        xs = [x for _, x in seqs[k]]
        for i in range(len(xs)):
            for j in range(i + 1, len(xs) + 1):
                docs.setdefault(tuple(xs[i:j]), set()).add(d)
    want = set()
    for k, xs in seqs.items():
        for i in range(len(xs)):
            best = max((j for j in range(i + 1, len(xs) + 1) if len(docs[tuple(x for _, x in xs[i:j])]) >= 4), default=None)
            if best:
                want.add((k, tuple(n for n, _ in xs[i:best]), len(docs[tuple(x for _, x in xs[i:best])])))
    assert block_rows(pos) == want and max(len(x) for _, x, _ in want) > 2


def test_line_keys():
    assert lines.letters("  가-나 1다!　A") == "가나다a" and lines.letters("가") == "가" and lines.letters("①②Ⅳ") == ""


def test_lines_without_broadcast_and_long_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    many = "\n".join(f"{'가나다라마바사아자차'[k % 10] * (k // 10 + 1)} 줄이 모든 문서에 들어 있습니다" for k in range(lines.WIDTH + 6))
    df = spark.createDataFrame([(f"c{i}", f"{many}\n{i}", f"d{i}") for i in range(5)], "chunk_id string, text string, doc_id string")
    pos, _ = lines.repeated_blocks(df, "chunk_id", "doc_id", "text", F.lit("s"))
    assert {(r.id, r.line_no) for r in lines.covered(pos).collect()} == {(f"c{i}", n) for i in range(5) for n in range(1, lines.WIDTH + 7)}
    assert pos.agg(F.max("block_lines")).collect()[0][0] == lines.WIDTH


# Tokens


def reference_encoder():
    tok = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tok.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


STRANGE = ["", " ", "\n\n\n", "<|endoftext|>", "a" * 3000, "가" * 700, "각", "\x00\x01", "👩‍👩‍👧‍👧🏽", "　 ", "I'll they've 's ＱＡ ½Ⅳ", "x" * 1025 + " y", "ab" * 600, "\r\n\t", "�" * 5, "!@#$%^&*()" * 40]


def test_encoding_of_strange_texts(spark):
    enc = reference_encoder()
    df = table(spark, [(str(i), t) for i, t in enumerate(STRANGE)] + [("n", None)] * 2).withColumn("ids", F.lit(0))
    got = [(r.id, list(r.ids)) for r in tokens.encode_corpus(df, "id").collect()]
    assert len(got) == len(STRANGE) + 2 and all(v == ([] if k == "n" else enc(STRANGE[int(k)])) for k, v in got)
    assert tokens.encode_corpus(empty(spark), "id").count() == 0


def test_matrix_rounds_and_heap_agree():
    bpe = tokens.ByteBPE(tokens.vocabulary())
    enc = reference_encoder()
    words = sorted({w for t in STRANGE + [LONG * 3, "International agreements respectively"] for w in bpe.split(t)})
    for w, ids in zip(words, bpe.encode_pieces(words)):
        assert list(ids) == enc(w) == list(bpe.long_piece(w.encode())), w


def test_token_counts(spark):
    enc = reference_encoder()
    texts = STRANGE + [LONG * 5, LONG]
    df = table(spark, [(str(i), t) for i, t in enumerate(texts)] + [("n", None)])
    for hot in (0, 3, 10_000):
        got = {r.id: (r.n_chars, r.n_tokens) for r in tokens.token_counts(df, ["id", "kind"], hot=hot).collect()}
        assert got == {str(i): (len(t), len(enc(t))) for i, t in enumerate(texts)} | {"n": (0, 0)}
    assert tokens.token_counts(empty(spark), ["id"]).count() == 0


def test_languages(spark):
    df = spark.createDataFrame([(x,) for x in ("KO", "kor", "en-XX", " vi_VN ", "", None, "1", "ja")], "l string")
    assert [r[0] for r in df.select(tokens.language(F.col("l"))).collect()] == ["ko", "ko", "en", "vi", "und", "und", "und", "ja"]


# Leaks

PASSAGE = "검증용 시나리오 44에 적힌 농장주 정은 환전해 둔 JPY 지폐 25장을 세어 보다가 가장 짧은 거치 기간인 29개월을 골랐다. 오답 분석 7차에서 다룬 귀국 간호사는 보증금 779만원을 돌려받았다."
DIGITS = "계좌 " + " ".join(str(10**7 + 7919 * k) for k in range(9)) + " 끝"


def test_leaks(spark):
    items = spark.createDataFrame([("i1", PASSAGE, 1), ("i2", DIGITS, 1), ("i3", None, 1), (None, PASSAGE, 1), ("i4", "짧은 글", 1), ("i1", PASSAGE, 1)], "item_id string, passage string, text int")
    inside = leak.normal(PASSAGE)
    docs = [
        ("whole", "앞 " + PASSAGE.upper() + " 뒤"), ("part", "앞 " + inside[10:60] + " 뒤"), ("short", "앞 " + inside[10:59] + "뒤"), ("spaced", " ".join(inside[5:70])), ("digits", "가" + leak.normal(DIGITS)[3:53] + "나"),
        ("changed", PASSAGE.replace("44", "45").replace("25장", "26장").replace("29개월", "30개월").replace("7차", "8차").replace("779", "778")), ("none", None), ("blank", ""), ("whole", "앞 " + PASSAGE.upper() + " 뒤"),
    ]
    df = table(spark, docs).withColumn("item_id", F.lit("z"))
    got = {(r.id, r.item_id): r.run_chars for r in leak.leaked_items(df, "id", "text", items).collect()}
    assert set(got) == {("whole", "i1"), ("part", "i1"), ("spaced", "i1"), ("digits", "i2")}
    assert got["part", "i1"] == 50 and got["whole", "i1"] == len(inside) and got["spaced", "i1"] == 65
    again = leak.reworded_items(df, "id", "text", items).collect()
    assert {(r.id, r.item_id) for r in again if r.differing} == {("changed", "i1")}
    assert leak.leaked_items(empty(spark), "id", "text", items).count() == 0
    assert leak.leaked_items(df, "id", "text", items.limit(0)).count() == 0


def test_names_are_slots(spark):
    text = "{0}의 계좌를 해지하려는 {1} 고객에게 창구 직원이 알려야 할 내용은 약관에 적혀 있으며 서면으로 다시 확인하여야 하고 그 밖의 절차는 따로 정한 바에 따른다"
    items = spark.createDataFrame([("i", text.format("별빛적금", "김나래"))], "item_id string, passage string")
    docs = table(spark, [("d", text.format("달빛 예금", "박소담")), ("odd", text.format("달빛예금", "달빛예금"))])
    names = ["별빛 적금", "달빛 예금", "김나래", "박소담"]
    assert leak.reworded_items(docs, "id", "text", items, symbols_min=50).where("symbols > 60").count() == 0
    got = {r.id: r.differing for r in leak.reworded_items(docs, "id", "text", items, symbols_min=50, names=names).collect()}
    assert got["d"] == 2


def test_registered_query_takes_names_from_tables(spark, tmp_path):
    from gyeol.llm import queries

    text = "{0}의 계좌를 해지하려는 {1} 고객에게 창구 직원이 알려야 할 내용은 {0} 약관에 적혀 있으며 서면으로 다시 확인하여야 하고 그 밖의 절차는 따로 정한 바에 따르되 {1} 누리집에서도 볼 수 있다"
    write = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}.parquet")
    write("bank_documents", [("『별빛길 적금』 약관", "", "약관"), ("Upland Loan product guide", None, "설명서"), ("예금 상품설명서", "합본", "설명서")], "title string, subtitle string, doc_type string")
    write("faq_records", [("나래은행",), (None,)], "bank_name string")
    write("eval_items", [("i", text.format("별빛길 적금", "나래은행"))], "item_id string, passage string")
    docs = [(1, text.format("Upland Loan", "나래은행")), (2, text.format("별빛길 적금", "나래은행")), (3, text.format("다른 것", "나래은행"))]
    write("documents", docs, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.slots, r.differing) for r in queries.p8_reworded(spark, str(tmp_path)).collect()} == {(1, "i", 4, 2)}


def test_reworded_reports_the_longest_stretch():
    rng = __import__("random").Random(5)
    make = lambda n: "".join(rng.choices("가나다라마바사아자차카타파하", k=n))
    a, b = make(20), make(40)
    item, doc = a + "1원" + a[::-1] + "다" + b + "2원" + b[::-1], a + "3원" + a[::-1] + "라" + b + "4원" + b[::-1]
    assert leak.reworded_of(doc, leak.Items([("i", item)]), 30)[0] == (81, 1, 1)


def test_many_names_in_one_pattern():
    names = [f"이름{i}호" for i in range(3000)] + ["별", "별빛"]
    slot = leak.slots(names)
    assert [m[0] for m in slot.finditer("이름2999호별빛별")] == ["이름2999호", "별빛", "별"]


def test_no_run_is_missed():
    import random

    rng = random.Random(3)
    alphabet = "가나다라1234567890원개월usd%abc"
    for trial in range(300):
        weights = [1] * 4 + [rng.choice([1, 8])] * 10 + [1] * (len(alphabet) - 14)
        make = lambda n: "".join(rng.choices(alphabet.replace("%", ""), k=n, weights=weights[: len(alphabet) - 1]))
        run = make(50)
        s, t = make(30) + run + make(30), make(25) + run + make(40)
        assert leak.leaks_of(s, leak.Items([("i", t)]), 50).get("i", leak.leaks_of(s, leak.Items([("i", t)]), 50).get(0, 0)) >= 50, (s, t)


def test_two_runs_on_one_diagonal():
    digits = "".join(str(pow(3, k + 1, 101) % 10) for k in range(55))
    tail = leak.normal("고객은 창구에서 서면으로 뜻을 밝히고 은행은 이를 장부에 적어")
    s, t = "가나" + digits + "다" + tail, "가나" + digits + "라" + tail
    assert leak.leaks_of(s, leak.Items([("i", t)]), 50) == {0: 57}


def test_runs_of_both_kinds_on_many_diagonals():
    """Several runs, with single letters changed between them, against brute force."""
    import random

    rng = random.Random(8)
    for trial in range(400):
        digits = lambda n: "".join(rng.choices("0123456789", k=n))
        words = lambda n: "".join(rng.choices("가나다라마바사아자차카타파하", k=n))
        parts = [rng.choice([digits, words])(rng.randrange(8, 70)) for _ in range(rng.randrange(2, 7))]
        t = "".join(parts)
        s = list(t)
        for _ in range(rng.randrange(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("뷁훼1")
        s = words(rng.randrange(5)) + "".join(s) + digits(rng.randrange(5))
        n = max((m for m in range(50, len(t) + 1) for i in range(len(t) - m + 1) if t[i : i + m] in s), default=0) if trial < 150 else None
        got = leak.leaks_of(s, leak.Items([("i", t)]), 50).get(0, 0)
        some = any(t[i : i + 50] in s for i in range(len(t) - 49))
        assert got == n if n is not None else bool(got) == some, (s, t)


def test_a_stretch_is_cut_where_a_value_is_replaced_in_two_ways():
    rng = __import__("random").Random(6)
    words = "".join(rng.choices("가나다라마바사아자차카타파하", k=150))
    item = words[:20] + "7원" + words[20:50] + "7원" + words[50:140]
    doc = words[:20] + "8원" + words[20:50] + "9원" + words[50:140]
    assert leak.reworded_of(doc, leak.Items([("i", item)]), 60) == {0: (121, 1, 1)}
    assert leak.consistent_stretch(["a", None, "b"], ["x", None, "x"]) == (2, 1, 1)
    assert leak.consistent_stretch([None, "a"], [None, "a"]) == (0, 0, 0)


def test_a_long_verbatim_copy_is_followed_once():
    import time

    rng = __import__("random").Random(7)
    text = "".join(rng.choices("가나다라마바사아자차카타파하12", k=3000))
    items = leak.Items([("i", text)])
    began = time.time()
    assert leak.reworded_of("앞" + text, items, 60) == {} and time.time() - began < 0.5


def test_items_in_blocks_of_characters(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_CHARS", 100)
    items = spark.createDataFrame([(f"i{k}", f"{k}번 " + PASSAGE) for k in range(4)], "item_id string, passage string")
    assert leak.leaked_items(table(spark, [("d", PASSAGE)]), "id", "text", items).count() == 4


# Residue


@pytest.mark.parametrize(
    "text, kind",
    [
        ("상품명: {{ product_name }}", "field"), ("이율은 ${rate}입니다. 나머지는 보통 글입니다.", "field"), ("담당 [[담당부서]] 공지", "field"), ("보통 글에 남은 %%고객명%% 자리", "field"), ("__EFFECTIVE_DATE__ 시행", "field"),
        ("중괄호로 적힌 {account_id} 자리에는 계좌 식별자를 넣습니다.", None), ("예:\n```\nHello {{ name }}\n```\n코드는 위와 같습니다.", None), ("성명 ________  생년월일 ______", None), ("한도는 (      )원으로 하며 고객이 직접 적습니다.", None),
        ("HOME / 고객지원 / 자료실\nPlease enable JavaScript to continue to the product page.", "page"), ("Loading...", "page"), ("요청하신 페이지를 찾을 수 없습니다. 주소가 바뀌었거나 삭제되었을 수 있습니다.", "page"),
        ("시스템 점검 시간인 매월 5일 새벽에는 이체가 3시간 동안 멈출 수 있습니다.", None), ("Lorem ipsum dolor sit amet consectetur adipiscing elit", "page"), ("오류 코드 404가 표시되면 첫 화면에서 다시 들어가시기 바랍니다.", None),
        ("Please enable\nJavaScript to continue to the\nproduct page.", "page"), ("제목 상품설명서\n여기에 텍스트를 입력하세요.", "page"), (None, None), ("", None), (" \n\t　", None), ("가" * 5000, None),
    ],
)
def test_residue(text, kind):
    assert residue.residue_kind(text) == kind


def test_mock_latin_with_invented_words():
    assert residue.residue_kind("Lorem ipsum gravonti sit perluna consectetur melvaris tendo elit sorvanti dolore") == "page"
    assert residue.residue_kind("Porvanti melura dosint carella ventis solum ardentis pirola monsi.") == "page"
    assert residue.residue_kind("Guide to the elit sit in do card") is None
    assert residue.residue_kind("Riverside Flexible Savings Select Bonus Plan Terms.") is None


def test_fields_of_ordinary_delimiters():
    for t in ("문의는 <고객명>님께", "만기일은 [만기일자]입니다.", "Dear %CUSTOMER_NAME%,", "No. $ACCOUNT_NO$", "{0}원을 이체", "«이름» 고객님", "{{" + "a" * 300 + "}}", "{{1}}"):
        assert residue.residue_kind(t) == "field", t
    for t in ("[안내] 예금", "<개정 2024.01.01>", "[별첨 1] 참조", "5%에서 10%로", "$5에서 $3로", "성명 ____ 생년월일 ____", "<|endoftext|> [MASK] </s>", "<b>굵게</b>", "x = a{2}", "[기준금리]\n연 3%입니다."):
        assert residue.residue_kind(t) is None, t


def test_explained_fields_by_density():
    told = "경로의 중괄호 안 {id} 자리에는 번호를 넣습니다. "
    assert residue.residue_kind(told + "예를 들어 {id}처럼 적습니다.") is None
    assert residue.residue_kind(told + "고객 {name}님, {date}까지 {place}로 오십시오.") == "field"


def test_held_out_wordings():
    """Texts worded apart from the rules; the README gives the figures."""
    from tests.llm.residue_heldout import cases

    got = [(bool(residue.residue_kind(t)), want) for t, want in cases()]
    n, m = sum(w for _, w in got), sum(not w for _, w in got)
    assert n >= 200 and m >= 180
    assert sum(x and w for x, w in got) >= 0.9 * n and sum(x and not w for x, w in got) <= 0.05 * m


def test_long_texts_are_read_whole():
    import time

    notice = "요청하신 페이지를 찾을 수 없습니다. "
    began = time.time()
    assert residue.residue_kind(notice * 20000) == "page"
    assert residue.residue_kind(notice * 20000 + "계약은 서면으로 해지하여야 합니다.") is None
    assert residue.residue_kind("글 " * 200000 + "{{ name }}") == "field"
    assert residue.residue_kind("글과 글 " * 200000) == "page" and time.time() - began < 30


def test_unrendered_template_in_a_fence():
    template = "```\n안녕하세요 {{ customer_name }} 고객님, {{ product_name }} 만기일은 {{ due_date }}이며 이율은 {{ rate }}입니다. 문의는 {{ branch }} 지점으로 주십시오.\n```"
    assert residue.residue_kind(template) == residue.residue_kind("만기 안내\n" + template) == "field"
    assert residue.residue_kind("아래는 알림 양식을 적는 방법을 보이는 예입니다.\n" + template) is None
    assert residue.residue_kind("템플릿 문법\n" + template) is None


def test_residue_long_and_table(spark):
    notice = "일시적인 오류가 발생하여 화면을 표시하지 못했습니다. 잠시 후 다시 접속하여 주십시오. "
    rows = [("long", notice * 300), ("mixed", notice + "보통 글이 이어집니다. " * 300), ("n", None), (None, "{{x}}"), ("f", "{{x}} " + "글 " * 20000), ("f", "{{x}} " + "글 " * 20000)]
    got = sorted((r.id or "", r.kind) for r in residue.residue(table(spark, rows).drop("kind"), "id").collect())
    assert got == [("", "field"), ("f", "field"), ("long", "page")]
    assert residue.residue(empty(spark).drop("kind"), "id").count() == 0
