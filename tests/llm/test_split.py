"""Splitting: ranges, halos and files against whole texts."""

from __future__ import annotations

import random

import pytest

from gyeol.llm import split as S
from tests.llm.test_found import plain_units

TEXTS = {
    "article": "머리말\n\n제1조(목적) 이 약관은 그렇습니다.\n" + "문장이 이어집니다. " * 90 + "\n  제 2 조 의 3【가 나】 끝.\n제3조에 따라 그렇다\n" + "가" * 2000,
    "clause": "앞\n① 하나입니다.\n  ② 둘 " + "나다라 " * 400 + "\n③",
    "numbered": "\n\n1. 하나\n2) 둘\n3.셋 아님\n123. 아님\n" + "x. " * 500,
    "qa_pair": "Q. 묻습니다\nA. " + "답합니다. " * 300 + "\nQ.둘\nA.예",
    "flat": "\n \n하나\n둘\n \n\n셋\n" + "넷 " * 600 + "\n\t\n" + "다섯! " * 10,
    "none": "한 줄",
    "blank": " \n\n\t ",
}


@pytest.fixture()
def small_ranges(monkeypatch):
    yield monkeypatch


def stitched(reports):
    """stitch() in plain Python, over the reports of one document."""
    units, off, breaks, last, opened = {}, 0, 0, None, 0
    for n, (b, first_mark, fb, lb, s, e, _), structure in reports:
        if s:
            need = 1 if structure in S.MARKS else 2
            opens = bool(first_mark and (last is None or breaks + fb - last >= need))
            for i, (x, y) in enumerate(zip(s, e)):
                no = opened + i + opens
                lo, hi = units.get(no, (off + x, 0))
                units[no] = (lo, off + y + 1)
            opened += len(s) - 1 + opens
            last = breaks + lb
        off, breaks = off + n, breaks + b
    return units


@pytest.mark.parametrize("structure", [*S.MARKS, "flat"])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 8192])
def test_ranges_of_any_size_give_the_same_units(structure, size):
    rng = random.Random(size)
    words = ["제1조(가)", "제 ２ 조【나 다】", "①", "②", "1. ", "2) ", "Q.", "A.", "\n", "\n\n", "\n \n", " ", "글", "제3조", "　", "끝."]
    for trial in range(40):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(60)))
        reps = [(len(text[i : i + size]), S.report(text, i, min(i + size, len(text)), structure), structure) for i in range(0, max(len(text), 1), size)]
        got = {n: text[a:b] for n, (a, b) in stitched(reps).items()}
        assert got == {n: u for n, u in plain_units(text, structure).items() if u}, (text, size)


def test_documents_rows_and_files(spark, tmp_path, monkeypatch):
    rows = [(k, t, k, 1, 2) for k, t in TEXTS.items() if k != "none"] + [("nul", None, "flat", 1, 2), ("nostruct", "글\n\n글 둘", None, 1, 2), ("flat2", TEXTS["flat"], "FLAT ", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, structure string, uid int, start int")  # clashing names
    got = {(r.id, r.unit_no): (r.start, r.stop) for r in S.units(df, "doc_id").collect()}
    for k, t in TEXTS.items():
        if k != "none":
            assert {n: t[a:b] for (d, n), (a, b) in got.items() if d == k} == {n: u for n, u in plain_units(t, k).items() if u}
    assert {n for (d, n) in got if d == "nostruct"} == {1, 2} and not [d for d, _ in got if d in ("nul", "blank")]
    files, sizes = [], {}
    for k, t in TEXTS.items():
        p = tmp_path / k
        p.write_bytes(t.encode())
        files.append((str(p), k, p.stat().st_size))
    pieces = {}
    for r in S.split_documents(df, "doc_id").collect():
        pieces.setdefault((r.doc_id, r.unit_no), []).append((r.piece_no, r.start, r.section, r.text))
    for size in (97, 1000, 1 << 20):
        units = {(r.path.rsplit("/", 1)[1], r.unit_no): (r.start, r.stop) for r in S.file_units(spark, files, size).collect()}
        assert {k: v for k, v in units.items() if k[0] != "none"} == {k: v for k, v in got.items() if k[0] not in ("nostruct", "flat2")}
        filed = {}
        for r in S.file_pieces(spark, files, size).collect():
            filed.setdefault((r.path.rsplit("/", 1)[1], r.unit_no), []).append((r.piece_no, r.start, r.section, r.text))
        for key, ps in filed.items():
            if key[0] in pieces or key in pieces:
                assert sorted(ps) == sorted(pieces[key]), key
        assert sizes == {} and {k for k in filed if k[0] != "none"} == {k for k in pieces if k[0] not in ("nostruct", "flat2")}


@pytest.mark.parametrize("size", [64, 97, 1000, 8192])
def test_headings_longer_than_any_halo(spark, tmp_path, monkeypatch, size):
    """Brackets, blanks and digits of a heading may go on over many ranges."""
    monkeypatch.setattr(S, "RANGE", size)
    text = "머리말 글\n제1조(" + "긴 제목 " * 1500 + ")\n본문입니다. " + "가나다 " * 300 + "\n제" + " " * 5000 + "2" * 50 + "조 【나】 끝.\n제3조(" + "닫히지 않음 " * 900 + "\n제4조(라) 끝\n제5조(" + "마" * 5000
    want = {n: u for n, u in plain_units(text, "article").items() if u}
    assert len(want) == 4
    df = spark.createDataFrame([("d", text, "article")], "doc_id string, text string, structure string")
    assert {r.unit_no: text[r.start : r.stop] for r in S.units(df, "doc_id").collect()} == want
    rows = sorted((r.unit_no, r.piece_no, r.start, r.section, r.text) for r in S.split_documents(df, "doc_id").collect())
    assert all(text[a : a + len(t)] == t and len(t) <= 900 for _, _, a, _, t in rows)
    for n, u in want.items():
        assert [(a, b) for a, b in ((r[2], r[2] + len(r[4])) for r in rows if r[0] == n)] == [(text.index(u) + a, text.index(u) + b) for a, b in S.pieces_of(u)]
    if size >= 97:
        path = tmp_path / "f"
        path.write_bytes(text.encode())
        files = [(str(path), "article", path.stat().st_size)]
        assert {r.unit_no: text[r.start : r.stop] for r in S.file_units(spark, files, size).collect()} == want
        if size > 97:
            assert sorted((r.unit_no, r.piece_no, r.start, r.section, r.text) for r in S.file_pieces(spark, [(f"file://{path}", *files[0][1:])], size).collect()) == rows


def test_repeated_rows_and_sections(spark):
    text = "제1조(목적) 글\n제2조(정의) " + "글입니다. " * 300
    df = spark.createDataFrame([("d", text, "article"), ("d", text, "article"), (None, text, "article")], "doc_id string, text string, structure string")
    got = S.split_documents(df, "doc_id").collect()
    assert len(got) == 3 * (1 + len(S.pieces_of(text[text.index("제2조") :].strip()))) and {r.section for r in got if r.unit_no == 2} == {"제2조(정의)"}


def test_pieces():
    for text in ["가" * 5000, "글입니다. " * 700, "a" * 900, "a" * 901, "a\n" * 1500, "x"]:
        ps = S.pieces_of(text)
        assert ps[0][0] == 0 and ps[-1][1] == len(text) and all(b - a <= 900 for a, b in ps)
        assert all(x[1] - y[0] == 80 for x, y in zip(ps, ps[1:]))
        again = [p for k in range(len(ps) + 3) if (p := S.piece_at(text, 0, 0, len(text), k, 900, 80, 220))]
        assert again == ps
    ends = [("글입니다. " * 700)[a:b] for a, b in S.pieces_of("글입니다. " * 700)[:-1]]
    assert all(e.endswith("다.") for e in ends)


def test_empty_table(spark):
    e = spark.createDataFrame([], "doc_id string, text string, structure string")
    assert S.units(e, "doc_id").count() == 0 and S.split_documents(e, "doc_id").count() == 0
