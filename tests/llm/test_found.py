"""The pN_found queries against plain Python over whole tables."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import pytest

from gyeol.llm import queries as q
from tests.conftest import MEDIUM, SMALL

pq = lambda d, t, *c: pd.read_parquet(f"{d}/{t}.parquet", columns=list(c) or None)


def plain_units(text: str, structure: str) -> dict[int, str]:
    marks = {
        "article": r"^[^\S\n]*제[^\S\n]*[0-9０-９][0-9０-９ ]*[^\S\n]*조[^\S\n]*(의[^\S\n]*[0-9０-９]+[^\S\n]*)?[(（\[［{｛<＜〈《「『【〔][^\n]*?[)）\]］}｝>＞〉》」』】〕]",
        "clause": r"^[^\S\n]*[①-⑳㉑-㉟㊱-㊿]",
        "numbered": r"^[^\S\n]*[0-9]{1,2}[.)] ",
        "qa_pair": r"^[^\S\n]*[QA]\.",
    }
    out: dict[int, list[str]] = defaultdict(list)
    if structure in marks:
        no = 0
        for line in text.split("\n"):
            if re.match(marks[structure], line):
                no += 1
            out[no].append(line)
    else:
        no, blank = 1, False
        for line in text.split("\n"):
            if not line.strip():
                blank = True
                continue
            if blank and out:
                no += 1
            blank = False
            out[no].append(line)
    return {n: "\n".join(x).strip() for n, x in out.items()}


def test_p1_units(spark):
    b = pq(MEDIUM, "bank_documents", "doc_id", "text", "structure", "is_parsable")
    b = b[b.is_parsable.fillna(False).astype(bool) & b.text.notna()]
    want = {(r.doc_id, n) for r in b.itertuples() for n, u in plain_units(r.text, r.structure.lower()).items() if len(u) > 900}
    assert {(r.doc_id, r.unit_no) for r in q.p1_found(spark, MEDIUM).collect()} == want and len(want) > 100


def test_p1_chunks(spark):
    b = pq(MEDIUM, "bank_documents", "doc_id", "text", "structure", "is_parsable")
    texts = {r.doc_id: r.text for r in b[b.text.notna()].itertuples()}  # of every document, parsable or not
    units = defaultdict(list)
    for r in q.p1_chunks(spark, MEDIUM).collect():
        assert 0 < len(r.text) <= 900 and texts[r.doc_id][r.start : r.start + len(r.text)] == r.text
        units[r.doc_id, r.unit_no].append((r.piece_no, r.start, len(r.text)))
    seen = defaultdict(set)
    for (doc, _), ps in units.items():
        ps.sort()
        for (_, a, n), (_, b2, _) in zip(ps, ps[1:]):
            assert a + n - b2 == 80
        for _, a, n in ps:
            seen[doc].update(range(a, a + n))
    for doc, t in texts.items():
        assert all(i in seen[doc] for i, c in enumerate(t) if not c.isspace()), doc


def test_p1_chunks_of_every_document(spark):
    b = pq(MEDIUM, "bank_documents", "doc_id", "text", "is_parsable")
    b = b[b.text.fillna("").str.strip() != ""]
    seen = defaultdict(set)
    for r in q.p1_chunks(spark, MEDIUM).collect():
        seen[r.doc_id].update(range(r.start, r.start + len(r.text)))
    assert set(seen) == set(b.doc_id) and not b.is_parsable.fillna(False).astype(bool).all()
    for r in b.itertuples():
        assert all(i in seen[r.doc_id] for i, c in enumerate(r.text) if not c.isspace()), r.doc_id


def test_p5_pairs(spark):
    c = pq(MEDIUM, "chunks", "chunk_id", "text").dropna().drop_duplicates("chunk_id")
    c["s"] = ["".join(t.lower().split()) for t in c.text]
    c = c[c.s.str.len() >= 200]
    ids, sets = c.chunk_id.tolist(), [{s[i : i + 5] for i in range(len(s) - 4)} for s in c.s]
    post = defaultdict(list)
    want = set()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        count = Counter()
        for g in sets[i]:
            count.update(post[g])
            post[g].append(i)
        for j, n in count.items():
            if n >= 0.7 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                want.add(tuple(sorted((ids[i], ids[j]))))
    got = [(r.chunk_id_a, r.chunk_id_b) for r in q.p5_found(spark, MEDIUM).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.chunk_id: r.group_id for r in q.p5_groups(spark, MEDIUM).collect()} == {i: root(i) for i in ids}


def test_p6_and_p7(spark):
    tok = pytest.importorskip("tokenizers")
    import tiktoken
    import public_tokenizers as P

    t = tok.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    d = pq(MEDIUM, "documents", "doc_id", "text")
    want = {k: (t.encode(x, add_special_tokens=False).ids if x else []) for k, x in zip(d.doc_id, d.text)}
    got = {r.doc_id: list(r.ids) for r in q.p7_ids(spark, MEDIUM).collect()}
    assert got == want
    counted = {(r.origin, r.text_id): r.n_tokens for r in q.p6_tokens(spark, MEDIUM).collect()}
    assert {int(k[1]): n for k, n in counted.items() if k[0] == "documents"} == {k: len(v) for k, v in want.items()}
    c = pq(MEDIUM, "chunks", "chunk_id", "text").drop_duplicates("chunk_id")
    enc = [len(x.ids) for x in t.encode_batch(c.text.fillna("").tolist(), add_special_tokens=False)]
    assert {k[1]: n for k, n in counted.items() if k[0] == "chunks"} == dict(zip(c.chunk_id, enc))
    total = q.p6_budget(spark, MEDIUM).groupBy().sum("n_tokens", "n_texts").collect()[0]
    assert tuple(total) == (sum(counted.values()), len(counted))
    assert tiktoken is not None


def plain(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFC", t).lower() if c.isalnum())


def test_p8_leaks(spark):
    items = {r.item_id: plain(r.passage) for r in pq(MEDIUM, "eval_items").itertuples()}
    grams = defaultdict(set)
    for k, s in items.items():
        for i in range(len(s) - 49):
            grams[s[i : i + 50]].add(k)
    want = set()
    for r in pq(MEDIUM, "documents", "doc_id", "text").dropna().itertuples():
        s = plain(r.text)
        for i in range(len(s) - 49):
            want.update((r.doc_id, k) for k in grams.get(s[i : i + 50], ()))
    assert {(r.doc_id, r.item_id) for r in q.p8_found(spark, MEDIUM).collect()} == want and len(want) > 10


def test_p9_runs_and_excludes_blank(spark):
    found = {r.doc_id for r in q.p9_found(spark, SMALL).collect()}
    d = pq(SMALL, "documents", "doc_id", "text")
    blank = set(d.doc_id[d.text.isna() | (d.text.fillna("").str.strip() == "")])
    assert found and not found & blank
