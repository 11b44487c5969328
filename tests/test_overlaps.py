"""Labels carried over in documents of many chunks: block by block, equal to brute force."""

from __future__ import annotations

import random

from gyeol.operators import overlaps
from gyeol.operators import quality as Q
from tests.test_queries import plan


def _grams(t):
    t = "".join(c for c in t or "" if "가" <= c <= "힣" or c.isascii() and c.isalnum())
    return t, {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t} - {""}


def test_remap_by_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "PAIRS", 200)
    monkeypatch.setattr(overlaps, "OLD_BLOCK", 7)
    monkeypatch.setattr(overlaps, "NEW_BLOCK", 11)
    rng = random.Random(5)
    words = ["예금자는", "만기일에", "이자를 5%", "찾습니다.", "loan", "Rate 3", "가", "나다", "통장과", "도장을"]
    texts = lambda doc, n, p: [(f"{p}{doc}_{i}", doc, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(n)]
    old = [x for k in range(9) for x in texts(f"d{k}", 4, "c")] + texts("big", 40, "c") + [("cn", "big", None), ("ce", "big", "..."), ("cs", "big", "ab")]
    new = [(c, d, t if rng.random() < 0.3 else " ".join(rng.choices(words, k=5))) for c, d, t in old] + texts("big", 60, "x") + texts("d1", 5, "x") + [("xs", "big", "a b"), ("xn", "big", None)]
    labels = [(f"q{i % 20}", c) for i, (c, _, _) in enumerate(old) if i % 3 or len(c) < 3] + [("q1", "gone")]
    want = set()
    by_id = {c: (d, t) for c, d, t in old}
    for q, c in set(labels):
        if c not in by_id:
            continue
        (d, t), near = by_id[c], []
        (p, g) = _grams(t)
        for c2, d2, t2 in new:
            if d2 == d:
                p2, g2 = _grams(t2)
                s = 2.0 if c == c2 and t is not None and t2 is not None and p == p2 else len(g & g2) / min(len(g), len(g2)) if g and g2 else 0.0
                if s >= 0.25:
                    near.append((round(s, 9), c2, s))
        near = sorted(near, reverse=True)[:3]
        for k, (_, c2, s) in enumerate(near, 1):
            if s == 2 or near[0][2] < 2 and s >= near[0][2] / 2:
                want.add((q, c, c2, round(min(s, 1.0), 6), k))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunk = "chunk_id string, doc_id string, text string"
    got = Q.remap_labels(table(labels, "query_id string, chunk_id string"), table(old, chunk), table(new, chunk))
    p = plan(got)
    assert "FlatMapCoGroupsInPandas" in p and "array_intersect" not in p  # no row for each pair of chunks of a document
    rows = [tuple(r) for r in got.collect()]
    assert sorted(set(rows) - want) == sorted(want - set(rows)) == [] and len(rows) == len(want) > 100
