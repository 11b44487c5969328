"""Similar questions: block by block, equal to SequenceMatcher over all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from gyeol.operators import similar
from tests.test_queries import plan


def test_ratios_by_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 25)
    rng = random.Random(4)
    texts = {"".join(rng.choices("abc가", k=rng.randrange(1, 14))) for _ in range(150)}
    texts |= {f"{p}우대금리{rng.randrange(10)}.{rng.randrange(100)}%포인트는언제부터붙나요?" for p in ("늘푸름예금", "늘푸름적금", "이음터통장") for _ in range(40)}
    texts |= {("대출한도를늘리려면얼마나걸리나요" * 13)[rng.randrange(4) : 197 + rng.randrange(8)] for _ in range(12)}  # SequenceMatcher reads texts from 200 on in its own way
    texts |= {"😀예금가입기간을바꾸", "😀예금가입기간을바꾼", "x" * 17, "x" * 23}
    rows = [(f"f{i:03}", t) for i, t in enumerate(rng.sample(sorted(texts), len(texts)))]
    want = {(a, b, round(r, 6)) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if (r := SequenceMatcher(None, s, t).ratio()) >= 0.85}
    got = similar.similar_texts(spark.createDataFrame(rows, "id string, q string"), "id", "q")
    p = plan(got)
    assert "FlatMapCoGroupsInPandas" in p and "Window" not in p  # no row for each pair of texts that share a bigram
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 300
