"""Questions that differ little: matching-blocks ratio, over all pairs without making all pairs as rows.

The ratio of two texts is 2 M / (a + b), M being the characters in matching blocks. M is at most the
characters that the texts have in common, and the longer text at most (2 - r) / r times as long as the
shorter. So texts are cut into blocks by length, and blocks whose lengths can match meet. Within two blocks
texts of like endings are put together: a group that can't have enough characters in common with a text is
passed over, for others the common characters are counted by a product of matrices, and the matching blocks
of what is left are found for many pairs at once, in the order in which SequenceMatcher finds them.
Families of questions cut from one template are near each other in truth: their links, and so the work,
grow with the square of the family; texts are compared once per distinct text, not per row.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.functions import text as T

LEAST = 0.85
#: Texts of a block; texts that are judged together; cells that are filled at once.
BLOCK, _TOGETHER, _CELLS = 2048, 32, 4_000_000
#: From this length on SequenceMatcher leaves out frequent characters, so such texts are left to it.
_LONG = 200


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest common run of each column of a and b (characters by
    pairs); of equal runs the first in a, then in b."""
    runs = np.zeros((len(a), len(b) + 1, a.shape[1]), np.uint8)
    for i in range(len(a)):
        np.multiply((runs[i - 1, :-1] if i else 0) + np.uint8(1), b == a[i], out=runs[i, 1:], dtype=np.uint8)
    by_row = runs.max(axis=1)
    end = by_row.argmax(axis=0)
    at = np.arange(a.shape[1])
    size = by_row[end, at].astype(np.int64)
    j = runs[end, :, at].argmax(axis=1)
    return end + 1 - size, j - size, size


def _matched(codes: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Characters in matching blocks of the texts a and b (rows of codes, of n characters); pairs that can't
    come to the least ratio any more are given up, with fewer than they have."""
    m = np.zeros(len(a), np.int64)
    length = n[a] + n[b]
    left = np.stack([np.arange(len(a)), np.zeros(len(a), int), n[a], np.zeros(len(a), int), n[b]])  # pair, range of a, range of b
    while left.shape[1]:
        p, alo, ahi, blo, bhi = left
        more = np.bincount(p, np.minimum(ahi - alo, bhi - blo), minlength=len(a))
        left = left[:, (2.0 * (m + more) / length >= least)[p]]
        left = left[:, np.lexsort((left[4] - left[3], left[2] - left[1]))]
        parts, begin = [], 0
        while begin < left.shape[1]:
            wide = max(1, int((left[4] - left[3])[begin : begin + 20_000].max()))
            tall = max(1, int((left[2] - left[1])[min(begin + 20_000, left.shape[1]) - 1]))
            stop = min(begin + max(1, min(20_000, _CELLS // (wide * tall))), left.shape[1])
            p, alo, ahi, blo, bhi = x = left[:, begin:stop]
            i, j = np.arange((ahi - alo).max())[:, None], np.arange((bhi - blo).max())[:, None]
            last = codes.shape[1] - 1
            ca = np.where(i < ahi - alo, codes[a[p], np.minimum(alo + i, last)], 0)
            cb = np.where(j < bhi - blo, codes[b[p], np.minimum(blo + j, last)], 1)  # no text holds 0 or 1
            s, t, k = _longest(ca, cb)
            np.add.at(m, p, k)
            s, t, found = s + alo, t + blo, k > 0
            for y in (np.stack([p, alo, s, blo, t]), np.stack([p, s + k, ahi, t + k, bhi])):
                parts.append(y[:, found & (y[2] > y[1]) & (y[4] > y[3])])
            begin = stop
        left = np.concatenate(parts, axis=1) if parts else left[:, :0]
    return m


def _ratios(texts: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The ratio of each pair where it is `least` or more, else something less."""
    n = np.array([len(t) for t in texts])
    out, short = np.zeros(len(a)), n[b] < _LONG
    short &= n[a] < _LONG
    out[short] = 2.0 * _matched(codes, a[short], b[short], n, least) / (n[a] + n[b])[short]
    for i in np.flatnonzero(~short):
        out[i] = SequenceMatcher(None, texts[a[i]], texts[b[i]]).ratio()
    return out


def _candidates(texts: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, least: float):
    """Pairs (rows of texts) with enough characters in common, a few at a time."""
    n = np.array([len(t) for t in texts])
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.sort(np.repeat(np.arange(len(texts)), n) << 32 | c)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    kth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    row, c = s >> 32, s & 0xFFFFFFFF
    _, kind = np.unique(c << 24 | np.minimum(kth, (1 << 24) - 1), return_inverse=True)  # the k-th of a character is a kind of its own
    has = np.zeros((len(texts), kind.max() + 1), np.float32)
    has[row, kind] = 1
    of_b, n_b = has[rows_b], n[rows_b]
    groups = [rows_a[i : i + _TOGETHER] for i in range(0, len(rows_a), _TOGETHER)]
    any_of = np.stack([has[g].max(axis=0) for g in groups])
    bound = np.minimum(any_of @ of_b.T, np.array([n[g].max() for g in groups])[:, None])
    fewest = np.array([n[g].min() for g in groups])[:, None]
    may = 2.0 * bound / (fewest + n_b) >= least
    for g, near in zip(groups, may):
        near = np.flatnonzero(near)
        if len(near):
            both = has[g] @ of_b[near].T
            i, j = np.nonzero(2.0 * both.astype(np.float64) / (n[g][:, None] + n_b[near]) >= least)
            yield g[i], rows_b[near[j]]


def _verify(least: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            same = bool(left["same"].iloc[0])
            both = left if same else pd.concat([left, right], ignore_index=True)
            side = np.zeros(len(both), int)
            side[len(left) :] = 1
            order = sorted(range(len(both)), key=lambda i: both["t"].iat[i][::-1])
            ids, texts, side = both["id"].to_numpy(dtype=object)[order], both["t"].to_numpy(dtype=object)[order], side[order]
            rank = np.empty(len(ids), int)
            rank[np.argsort(ids)] = np.arange(len(ids))
            short = [t[: _LONG - 1] for t in texts]
            codes = np.zeros((len(texts), max(map(len, short))), np.int64)
            codes[np.arange(codes.shape[1]) < np.array([len(t) for t in short])[:, None]] = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32) + np.int64(2)
            kept = np.unique(codes)
            if len(kept) < 60_000:
                codes = (np.searchsorted(kept, codes) + 2).astype(np.uint16)
            waiting: list[tuple[np.ndarray, np.ndarray]] = []

            def judge() -> None:
                a, b = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
                r = _ratios(texts, codes, a, b, least)
                k = r >= least
                found.append(pd.DataFrame({"id_a": ids[a[k]], "id_b": ids[b[k]], "ratio": r[k]}))

            for a, b in _candidates(texts, np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1)), least):
                if same:  # each pair once
                    a, b = a[a < b], b[a < b]
                waiting.append((a, b))
                if sum(len(x) for x, _ in waiting) > 200_000:
                    judge()
            if waiting:
                judge()
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame([], columns=["id_a", "id_b", "ratio"])

    return run


def similar_texts(df: DataFrame, id_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """id_a < id_b, ratio: pairs of distinct texts (white space ignored), each under its smallest id.

    Null and empty texts take no part; equal texts are one text."""
    t = df.select(F.col(id_col).cast("string").alias("id"), T.squash(F.col(text_col)).alias("t")).where("id is not null and t <> ''")
    t = t.groupBy("t").agg(F.min("id").alias("id"))
    step = math.log((2 - least) / least) * 1.01 + 1e-9  # lengths that can match are in one bin or in neighbours
    t = t.withColumn("bin", F.floor(F.log(F.length("t").cast("double")) / step).cast("int"))
    parts = t.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # a row per bin, few whatever the table
    t = t.join(F.broadcast(parts), "bin").withColumn("part", F.pmod(F.xxhash64("t"), "parts").cast("int"))
    up = parts.select((F.col("bin") - 1).alias("bin"), F.col("parts").alias("above"))
    t = t.join(F.broadcast(up), "bin", "left")
    # a block meets itself, the later ones of its bin, and those of the next bin
    own = F.transform(F.sequence("part", F.col("parts") - 1), lambda p: F.struct(F.col("bin").alias("bin_b"), p.alias("part_b")))
    next_ = F.when(F.col("above").isNull(), F.array().cast("array<struct<bin_b:int,part_b:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda p: F.struct((F.col("bin") + 1).alias("bin_b"), p.alias("part_b"))))
    left = t.select("id", "t", "bin", "part", F.explode(F.concat(own, next_)).alias("with")).select("id", "t", F.col("bin").alias("bin_a"), F.col("part").alias("part_a"), "with.*")
    left = left.withColumn("same", (F.col("bin_a") == F.col("bin_b")) & (F.col("part_a") == F.col("part_b")))
    down = parts.select((F.col("bin") + 1).alias("bin"), F.col("parts").alias("below"))
    r = t.drop("above").join(F.broadcast(down), "bin", "left")
    own = F.transform(F.sequence(F.lit(0), F.col("part")), lambda p: F.struct(F.col("bin").alias("bin_a"), p.alias("part_a")))
    back = F.when(F.col("below").isNull(), F.array().cast("array<struct<bin_a:int,part_a:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda p: F.struct((F.col("bin") - 1).alias("bin_a"), p.alias("part_a"))))
    r = r.select("id", "t", F.col("bin").alias("bin_b"), F.col("part").alias("part_b"), F.explode(F.concat(own, back)).alias("with")).select("id", "t", "with.*", "bin_b", "part_b")
    right = r.select(*[F.col(c).alias(c) for c in r.columns])
    key = ["bin_a", "part_a", "bin_b", "part_b"]
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes make much work here
    both = left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key))
    return both.applyInPandas(_verify(least), "id_a string, id_b string, ratio double").withColumn("ratio", F.round("ratio", 6))
