"""Best overlaps of 3-character sequences between old and new chunks of the same documents.

A document may hold any share of the chunks, and then its pairs are far too many to be made as rows. Its
old and new chunks are cut into blocks, every block of one meeting every block of the other, and within
two blocks common sequences are counted through lists of the chunks that hold each: exact for every pair.
The few sequences that most chunks hold are counted by one product of matrices instead. Only the best of
each old chunk leave a block; the best of all are among them. Small documents share a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs from which a document is cut, and chunks of a block.
PAIRS, OLD_BLOCK, NEW_BLOCK = 500_000, 8192, 4096
#: Bits of rows and documents that are counted at once; a sequence takes 42, as there are 11,234 letters and digits.
_ROWS, _DOCS, _CHAR = 12, 9, 14
#: Sequences in more than one of so many chunks are counted by matrices, at most so many of them.
_OFTEN, _DENSE = 24, 1024

_LETTER = np.zeros(1 << 16, np.int64)
_LETTER[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 63)
_LETTER[0xAC00:0xD7A4] = np.arange(63, 63 + 0xD7A4 - 0xAC00)


def _sequences(texts: list[str], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct sequence of each text, apart by document, and the row of the text, in this order. Texts
    hold letters and digits only; a text of under three is a sequence of its own."""
    n = np.array([len(t) for t in texts])
    c = _LETTER[np.frombuffer(("\0\0".join(texts) + "\0\0").encode("utf-16-le"), np.uint16)]
    m = np.where(n >= 3, n - 2, np.minimum(n, 1))
    row = np.repeat(np.arange(len(texts)), m)
    at = np.arange(len(row)) + np.repeat(np.cumsum(n + 2) - n - 2 - (np.cumsum(m) - m), m)
    s = (((doc[row] << _CHAR | c[at]) << _CHAR | c[at + 1]) << _CHAR | c[at + 2]) << _ROWS | row
    s.sort()
    s = s[np.append(True, s[1:] != s[:-1])[: len(s)]]
    return s >> _ROWS, s & ((1 << _ROWS) - 1)


def _counted(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], n_old: int, n_new: int):
    """For each old row in turn: how many of its sequences each new row holds."""
    (seq, row), (mine, of) = new, old
    start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1])[: len(seq)])  # they are in order
    known, held = seq[start], np.diff(np.append(start, len(seq)))
    place = np.searchsorted(known, mine)
    there = np.flatnonzero(np.append(known, -1)[place] == mine)
    place, of = place[there], of[there]
    often = np.flatnonzero(held > max(n_new // _OFTEN, 8))
    often = often[np.argsort(-held[often], kind="stable")[:_DENSE]]
    number = np.full(len(known), -1)
    number[often] = np.arange(len(often))
    dense = np.zeros((len(often), n_new), np.float32)
    k = number[np.repeat(np.arange(len(known)), held)]
    dense[k[k >= 0], row[k >= 0]] = 1
    is_dense, end = number[place] >= 0, start + held
    order = np.argsort(of, kind="stable")
    place, of, is_dense = place[order], of[order], is_dense[order]
    for a in range(0, n_old, 256):
        b = min(a + 256, n_old)
        x, y = np.searchsorted(of, [a, b])
        mask = np.zeros((b - a, len(often)), np.float32)
        d = is_dense[x:y]
        mask[of[x:y][d] - a, number[place[x:y][d]]] = 1
        both = mask @ dense  # whole numbers, far below what a float can tell apart
        cut = np.searchsorted(of[x:y], np.arange(a, b + 1)) + x
        for i in range(b - a):
            p = place[cut[i] : cut[i + 1]][~is_dense[cut[i] : cut[i + 1]]]
            lists = [row[s:e] for s, e in zip(start[p], end[p])]
            yield both[i] + np.bincount(np.concatenate(lists), minlength=n_new) if lists else both[i]


def _best(least: float, most: int):
    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, float]] = []
        if len(old) and len(new):
            new = new.sort_values(["doc_id", "new_id"], kind="stable")
            docs, number = np.unique(new["doc_id"].to_numpy(dtype=object), return_inverse=True)
            old = old[old["doc_id"].isin(set(docs))].sort_values("doc_id", kind="stable")
            mine = np.searchsorted(docs, old["doc_id"].to_numpy(dtype=object)) if len(old) else np.array([], int)
            begin = 0
            while begin < len(new):
                stop = min(begin + (1 << _ROWS), int(np.searchsorted(number, number[begin] + (1 << _DOCS))))
                x, y = np.searchsorted(mine, number[begin]), np.searchsorted(mine, number[stop - 1], "right")
                for a in range(x, y, 1 << _ROWS):
                    b = min(a + (1 << _ROWS), y)
                    _block(old.iloc[a:b], mine[a:b] - number[begin], new.iloc[begin:stop], number[begin:stop] - number[begin], least, most, out)
                begin = stop
        return pd.DataFrame(out, columns=["old_id", "new_id", "s"])

    return run


def _block(old: pd.DataFrame, old_doc: np.ndarray, new: pd.DataFrame, new_doc: np.ndarray, least: float, most: int, out: list) -> None:
    """Rows of one document are in the order of their new ids, so of equal overlaps the last is the greatest id."""
    ids, texts, old_texts = new["new_id"].to_numpy(), new["nt"].to_numpy(), old["ot"].to_numpy()
    by_id: dict[str, list[int]] = {}
    for i, x in enumerate(ids):
        by_id.setdefault(x, []).append(i)
    theirs, mine = _sequences([t or "" for t in texts], new_doc), _sequences([t or "" for t in old_texts], old_doc)
    size_new, size_old = np.bincount(theirs[1], minlength=len(ids)), np.bincount(mine[1], minlength=len(old))
    for i, (old_id, both) in enumerate(zip(old["old_id"], _counted(mine, theirs, len(old), len(ids)))):
        s = both.astype(np.float64) / np.maximum(np.minimum(size_old[i], size_new), 1)
        for j in by_id.get(old_id, ()):
            if texts[j] is not None and texts[j] == old_texts[i] and new_doc[j] == old_doc[i]:
                s[j] = 2.0
        near = np.flatnonzero((s >= least) & (new_doc == old_doc[i]))
        if len(near) > most:
            r = np.round(s[near], 9)
            near = near[np.lexsort((near, r))[-most:]]
        out.extend((old_id, ids[j], float(s[j])) for j in near)


def best_overlaps(old: DataFrame, new: DataFrame, sizes: DataFrame, least: float, most: int) -> DataFrame:
    """old_id, new_id, s: overlaps from `least` of old (doc_id, old_id, ot) with new chunks (doc_id, new_id, nt) of
    the same document, 2 where id and text are the same; of each old chunk at least its `most` best, the greatest
    ids first. sizes (doc_id, n) says about how many new chunks a document has, and only how work is dealt."""
    n = 2 * int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes make much work here and would be put into one task
    docs = old.groupBy("doc_id").agg(F.count("*").alias("n_old")).join(sizes, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cut = F.col("n_old") * F.col("n") > PAIRS
    blocks = lambda c, size: F.when(cut, F.ceil(F.col(c) / size)).otherwise(1).cast("int")
    group = F.when(cut, F.col("doc_id")).otherwise(F.concat(F.lit("#"), F.pmod(F.hash("doc_id"), F.lit(n)).cast("string")))
    docs = docs.select("doc_id", group.alias("group"), blocks("n_old", OLD_BLOCK).alias("i_all"), blocks("n", NEW_BLOCK).alias("j_all"))
    own = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    key = ["group", "i", "j"]
    o = old.join(docs, "doc_id").select("group", own("old_id", "i_all").alias("i"), each("j_all").alias("j"), "doc_id", "old_id", "ot").repartition(n, *key)
    w = new.join(docs, "doc_id").select("group", each("i_all").alias("i"), own("new_id", "j_all").alias("j"), "doc_id", "new_id", "nt").repartition(n, *key)
    w = w.select(*[F.col(c).alias(c) for c in w.columns])  # columns of their own, as both sides come from the chunks
    return o.groupBy(*key).cogroup(w.groupBy(*key)).applyInPandas(_best(least, most), "old_id string, new_id string, s double")
