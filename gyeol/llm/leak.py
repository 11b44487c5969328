"""Held-out evaluation passages inside a corpus, by canonical templates.

A text is reduced to letters and digits (NFC, letter case ignored). Numbers with their unit, currency
codes, month names and any names given become typed placeholders; every other character stands for
itself. Windows of WINDOW such symbols are hashed; those of the corpus that are also windows of an item
are the join.
The slots of a joined window are then compared: equal slots are a verbatim seed, which is extended
on the texts to the whole run in common; slots that differ, but consistently (one value of the item
is always the same value in the document), are a re-parameterised copy.

Runs in which numbers take nearly all the room have few symbols; for them a second kind of window
holds SPAN characters, each digit a placeholder of its own. A run of 50 characters holds either
enough whole symbols for a window of the first kind, or a half with so few symbols that a window of
the second kind exists there. So no verbatim run of 50 or more is missed.

Items are a stated query set: they are taken in blocks of at most BLOCK_ITEMS items and about BLOCK_CHARS
characters, whose windows are broadcast (a bounded size); each block is one pass over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 50
WINDOW = 16
SPAN = 25
SPARSE = 11  # symbols in SPAN characters up to which windows of the second kind are made
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 2_000_000  # of passages; their windows take some 50 bytes a character
MAX_NAMES = 200_000  # up to which names are broadcast as one pattern
BITS = 22
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)

#: Units behind a number, by type, and names that stand for others of their kind (fixed values).
UNITS = {
    1: ("만원", "천원", "억원", "원", "달러", "유로", "엔", "won", "dollars"),
    2: ("퍼센트포인트", "퍼센트", "포인트", "percent"),
    3: ("개월", "영업일", "년", "월", "일", "주", "시간", "분", "초", "months", "days", "weeks", "years", "minutes"),
    4: ("회차", "번째", "단계", "가지", "등급", "건", "회", "번", "호", "쪽", "줄", "장", "통", "권", "부", "좌", "점", "차", "명"),
}
CURRENCIES = ("usd", "eur", "jpy", "gbp", "cny", "chf", "cad", "aud", "sgd", "hkd", "krw", "vnd")
MONTHS = ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")

_TYPE = {u: t for t, us in UNITS.items() for u in us}
_UNIT = "|".join(sorted(_TYPE, key=lambda u: (-len(u), u)))
_DROP = re.compile(r"[\W_]+")
_BASE = 0x200000  # placeholders lie above all characters


def normal(text: str) -> str:
    """Letters and digits only, after NFC, letter case ignored."""
    return _DROP.sub("", unicodedata.normalize("NFC", text).lower())


def _either(words: Sequence[str]) -> str:
    """A pattern of all words, the longest first, with common beginnings written once, so that a place
    is left after a few characters however many words there are."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        ways = [re.escape(c) + write(n) for c, n in sorted(node.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return write(root) or "(?!)"


def slots(names: Sequence[str] = ()) -> re.Pattern:
    """What placeholders stand for: numbers with a unit, currencies, months, and the names given."""
    named = _either([n for n in map(normal, names) if n])
    return re.compile(rf"([0-9]+)({_UNIT})?|({'|'.join(CURRENCIES)})|({'|'.join(MONTHS)})|({named})")


def symbols(s: str, slot: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the symbols, where each begins in s with the end added, code of each character)."""
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keep, code = np.ones(len(cp), bool), cp.copy()
    for m in slot.finditer(s):
        a, b = m.span()
        code[a] = _BASE + (_TYPE[m[2]] if m[2] else 0 if m[1] else 8 if m[3] else 9 if m[4] else 10)
        keep[a + 1 : b] = False
    at = np.flatnonzero(keep)
    return code[at], np.append(at, len(cp)), cp


def _hashes(codes: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of `width` codes, at all places or those given."""
    n = len(codes) - width + 1
    if at is None:
        h = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            h = h * _B + codes[k : n + k]
    else:
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = h * _B + codes[at + k]
    return (h ^ (h >> np.uint64(32))) * _M


def windows(s: str, everywhere: bool, slot: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in s) of all windows; of the second kind those where symbols are sparse, or all.
    Behind them the codes of the symbols, and where each begins."""
    codes, at, cp = symbols(s, slot)
    h1, p1 = _hashes(codes, WINDOW), at[: max(len(codes) - WINDOW + 1, 0)]
    if len(cp) < SPAN:
        return h1, p1, codes, at
    began = np.zeros(len(cp) + 1, np.int32)
    began[at[:-1] + 1] = 1
    began = np.cumsum(began)
    p2 = np.arange(len(cp) - SPAN + 1) if everywhere else np.flatnonzero(began[SPAN:] - began[:-SPAN] <= SPARSE)
    if not len(p2):
        return h1, p1, codes, at
    digits = np.where((cp >= 48) & (cp <= 57), np.uint64(_BASE + 16), cp)
    return np.concatenate([h1, _hashes(digits, SPAN, p2) ^ np.uint64(1)]), np.concatenate([p1, p2]), codes, at


class Items:
    """The windows of a block of items."""

    def __init__(self, rows: list[tuple[str, str]], names: Sequence[str] = ()):
        self.slot = slots(names)
        self.ids = [k for k, _ in rows]
        self.texts = [normal(t) for _, t in rows]
        hs, who, where, self.codes, self.at = [], [], [], [], []
        for i, s in enumerate(self.texts):
            h, p, codes, at = windows(s, True, self.slot)
            hs.append(h)
            who.append(np.full(len(h), i, np.int32))
            where.append(p.astype(np.int32))
            self.codes.append(codes)
            self.at.append(at)
        h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        o = np.argsort(h, kind="stable")
        self.h = h[o]
        self.who = np.concatenate(who)[o] if hs else np.empty(0, np.int32)
        self.where = np.concatenate(where)[o] if hs else np.empty(0, np.int32)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.h >> np.uint64(64 - BITS)] = True

    def hits(self, s: str):
        """((place in s, item, place in the item) of every window in common, by place in s; the symbols
        of s; where each begins), or None if there is no window in common."""
        h, p, codes, at = windows(s, False, self.slot)
        near = np.flatnonzero(self.bits[h >> np.uint64(64 - BITS)])
        if not len(near):
            return None
        near = near[np.argsort(p[near], kind="stable")]  # both kinds of windows together
        lo, hi = np.searchsorted(self.h, h[near], "left"), np.searchsorted(self.h, h[near], "right")
        n = hi - lo
        if not n.any():
            return None
        k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return (np.repeat(p[near], n), self.who[k], self.where[k]), codes, at


def common_run(s: str, i: int, t: str, j: int) -> tuple[int, int]:
    """(start in s, length) of the run in common through s[i] and t[j]."""
    a, b = i, j
    while a and b and s[a - 1] == t[b - 1]:
        a, b = a - 1, b - 1
    c, d, n, m = i, j, len(s), len(t)
    while c < n and d < m and s[c] == t[d]:
        c, d = c + 1, d + 1
    return a, c - a


def leaks_of(s: str, items: Items, run: int) -> dict[int, int]:
    """Items with the longest run of at least `run` characters in common with s."""
    best: dict[int, int] = {}
    done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the run already followed; hits come by place
    found = items.hits(s)
    if found is None:
        return best
    for i, who, j in zip(*(x.tolist() for x in found[0])):
        t = items.texts[who]
        if done.get((who, i - j), -1) > i:
            continue
        if s[i] != t[j]:  # a slot that differs at once
            continue
        a, n = common_run(s, i, t, j)
        done[(who, i - j)] = a + n
        if n >= run and n > best.get(who, 0):
            best[who] = n
    return best


def common_symbols(c: np.ndarray, x: int, d: np.ndarray, y: int) -> tuple[int, int]:
    """(start in c, stop in c) of the symbols in common through c[x] and d[y]."""
    back = min(x, y)
    differ = np.flatnonzero(c[x - back : x] != d[y - back : y])
    lo = x - back + (int(differ[-1]) + 1 if len(differ) else 0)
    ahead = min(len(c) - x, len(d) - y)
    differ = np.flatnonzero(c[x : x + ahead] != d[y : y + ahead])
    return lo, x + (int(differ[0]) if len(differ) else ahead)


def consistent_stretch(mine: list[str | None], theirs: list[str | None]) -> tuple[int, int, int]:
    """(symbols, slots, slots that differ) of the longest stretch in which each value of theirs always
    stands against the same value of mine, and some differ. Symbols that are no slots are None."""
    best, left, slots_before, differ_before = (0, 0, 0), 0, [0], [0]
    last: dict[str, tuple[str, int]] = {}

    def close(stop: int) -> None:
        nonlocal best
        now = (stop - left, slots_before[stop] - slots_before[left], differ_before[stop] - differ_before[left])
        if now[2] and now > best:
            best = now

    for k, (m, t) in enumerate(zip(mine, theirs)):
        if t is not None:
            was = last.get(t)
            if was and was[0] != m and was[1] >= left:
                close(k)
                left = was[1] + 1
            last[t] = (m, k)
        slots_before.append(slots_before[-1] + (t is not None))
        differ_before.append(differ_before[-1] + (m != t))
    close(len(mine))
    return best


def reworded_of(s: str, items: Items, symbols_min: int) -> dict[int, tuple[int, int, int]]:
    """Items of which a stretch of at least `symbols_min` symbols occurs with other, consistent
    slots: item -> (symbols, slots, slots that differ) of the longest. A stretch of symbols in common
    is followed once; where a value is replaced in two ways it is cut between the two."""
    best: dict[int, tuple[int, int, int]] = {}
    hits = items.hits(s)
    if hits is None:
        return best
    (places, whos, wheres), codes, at = hits
    done: dict[tuple[int, int], int] = {}  # (item, diagonal of symbols) -> end of the stretch already followed
    xs = np.searchsorted(at, places)
    for i, x, who, j in zip(places.tolist(), xs.tolist(), whos.tolist(), wheres.tolist()):
        c, a = items.codes[who], items.at[who]
        y = int(np.searchsorted(a, j))
        if at[x] != i or a[y] != j or done.get((who, x - y), -1) > x or x >= len(codes) or y >= len(c):
            continue
        lo, hi = common_symbols(codes, x, c, y)
        done[who, x - y] = max(hi, x + 1)
        if hi - lo < symbols_min:
            continue
        shift, t, mine, theirs = y - x, items.texts[who], [None] * (hi - lo), [None] * (hi - lo)
        for k in np.flatnonzero(codes[lo:hi] >= _BASE).tolist():
            mine[k], theirs[k] = s[at[lo + k] : at[lo + k + 1]], t[a[lo + shift + k] : a[lo + shift + k + 1]]
        found = consistent_stretch(mine, theirs)
        if found[0] >= symbols_min and found > best.get(who, (0, 0, 0)):
            best[who] = found
    return best


def _scan(items, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            docs, ids, runs = [], [], []
            for k, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if t and len(t) >= run:
                    for who, n in leaks_of(normal(t), block, run).items():
                        docs.append(k)
                        ids.append(block.ids[who])
                        runs.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column("id").type), pa.array(ids, pa.string()), pa.array(runs, pa.int32())], ["id", "item_id", "run_chars"])

    return go


def _scan_reworded(items, symbols_min: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            rows = [
                (k, block.ids[who], *x)
                for k, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())
                if t and len(t) >= symbols_min
                for who, x in reworded_of(normal(t), block, symbols_min).items()
            ]
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.column("id").type), pa.array(c[1], pa.string()), *[pa.array(x, pa.int32()) for x in c[2:]]], ["id", "item_id", "symbols", "slots", "differing"])

    return go


def _blocks(items: DataFrame, item_col: str, passage_col: str, names: Sequence[str]):
    """The query set in broadcast blocks of bounded size."""
    rows: list[tuple[str, str]] = []
    size = 0
    kept = items.where(F.col(item_col).isNotNull() & F.col(passage_col).isNotNull()).select(F.col(item_col).cast("string"), passage_col).distinct()
    for r in kept.toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if len(rows) == BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield Items(rows, names)
            rows, size = [], 0
    if rows:
        yield Items(rows, names)


def leaked_items(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str = "item_id", passage_col: str = "passage", run: int = RUN, names: Sequence[str] = ()) -> DataFrame:
    """id, item_id, run_chars: documents with an unbroken run of at least `run` letters and digits of
    an item's passage, with the longest. `names` (of products, people) become placeholders too. Null and short texts have none; repeated rows count once."""
    if run < RUN:
        raise ValueError(f"windows are laid out for runs of {RUN} or more")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema, out = f"id {kind}, item_id string, run_chars int", None
    for block in _blocks(items, item_col, passage_col, names):
        part = src.mapInArrow(_scan(spark.sparkContext.broadcast(block), run), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.groupBy("id", "item_id").agg(F.max("run_chars").alias("run_chars")).withColumnRenamed("id", id_col)


def _names(names: DataFrame | Sequence[str]) -> list[str]:
    """The distinct normal forms of names; of a table, its first column, read up to MAX_NAMES."""
    if isinstance(names, DataFrame):
        col = F.col(names.columns[0])
        names = [r[0] for r in names.select(col).where(col.isNotNull()).distinct().limit(MAX_NAMES + 1).toLocalIterator()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    return sorted({normal(n) for n in names} - {""})


def _readings(items: DataFrame, item_col: str, passage_col: str, names: Sequence[str]):
    """Blocks of items without names as placeholders, and those that hold a name with them too: a
    name takes one symbol, so either reading can find stretches the other has too few symbols for."""
    named = re.compile(_either(names))
    for block in _blocks(items, item_col, passage_col, ()):
        yield block
        held = [(k, t) for k, t in zip(block.ids, block.texts) if named.search(t)]
        if held:
            yield Items(held, names)


def reworded_items(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str = "item_id", passage_col: str = "passage", symbols_min: int = 60, names: DataFrame | Sequence[str] = ()) -> DataFrame:
    """id, item_id, symbols, slots, differing: documents that hold a stretch of an item with other
    numbers, units or names in its slots, each value replaced consistently. Names are those given, at
    most MAX_NAMES; only items that hold one are read with names, and all without."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema, out = f"id {kind}, item_id string, symbols int, slots int, differing int", None
    for block in _readings(items, item_col, passage_col, _names(names)):
        part = src.mapInArrow(_scan_reworded(spark.sparkContext.broadcast(block), symbols_min), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("symbols", "slots", "differing")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.symbols", "b.slots", "b.differing")
