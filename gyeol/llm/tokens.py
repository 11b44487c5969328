"""Byte-level BPE with a public vocabulary: encoding a corpus, and token budgets.

Encoding. Texts are pre-split; each distinct piece of a task is encoded once. Pieces are put into
matrices by byte length, padded, one row a piece. In each round every row merges its leftmost pair
of minimum rank, so all rows of a matrix lose exactly one column; ranks come from a hash table over
pairs of ids, and only the two pairs beside the merged one are looked up again. Rows in which no
pair is left are emitted and the matrix is compacted. Pieces over LONG bytes go through a heap, as
rounds over them would cost the square of their length.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.session import materialize

VOCABULARY_DIR = os.environ.get("GYEOL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: How a byte-level BPE of this family cuts a text into pieces (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1024
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)
CACHED = 400_000
HOT_PIECES = 200_000
_BUCKETS = (2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256, 512, LONG)


class PairTable:
    """(left id, right id) -> id of the merged token, an open hash table; the id is its rank."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            at = np.flatnonzero(free)
            _, first = np.unique(slot[at], return_index=True)
            put = at[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], vals[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, vals, slot = keys[left], vals[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair has none or an id is negative (padding)."""
        shape, mask = left.shape, (1 << self.bits) - 1
        key = (left.astype(np.int64).ravel() << 20) | (right.astype(np.int64).ravel() & 0xFFFFF)
        ok = (left.ravel() >= 0) & (right.ravel() >= 0)
        out = np.full(key.shape, NONE, np.int32)
        at = np.flatnonzero(ok)
        k, slot = key[at], self._slot(key[at])
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == k
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            if not go.any():
                break
            at, k, slot = at[go], k[go], (slot[go] + 1) & mask
        return out.reshape(shape)


class ByteBPE:
    """A vocabulary of ranks, and the pieces encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def long_piece(self, raw: bytes) -> np.ndarray:
        ids: list[int] = [int(self.byte_id[b]) for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get((r << 20) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := get((ids[before[i]] << 20) | r)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def matrix(self, raws: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of pieces of at most `width` bytes."""
        n = len(raws)
        lengths = np.array([len(r) for r in raws])
        tok = np.full((n, width), -1, np.int32)
        tok[np.arange(width) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(raws), np.uint8)]
        out: list = [None] * n
        rows = np.arange(n)
        rank = self.table(tok[:, :-1], tok[:, 1:]) if width > 1 else np.full((n, 1), NONE, np.int32)
        while len(rows):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), j]
            done = best == NONE
            if done.any():
                for r, t in zip(rows[done].tolist(), tok[done]):
                    out[r] = t[t >= 0]
                go = ~done
                rows, tok, rank, j, best = rows[go], tok[go], rank[go], j[go], best[go]
                if not len(rows):
                    break
            m, w = tok.shape
            line = np.arange(m)
            cols = np.arange(w - 1)
            tok = np.where(cols <= j[:, None], tok[:, :-1], tok[:, 1:])
            tok[line, j] = best
            if w <= 2:
                rank = np.full((m, 1), NONE, np.int32)
                continue
            cols = np.arange(w - 2)
            rank = np.where(cols < j[:, None], rank[:, :-1], rank[:, 1:])
            right = np.flatnonzero(j < w - 2)
            rank[right, j[right]] = self.table(tok[right, j[right]], tok[right, j[right] + 1])
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self.table(tok[left, j[left] - 1], tok[left, j[left]])
        return out

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(r) for r in raws])
        low = 0
        for width in _BUCKETS:
            at = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            step = max(1, CELLS // width)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step].tolist()
                for i, ids in zip(part, self.matrix([raws[i] for i in part], width)):
                    out[i] = ids
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self.long_piece(raws[i])
        return out

    def learn(self, pieces) -> None:
        """Encode pieces that are not known yet."""
        new = [p for p in pieces if p not in self.index]
        if not new:
            return
        ids = self.encode_pieces(new)
        base = len(self.start) - 1
        self.index.update(zip(new, range(base, base + len(new))))
        self.flat = np.concatenate([self.flat, *ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        split = [self.split(t) if t else [] for t in texts]
        per = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        self.learn(set(flat))
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) - np.repeat(ends - size, size) + np.repeat(first, size)
        ids = self.flat[place]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        if len(self.index) > CACHED:
            self.clear()
        return ids, np.diff(bounds)


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The vocabulary of a path, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def vocabulary(name: str = BYTE_BPE, directory: str = VOCABULARY_DIR) -> str:
    return os.path.join(directory, name)


def _encode(path: str, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column("id"), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= chars):
                    size += len(texts[hi] or "")
                    hi += 1
                ids, per = bpe.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"])
                lo = hi

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str = "text", path: str | None = None, chars: int = 1_000_000) -> DataFrame:
    """id, ids: the ids of each text without special tokens, the text taken as it is.

    Every row gives one row, in one pass without shuffle. Null and empty texts have an empty list;
    strings that look like special tokens are ordinary text. Other columns are ignored.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_encode(path or vocabulary(), chars), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


# Token budgets


def _pieces(path: str, most: int = 300_000):
    """Distinct pieces of a task with their numbers, flushed when there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = regex.compile(PATTERN).findall, Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], ["piece", "n"])
            count.clear()
            return rows

        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    count.update(split(t))
            if len(count) > most:
                yield flush()
        yield flush()

    return run


def _piece_lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            sizes = [len(x) for x in bpe.encode_pieces(batch.column("piece").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(sizes, pa.int32())], ["piece", "n", "len"])

    return run


def _count_known(known):
    """Per text: the tokens of pieces in the broadcast part, and the other pieces with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, length = regex.compile(PATTERN).findall, known.value
        get, rare_t = length.get, pa.list_(pa.struct([("piece", pa.string()), ("k", pa.int64())]))
        for batch in batches:
            sums, rest, chars = [], [], []
            for t in batch.column("text").to_pylist():
                found = split(t) if t else []
                got = list(map(get, found))
                rare = None
                if None in got:
                    rare = [{"piece": p, "k": k} for p, k in Counter(p for p, x in zip(found, got) if x is None).items()]
                    got = [x for x in got if x is not None]
                sums.append(sum(got))
                rest.append(rare)
                chars.append(len(t) if t else 0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(chars, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, rare_t)], [*keep, "n_chars", "known", "rare"])

    return run


def language(col: Column) -> Column:
    """ko, en, vi and so on from an oddly written language; und for null and empty."""
    s = F.regexp_extract(F.lower(F.trim(F.coalesce(col, F.lit("")))), "^([a-z]+)", 1)
    names = {"kor": "ko", "korean": "ko", "eng": "en", "english": "en", "vie": "vi", "vietnamese": "vi"}
    out = F.when(s == "", "und")
    for long, short in names.items():
        out = out.when(s == long, short)
    return out.otherwise(s)


def _most_frequent(lengths: DataFrame, hot: int) -> DataFrame:
    """The pieces of the highest frequency classes, as many classes as hold at most `hot` pieces: found
    from the sizes of a few hundred classes, without sorting pieces."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r.level, r.k) for r in lengths.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for lv, k in sizes:
        total += k
        if total > hot:
            break
        least = lv
    return lengths.where(level >= least) if least is not None else lengths.limit(0)


def token_counts(df: DataFrame, keys: list[str], text_col: str = "text", path: str | None = None, hot: int = HOT_PIECES) -> DataFrame:
    """keys..., n_chars, n_tokens: exact, one row per row of df; null and empty texts have 0.

    Each distinct piece of the corpus is tokenized once. The lengths of at most `hot`
    pieces, the most frequent, are broadcast; texts' other pieces are joined to theirs by shuffle.
    """
    path, spark = path or vocabulary(), df.sparkSession
    src = df.select(F.monotonically_increasing_id().alias("_uid"), *keys, F.col(text_col).alias("text"))
    found = src.select("text").mapInArrow(_pieces(path), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    lengths = materialize(found.mapInArrow(_piece_lengths(path), "piece string, n bigint, len int"), "pieces")
    top = _most_frequent(lengths, hot).select("piece", "len").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("piece").to_pylist(), top.column("len").to_pylist())))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("text").schema)
    counted = materialize(src.mapInArrow(_count_known(known), f"{kept}, n_chars bigint, known bigint, rare array<struct<piece:string,k:bigint>>"), "counted")
    rare = counted.where("rare is not null").select("_uid", F.explode("rare").alias("r")).select("_uid", F.col("r.piece").alias("piece"), F.col("r.k").alias("k"))
    rest = rare.join(lengths.select("piece", "len"), "piece").groupBy("_uid").agg(F.sum(F.col("k") * F.col("len")).alias("more"))
    return counted.join(rest, "_uid", "left").select(*keys, "n_chars", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
