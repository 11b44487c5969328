"""Near-duplicate texts by min-max hashing, with exact verification.

Each text, lower-cased and without whitespace, is the set of its 5-character sequences. Under each
of E permutations both the smallest and the largest image are kept, so E hash evaluations give 2E
signature values, whose agreement estimates the Jaccard similarity without bias. Bands of R values
that agree make candidates; a two-bit sketch of the signature drops most false ones (five standard
deviations below the threshold); the rest are verified on the texts themselves, so the result is
exact up to candidates missed by all bands: (1 - 0.7^6)^50, 0.2 % right at the threshold.

Scale. One pass hashes the texts; its band rows (two longs) and member rows go through one shuffle by
band value, into as many partitions as there are PART_ROWS band rows, and are sorted; pairs come from
runs in a stream, so no bucket is held in memory. A bucket with more than MAX_RUN
members is not paired there: its members are split into blocks by salt and compared block against
block by the sketch, each block pair its own group of bounded size, and only similar pairs leave.
Copies of one text have one node, so a copied text is a single member however often it occurs.
Texts are shuffled only where a candidate needs them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.session import materialize

SHINGLE = 5
BANDS, ROWS = 50, 6
EVALS = BANDS * ROWS // 2
SKETCH_VALUES = 128  # two bits each
SKETCH_LONGS = SKETCH_VALUES // 32
MAX_RUN = 400
SEED = 20260105
#: Up to so many ids of texts that candidates need are broadcast to pick them; more are joined by shuffle.
BROADCAST_IDS = 100_000
BLOCK_CHARS = 65_536
PART_ROWS = 1_000_000  # band rows of a shuffle partition
MAX_PARTS = 20_000

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(0, 2**32, EVALS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, EVALS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def squeeze(text: str) -> str:
    """Lower-cased and without any whitespace."""
    return "".join(text.lower().split())


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all sequences of the texts, each at least SHINGLE long, and where each text starts."""
    lengths = np.array([len(x) for x in texts])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(cp) - SHINGLE + 1
    h = cp[:n].copy()
    for k in range(1, SHINGLE):
        h *= _MIX
        h += cp[k : n + k]
    x = (((h ^ (h >> np.uint64(29))) * _MIX2) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(lengths)
    keep = np.ones(len(cp), bool)
    for k in range(1, SHINGLE):
        keep[ends - k] = False
    starts = np.concatenate([[0], np.cumsum(lengths - SHINGLE + 1)[:-1]])
    return x[keep[:n]], starts


def signatures(texts: list[str], evals: int = EVALS) -> np.ndarray:
    """len(texts) x 2 evals: the minimum and maximum under each permutation, side by side."""
    out = np.empty((len(texts), 2 * evals), np.uint32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_CHARS):
            size += len(texts[hi])
            hi += 1
        x, starts = shingle_hashes(texts[lo:hi])
        y = np.empty_like(x)
        for k in range(evals):
            np.multiply(x, _MUL[k], out=y)
            y += _ADD[k]
            out[lo:hi, 2 * k] = np.minimum.reduceat(y, starts)
            out[lo:hi, 2 * k + 1] = np.maximum.reduceat(y, starts)
        lo = hi
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    """len x BANDS 64-bit values; the band's number is mixed in."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX2, (len(sig), BANDS)).copy()
    for k in range(ROWS):
        h = (h ^ v[:, :, k]) * _MIX
        h ^= h >> np.uint64(31)
    return (h * _MIX2).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """len x SKETCH_LONGS longs with two bits of each of the first SKETCH_VALUES values."""
    v = (sig[:, :SKETCH_VALUES] * np.uint32(0x85EBCA6B) >> np.uint32(30)).astype(np.uint64).reshape(len(sig), -1, 32)
    shift = np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(v << shift, axis=2).view(np.int64)


def sketch_floor(threshold: float) -> int:
    """Agreements of a pair at the threshold, less five standard deviations."""
    p = threshold + (1 - threshold) / 4
    return int(SKETCH_VALUES * p - 5 * (SKETCH_VALUES * p * (1 - p)) ** 0.5)


def node_of(squeezed: str) -> tuple[int, int]:
    """128 bits that stand for a text."""
    h = xxhash.xxh3_128_intdigest(squeezed.encode("utf-8", "surrogatepass"))
    a, b = h >> 64, h & (2**64 - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _eligible(batch: pa.RecordBatch, min_chars: int):
    """Rows with an id and a text long enough: (row, squeezed text)."""
    ids, texts = batch.column("id"), batch.column("text")
    for i, (k, t) in enumerate(zip(ids.to_pylist(), texts.to_pylist())):
        if k is not None and t is not None and 3 * len(t) >= min_chars:  # lower case can be longer
            s = squeeze(t)
            if len(s) >= min_chars:
                yield i, k, s


_FACTS = f"<{1 + SKETCH_LONGS}q"
_FACTS_SIZE = struct.calcsize(_FACTS)


def _hashed_rows(min_chars: int):
    """From texts, in one pass: a row per band of each text new to the task (band, node), and a row per
    member (band = node, facts: node2, sketch, id; the sketch only with the first of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            members, texts, nodes = [], [], []
            for _, k, s in _eligible(batch, min_chars):
                node, node2 = node_of(s)
                new = node not in seen
                if new:
                    if len(seen) < 2_000_000:  # rows left twice only cost time; a later distinct removes them
                        seen.add(node)
                    texts.append(s)
                    nodes.append(node)
                members.append((node, node2, len(texts) - 1 if new else -1, k.encode("utf-8", "surrogatepass")))
            for lo in range(0, len(texts), 4096):
                sig = signatures(texts[lo : lo + 4096])
                sk = sketches(sig) if lo == 0 else np.concatenate([sk, sketches(sig)])
                values = band_values(sig).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(np.array(nodes[lo : lo + 4096], np.int64), BANDS)), pa.nulls(len(values), pa.binary())], ["band", "node", "facts"])
            none = (0,) * SKETCH_LONGS
            facts = [struct.pack(_FACTS, n2, *(sk[i].tolist() if i >= 0 else none)) + (b"\1" if i >= 0 else b"\0") + k for _, n2, i, k in members]
            own = pa.array([m[0] for m in members], pa.int64())
            yield pa.RecordBatch.from_arrays([own, own, pa.array(facts, pa.binary())], ["band", "node", "facts"])

    return run


RUN_COLUMNS = ["kind", "a", "b", "id", *[f"s{j}" for j in range(SKETCH_LONGS)]]


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of _hashed_rows to pairs and long runs (kinds 0 and 1, see _runs_to_pairs) and
    members (kind 2: a is node, b is node2)."""
    kept: list[pa.RecordBatch] = []

    def bands():
        for batch in batches:
            member = batch.column("facts").is_valid()
            kept.append(batch.filter(member))
            yield batch.filter(pa.compute.invert(member)).select(["band", "node"])

    def wide(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int64())] * SKETCH_LONGS], RUN_COLUMNS)

    def members():
        while kept:
            m = kept.pop()
            facts = m.column("facts").to_pylist()
            if not facts:
                continue
            rows = [struct.unpack_from(_FACTS, f) for f in facts]
            has = [f[_FACTS_SIZE] == 1 for f in facts]
            ids = [f[_FACTS_SIZE + 1 :].decode("utf-8", "surrogatepass") for f in facts]
            sk = [pa.array([r[1 + j] if h else None for r, h in zip(rows, has)], pa.int64()) for j in range(SKETCH_LONGS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), 2, np.int8)), m.column("node"), pa.array([r[0] for r in rows], pa.int64()), pa.array(ids, pa.string()), *sk], RUN_COLUMNS)

    for out in _runs_to_pairs(bands()):
        yield wide(out)
        yield from members()
    yield from members()


def _runs_to_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by band value: pairs (kind 0: a, b) of the members of each run, and
    the members of runs over MAX_RUN (kind 1: band, node). At most a batch and a run are held."""
    empty = np.empty(0, np.int64)
    keep_b, keep_n, long_band = empty, empty, None

    def emit(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def work(b: np.ndarray, n: np.ndarray):
        if not len(b):
            return
        first = np.ones(len(b), bool)
        first[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])  # the same node twice in a run
        b, n = b[first], n[first]
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        sizes = np.diff(np.append(starts, len(b)))
        per = np.repeat(sizes, sizes)
        big = per > MAX_RUN
        if big.any():
            yield emit(1, b[big], n[big])
        ok = (per > 1) & ~big
        b, n = b[ok], n[ok]
        d = 1
        while len(b) > d:
            same = b[d:] == b[:-d]
            if not same.any():
                break
            for lo in range(0, int(same.sum()), 500_000):
                yield emit(0, n[:-d][same][lo : lo + 500_000], n[d:][same][lo : lo + 500_000])
            d += 1

    for batch in batches:
        b, n = batch.column("band").to_numpy(), batch.column("node").to_numpy()
        if not len(b):
            continue
        if long_band is not None:  # a run that was already found to be long goes on
            cut = int(np.searchsorted(b, long_band, "right")) if b[0] == long_band else 0
            if cut:
                yield emit(1, b[:cut], n[:cut])
                b, n = b[cut:], n[cut:]
                if not len(b):
                    continue
            long_band = None
        b, n = np.concatenate([keep_b, b]), np.concatenate([keep_n, n])
        order = np.lexsort((n, b))
        b, n = b[order], n[order]
        last = int(np.searchsorted(b, b[-1], "left"))
        yield from work(b[:last], n[:last])
        keep_b, keep_n = b[last:], n[last:]
        if len(keep_b) > MAX_RUN and len(np.unique(keep_n)) > MAX_RUN:
            yield emit(1, keep_b, keep_n)
            long_band, keep_b, keep_n = int(b[-1]), empty, empty
    yield from work(keep_b, keep_n)


def _agree(left: str, right: str):
    """Number of sketch values that agree."""
    mask = F.lit(0x5555555555555555)
    differ = None
    for j in range(SKETCH_LONGS):
        x = F.col(f"{left}.s{j}").bitwiseXOR(F.col(f"{right}.s{j}"))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(mask))
        differ = n if differ is None else differ + n
    return F.lit(SKETCH_VALUES) - differ


def _verified(threshold: float):
    """Pairs of texts, sorted by the first, that share at least `threshold` of their sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, frozenset()
        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            ok = []
            for x, y in zip(ta, tb):
                if x != last:
                    last, left = x, {x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)}
                right = {y[i : i + SHINGLE] for i in range(len(y) - SHINGLE + 1)}
                common = len(left & right)
                ok.append(x != y and common >= threshold * (len(left) + len(right) - common) - 1e-9)
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "a2", "b", "b2"])

    return run


def _squeezed_texts(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, _, s in _eligible(batch, min_chars)]
            for lo in range(0, len(found), 4096):
                part = found[lo : lo + 4096]
                nodes = [node_of(s) for s in part]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in nodes], pa.int64()), pa.array([b for _, b in nodes], pa.int64()), pa.array(part, pa.string())], ["node", "node2", "t"])

    return run


class NearDuplicates:
    """The result: `members` (id, node, node2) and `links` (a, a2, b, b2) between different texts.

    Rows without id or text, and texts shorter than `min_chars` once squeezed, take no part. Rows
    that repeat an id and text count once. Other columns of the input are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, min_chars: int = 200):
        spark = df.sparkSession
        min_chars = max(min_chars, SHINGLE)
        src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        cols = ", ".join(f"s{j} bigint" for j in range(SKETCH_LONGS))
        hashed = src.mapInArrow(_hashed_rows(min_chars), "band bigint, node bigint, facts binary")
        parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * BANDS // PART_ROWS)), MAX_PARTS)
        runs = hashed.repartition(parts, "band").sortWithinPartitions("band").mapInArrow(_split_rows, f"kind tinyint, a bigint, b bigint, id string, {cols}")
        runs = materialize(runs, "runs")
        rows = runs.where("kind = 2").select("id", F.col("a").alias("node"), F.col("b").alias("node2"), *[f"s{j}" for j in range(SKETCH_LONGS)])
        self.members = rows.select("id", "node", "node2").distinct()
        sk = rows.where("s0 is not null").dropDuplicates(["node"]).select("node", *[f"s{j}" for j in range(SKETCH_LONGS)])
        runs = runs.where("kind < 2").select("kind", "a", "b").distinct()
        floor = sketch_floor(threshold)
        light = runs.where("kind = 0").select("a", "b")
        light = light.join(sk.alias("x"), F.col("a") == F.col("x.node")).join(sk.alias("y"), F.col("b") == F.col("y.node")).where(_agree("x", "y") >= floor).select("a", "b")
        heavy = runs.where("kind = 1").select(F.col("a").alias("band"), F.col("b").alias("node"))
        sized = heavy.join(heavy.groupBy("band").agg(F.ceil(F.count("*") / MAX_RUN).cast("int").alias("blocks")), "band").join(sk, "node")
        sized = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        x, y = spread.alias("x"), spread.alias("y")
        on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "bi", "bj")] + [F.col("x.node") < F.col("y.node")]
        heavy_pairs = x.join(y, on).where(_agree("x", "y") >= floor).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        pairs = materialize(light.union(heavy_pairs).distinct(), "candidates")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = materialize(rows.join(nodes, "node", "left_semi").groupBy("node", "node2").agg(F.min("id").alias("id")).select("id").distinct(), "ids")
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        texts = src.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_squeezed_texts(min_chars), "node bigint, node2 bigint, t string")
        texts = texts.dropDuplicates(["node", "node2"])
        ta = texts.select(F.col("node").alias("a"), F.col("node2").alias("a2"), F.col("t").alias("ta"))
        tb = texts.select(F.col("node").alias("b"), F.col("node2").alias("b2"), F.col("t").alias("tb"))
        both = pairs.join(ta, "a").join(tb, "b").select("a", "a2", "b", "b2", "ta", "tb")
        self.links = materialize(both.mapInArrow(_verified(threshold), "a bigint, a2 bigint, b bigint, b2 bigint"), "links")

    def pairs(self) -> DataFrame:
        """id_a < id_b: every pair of ids whose texts are linked or the same."""
        m = self.members
        x = m.select(F.col("id").alias("ia"), F.col("node").alias("a"), F.col("node2").alias("a2"))
        y = m.select(F.col("id").alias("ib"), F.col("node").alias("b"), F.col("node2").alias("b2"))
        linked = self.links.join(x, ["a", "a2"]).join(y, ["b", "b2"]).select("ia", "ib")
        copied = m.groupBy("node", "node2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        same = m.join(copied, ["node", "node2"])
        same = same.select(F.col("id").alias("ia"), "node", "node2").join(same.select(F.col("id").alias("ib"), "node", "node2"), ["node", "node2"]).where("ia < ib").select("ia", "ib")
        every = linked.where("ia <> ib").unionByName(same)
        return every.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()

    def groups(self, rounds: int = 30) -> DataFrame:
        """id, group_id (the smallest id of its group), n_links (links of its text to other texts): one
        row per id and text.

        Components by the smallest label among neighbours, with the labels of labels taken each
        round (path halving), until nothing changes; each round is written to the shared folder. A label
        is an id with its text, so ids that stand for two texts keep them apart.
        Raises if `rounds` don't suffice, rather than giving split groups.
        """
        links = self.links
        both = materialize(links.union(links.select("b", "b2", "a", "a2")), "edges")
        rep = self.members.groupBy("node", "node2").agg(F.min("id").alias("id")).select("node", "node2", F.struct("id", "node", "node2").alias("label"))
        labels = materialize(both.select(F.col("a").alias("node"), F.col("a2").alias("node2")).distinct().join(rep, ["node", "node2"]), "labels")
        labels = labels.withColumn("start", F.col("label"))
        for _ in range(rounds):
            near = both.join(labels.select(F.col("node").alias("b"), F.col("node2").alias("b2"), F.col("label").alias("l")), ["b", "b2"]).groupBy(F.col("a").alias("node"), F.col("a2").alias("node2")).agg(F.min("l").alias("l"))
            nxt = labels.join(near, ["node", "node2"]).select("node", "node2", "start", F.col("label").alias("was"), F.least("label", "l").alias("label"))
            jump = nxt.select(F.col("start").alias("label"), F.col("label").alias("far"))
            nxt = nxt.join(jump, "label", "left").select("node", "node2", "start", "was", F.least("label", F.coalesce("far", "label")).alias("label"))
            nxt = materialize(nxt, "labels")
            labels = nxt.drop("was")
            if nxt.where("was <> label").limit(1).count() == 0:
                break
        else:
            raise RuntimeError(f"components need more than {rounds} rounds")
        degree = both.groupBy(F.col("a").alias("node"), F.col("a2").alias("node2")).agg(F.count("*").alias("n_links"))
        return (
            self.members.join(rep.select("node", "node2", F.col("label.id").alias("own")), ["node", "node2"])
            .join(labels.select("node", "node2", F.col("label.id").alias("group")), ["node", "node2"], "left")
            .join(degree, ["node", "node2"], "left")
            .select("id", F.coalesce("group", "own").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
