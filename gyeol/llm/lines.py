"""Lines and blocks of lines repeated across the documents of one source, by suffix arrays.

Each line stands for an id, a hash of its letters; the ids of a source, text after text, are one
long sequence, in which every line that by itself spans too few documents (and so can be in no block
that spans enough) is a separator of its own. A suffix that begins at another line therefore ends, for
the purpose of common prefixes, at the next separator, at the latest after WIDTH lines. Its
occurrences in other texts add only documents, so the array is made of the distinct suffixes: they
are partitioned by source and first line, sorted, and read in order; what a suffix has in common with
the one before it (the common-prefix array) is a node of the suffix tree, as is each whole suffix. Between two
nodes the set of documents can't change, so documents are counted at nodes only, by partial
aggregates. The block of a line is the longest node above its suffix that spans enough documents;
the lines covered by blocks are deleted from each text. Blocks longer than WIDTH lines come out as
blocks of WIDTH lines one line apart, which cover the same lines.

Nothing is gathered by source or document: all groups are rows, lines of one text, or distinct
suffixes read in a stream. Tables are broadcast only up to BROADCAST_ROWS rows, counted first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.session import materialize

MIN_LETTERS = 12
MIN_DOCS = 4
MIN_SHARE_INVERSE = 10  # a tenth of the documents
WIDTH = 64
#: Up to so many rows of a few longs are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(line: str) -> str:
    """The letters of a line after NFC, letter case ignored."""
    s = unicodedata.normalize("NFC", line).lower()
    s = _NOT_LETTERS.sub("", s)
    return s if s.isalpha() else "".join(c for c in s if c.isalpha())


def line_id(key: str) -> int:
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h - (h >> 63 << 64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int | None] = {}  # lines of a worker that were seen before: repeated ones above all
    for batch in batches:
        nos, ids = [], []
        for t in batch.column("text").to_pylist():
            a, b = [], []
            for i, line in enumerate(t.split("\n"), 1) if t else ():
                h = memo.get(line, 0)
                if h == 0:
                    key = letters(line) if len(line) >= MIN_LETTERS else ""
                    h = line_id(key) if len(key) >= MIN_LETTERS else None
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[line] = h
                if h is not None:
                    a.append(i)
                    b.append(h)
            nos.append(a)
            ids.append(b)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text_hash", "doc", "src")), pa.array(nos, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))], ["id", "text_hash", "doc", "src", "nos", "ids"])


def source_key(*cols: Column) -> Column:
    """One string for a source; null is a value of its own."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])


def name_of(ids: np.ndarray) -> int:
    """64 bits that stand for a sequence of line ids."""
    h = xxhash.xxh3_64_intdigest(ids.tobytes(), len(ids))
    return h - (h >> 63 << 64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that is in reach of a block: its suffix up to the next separator or WIDTH lines."""
    for batch in batches:
        take, nos, ids, names = [], [], [], []
        for row, zs in enumerate(batch.column("zs").to_pylist()):
            zs = sorted((z["p"], z["no"], z["line"]) for z in zs)
            no = np.array([z[1] for z in zs], np.int32)
            line = np.array([z[2] for z in zs], np.int64)
            place = np.array([z[0] for z in zs])
            stops = np.append(np.flatnonzero(np.diff(place) != 1) + 1, len(place))
            ends = stops[np.searchsorted(stops, np.arange(len(place)), "right")]
            for i, e in enumerate(ends.tolist()):
                e = min(e, i + WIDTH)
                take.append(row)
                nos.append(no[i:e])
                ids.append(line[i:e])
                names.append(name_of(line[i:e]))
        kept = [batch.column(c).take(pa.array(take, pa.int64())) for c in ("id", "text_hash", "doc", "src")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(nos, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64())), pa.array(names, pa.int64())], ["id", "text_hash", "doc", "src", "nos", "suffix", "name"])


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the distinct suffixes in order: the nodes of the suffix tree, by common prefixes of neighbours."""
    before, last = np.empty(0, np.int64), None
    for batch in batches:
        srcs, nodes, depths = [], [], []
        for src, s in zip(batch.column("src").to_pylist(), batch.column("suffix").to_pylist()):
            s = np.array(s, np.int64)
            m = min(len(s), len(before)) if src == last else 0
            differ = np.flatnonzero(s[:m] != before[:m])
            for d in {int(differ[0]) if len(differ) else m, len(s)} - {0}:
                srcs.append(src)
                nodes.append(name_of(s[:d]))
                depths.append(d)
            before, last = s, src
        yield pa.RecordBatch.from_arrays([pa.array(srcs, pa.string()), pa.array(nodes, pa.int64()), pa.array(depths, pa.int32())], ["src", "node", "depth"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of each distinct suffix by name."""
    for batch in batches:
        srcs, names, nodes, depths = [], [], [], []
        for src, name, s in zip(*(batch.column(c).to_pylist() for c in ("src", "name", "suffix"))):
            s = np.array(s, np.int64)
            for d in range(1, len(s) + 1):
                srcs.append(src)
                names.append(name)
                nodes.append(name_of(s[:d]))
                depths.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(srcs, pa.string()), pa.array(names, pa.int64()), pa.array(nodes, pa.int64()), pa.array(depths, pa.int32())], ["src", "name", "node", "depth"])


def _hint(df: DataFrame) -> DataFrame:
    """For a written table: broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def repeated_blocks(df: DataFrame, id_col: str, doc_col: str, text_col: str, source: Column, min_docs: int = MIN_DOCS, inverse: int = MIN_SHARE_INVERSE) -> tuple[DataFrame, DataFrame]:
    """(positions, blocks).

    positions: id, text_hash, src, line_nos (the lines of the longest block that starts at a line and
    spans enough documents), node (the block's name), block_lines, n_docs. blocks: src, node,
    block_lines, n_docs of the blocks at positions. Lines with too few letters are left out of the
    sequence, so a block goes on behind them. A null text has no lines; rows with a null document id count
    as no document; repeated rows count once, as documents are counted. Lines are split at \\n only.
    Jobs run while the result is built: suffixes, their tree and the spanning nodes are written.
    """
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(doc_col).cast("string").alias("doc"), source.alias("src"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    key = f"id {kind}, text_hash bigint, doc string, src string"
    rows = src.mapInArrow(_lines, f"{key}, nos array<int>, ids array<bigint>").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "lines")
    total = rows.where("doc is not null").groupBy("src").agg(F.countDistinct("doc").alias("docs"))
    enough = (F.col("n") >= min_docs) & (F.col("n") * inverse >= F.col("docs"))

    flat = rows.select("row", "id", "text_hash", "doc", "src", F.posexplode(F.arrays_zip("nos", "ids")).alias("p", "z"))
    flat = flat.select("row", "id", "text_hash", "doc", "src", "p", F.col("z.nos").alias("no"), F.col("z.ids").alias("line"))
    counted = flat.where("doc is not null").select("src", "line", "doc").distinct().groupBy("src", "line").agg(F.count("*").alias("n"))
    spanning = materialize(counted.where(F.col("n") >= min_docs).join(total, "src").where(enough).select("src", "line"), "spanning")
    near = flat.join(_hint(spanning), ["src", "line"], "left_semi")
    near = near.groupBy("row").agg(*[F.first(c).alias(c) for c in ("id", "text_hash", "doc", "src")], F.collect_list(F.struct("p", "no", "line")).alias("zs"))  # lines of one text
    at = materialize(near.drop("row").mapInArrow(_suffixes, f"{key}, nos array<int>, suffix array<bigint>, name bigint"), "suffixes")

    distinct = materialize(at.select("src", "name", "suffix").dropDuplicates(["src", "name"]), "distinct")
    ordered = distinct.select("src", "suffix").repartition(F.col("src"), F.col("suffix")[0]).sortWithinPartitions("src", "suffix")
    tree = materialize(ordered.mapInArrow(_tree, "src string, node bigint, depth int").distinct(), "tree")
    above = distinct.mapInArrow(_prefixes, "src string, name bigint, node bigint, depth int").join(_hint(tree), ["src", "node", "depth"], "left_semi")
    above = materialize(above, "above")

    docs = at.where("doc is not null").select("src", "name", "doc").distinct()
    per = docs.join(_hint(above), ["src", "name"]).select("src", "node", "depth", "doc").distinct().groupBy("src", "node", "depth").agg(F.count("*").alias("n"))
    nodes = materialize(per.where(F.col("n") >= min_docs).join(total, "src").where(enough).select("src", "node", "depth", "n"), "nodes")
    best = above.join(_hint(nodes), ["src", "node", "depth"]).groupBy("src", "name").agg(F.max(F.struct("depth", "n", "node")).alias("b"))
    best = materialize(best.select("src", "name", F.col("b.depth").alias("block_lines"), F.col("b.n").alias("n_docs"), "b.node"), "best")
    found = at.join(_hint(best), ["src", "name"])
    positions = found.select("id", "text_hash", "src", F.slice("nos", 1, F.col("block_lines")).alias("line_nos"), "node", "block_lines", "n_docs")
    return positions, best.select("src", "node", "block_lines", "n_docs").distinct()


def covered(positions: DataFrame) -> DataFrame:
    """(id, text_hash, line_no) of all lines covered by a block."""
    return positions.select("id", "text_hash", F.explode("line_nos").alias("line_no")).distinct()


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if t is not None and gone:
                gone = set(gone)
                t = "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in gone)
            out.append(t)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string()), pa.array([len(g) if g else 0 for g in batch.column("gone").to_pylist()], pa.int32())], ["id", "text", "n_removed"])


def without_repeated(df: DataFrame, id_col: str, text_col: str, positions: DataFrame) -> DataFrame:
    """id, text, n_removed: one row per distinct id and text, without the lines that repeat."""
    gone = covered(positions).groupBy("id", "text_hash").agg(F.collect_list("line_no").alias("gone"))  # lines of one text
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct().withColumn("text_hash", F.xxhash64("text"))
    kind = src.schema["id"].dataType.simpleString()
    joined = src.alias("s").join(gone.alias("g"), F.col("s.id").eqNullSafe(F.col("g.id")) & (F.col("s.text_hash") == F.col("g.text_hash")), "left").select("s.id", "s.text", "g.gone")
    return joined.mapInArrow(_without, f"id {kind}, text string, n_removed int").withColumnRenamed("id", id_col)
