"""Splitting documents at natural boundaries, in ranges.

A text, or a file, is worked through in ranges of RANGE characters (bytes for files). Detection sees a
range and, behind it, as much as the heading that is open at its end takes (a heading is one line, so
each place is looked at once more at most); no step needs a whole document. Each range reports
its length, its line breaks and its pieces of text between possible unit starts. The reports are
stitched by prefix sums over the ranges of a document: of lengths, which turns places in a range
into offsets in the document; of line breaks, which tells whether the first text of a range opens a
line (or follows a blank one) although the break lies in an earlier range; and of unit starts, which
numbers the units. The sums run over a few numbers per range; a document of one range needs none.
Units over the limit are cut on a grid that starts at the unit: the cut near each
grid point is the last sentence end (else line end, else blank) within the reach before it. A cut
depends on nothing but its own grid cell, so pieces come out by offset, each by itself, from the range
in which its text begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.session import materialize

RANGE = 8192
MAX_CHARS = 900
OVERLAP = 80
REACH = 220  # how far before a grid point a natural cut may lie
STRIDE = MAX_CHARS - OVERLAP - REACH  # so that stride + reach + overlap is the limit

_GAP = r"[^\S\n]*"
_NUM = r"[0-9０-９](?:[^\S\n]*[0-9０-９])*"
_OPEN = r"[(（\[［{｛<＜〈《「『【〔〖〘⟨⟪]"
_CLOSE = r"[)）\]］}｝>＞〉》」』】〕〗〙⟩⟫]"
#: What opens a unit, by structure; matched where a line's first character is that is not blank.
MARKS = {
    "article": re.compile(rf"제{_GAP}{_NUM}{_GAP}조{_GAP}(?:의{_GAP}{_NUM}{_GAP})?{_OPEN}[^\n]*?{_CLOSE}"),
    "clause": re.compile(r"[①-⑳⓪-⓴⓵-⓾❶-➓㉑-㉟㊱-㊿]"),
    "numbered": re.compile(r"[0-9]{1,2}[.)][^\S\n]"),
    "qa_pair": re.compile(r"[QA]\."),
}
_LINE = re.compile(r"[^\S\n]*(?=\S)")
_SENTENCE = re.compile(r"[.!?。…]+[\"'”’)\]』」】]*(?=\s)")

REPORT = (
    "uid bigint, id {id}, range_no int, n_ranges int, n_chars bigint, n_breaks bigint, first_mark boolean, first_breaks bigint, last_breaks bigint, "
    "seg_first array<bigint>, seg_last array<bigint>, seg_mark array<string>, structure string"
)


def report(full: str, lo: int, hi: int, structure: str) -> tuple:
    """What the range full[lo:hi] holds: (breaks, whether its first text is a mark, breaks before its
    first text, breaks before the end of its last text, first and last place of text in each segment,
    mark of each). A segment starts at each text that opens a unit, and at the first text of the range.
    Behind hi only a mark that begins before it is read."""
    text = full[lo:hi]
    breaks = text.count("\n")
    if not text or text.isspace():
        return breaks, False, None, None, [], [], []
    lead = len(text) - len(text.lstrip())
    mark = MARKS.get(structure)
    starts = [lead]
    if mark is None:  # flat: a text that follows a blank line
        for m in re.finditer(r"\n[^\S\n]*\n\s*(?=\S)", text):
            if lead < m.end() < len(text):
                starts.append(m.end())
        first_mark, marks = True, [None] * len(starts)
    else:
        head = mark.match(full, lo + lead)
        first_mark, marks = head is not None, [head and head[0]]
        at = text.find("\n", lead)
        while at >= 0:
            m = _LINE.match(text, at + 1)
            head = mark.match(full, lo + m.end()) if m and m.end() < len(text) else None
            if head:
                starts.append(m.end())
                marks.append(head[0])
            at = text.find("\n", at + 1)
    ends = [*starts[1:], len(text)]
    last = [s + len(text[s:e].rstrip()) - 1 for s, e in zip(starts, ends)]
    return breaks, first_mark, text.count("\n", 0, lead), text.count("\n", 0, last[-1] + 1), starts, last, marks


_NAMES = [f.split()[0] for f in REPORT.split(", ")]


def _types(key: pa.DataType) -> list[pa.DataType]:
    return [pa.int64(), key, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string()]


def _reports(ahead: int | None):
    """Rows of text to reports of their ranges; with `ahead`, the text of each range and so much behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = _types(batch.column("id").type) + ([] if ahead is None else [pa.string()])
            names = _NAMES + ([] if ahead is None else ["text"])
            rows, size = [], 0
            for uid, key, text, structure in zip(*(batch.column(c).to_pylist() for c in ("uid", "id", "text", "structure"))):
                n = max(-(-len(text) // RANGE), 1)
                for k in range(n):
                    lo, hi = k * RANGE, min(k * RANGE + RANGE, len(text))
                    row = (uid, key, k, n, hi - lo, *report(text, lo, hi, structure), structure)
                    rows.append(row if ahead is None else (*row, text[lo : hi + ahead]))
                    size += hi - lo
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def reports(src: DataFrame, ahead: int | None = None) -> DataFrame:
    """The reports of all ranges of a prepared table, written once: a row's uid stays what it is."""
    schema = REPORT.format(id=src.schema["id"].dataType.simpleString()) + ("" if ahead is None else ", text string")
    return materialize(src.select("uid", "id", "text", "structure").mapInArrow(_reports(ahead), schema), "ranges")


def placed(reports: DataFrame) -> DataFrame:
    """uid, range_no, off, units_before, opens of documents of several ranges: the characters and units
    before each range, and whether its first text opens a unit. The window runs over numbers only."""
    before = Window.partitionBy("uid").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    r = reports.where("n_ranges > 1").select("uid", "range_no", "structure", "n_chars", "n_breaks", "first_mark", "first_breaks", "last_breaks", F.greatest(F.size("seg_first") - 1, F.lit(0)).alias("more"))
    r = r.withColumn("off", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))
    r = r.withColumn("breaks_before", F.coalesce(F.sum("n_breaks").over(before), F.lit(0)))
    r = r.withColumn("last_at", F.max(F.col("breaks_before") + F.col("last_breaks")).over(before))
    gap = F.col("breaks_before") + F.col("first_breaks") - F.col("last_at")
    need = F.when(F.col("structure").isin(*MARKS), 1).otherwise(2)
    opens = F.col("first_mark") & (F.col("last_at").isNull() | (gap >= need))
    r = r.withColumn("opens", F.coalesce(opens, F.lit(False)))
    r = r.withColumn("units_before", F.coalesce(F.sum(F.col("more") + F.col("opens").cast("int")).over(before), F.lit(0)))
    return r.select("uid", "range_no", "off", "units_before", "opens")


def stitch(reports: DataFrame) -> DataFrame:
    """uid, id, unit_no, start, stop (offsets of the unit's first and behind its last text), mark,
    structure, n_chars. Reports have been written; a document of one range is its own table of boundaries."""
    keep = ["uid", "id", "structure", "off", "units_before", "opens", F.posexplode(F.arrays_zip("seg_first", "seg_last", "seg_mark")).alias("i", "z")]
    no = (F.col("units_before") + F.col("i") + F.col("opens").cast("int")).cast("int").alias("unit_no")
    at = [(F.col("off") + F.col("z.seg_first")).alias("start"), (F.col("off") + F.col("z.seg_last") + 1).alias("stop")]
    mark = F.when((F.col("i") > 0) | F.col("opens"), F.col("z.seg_mark")).alias("mark")
    one = reports.where("n_ranges = 1").withColumns({"off": F.lit(0).cast("bigint"), "units_before": F.lit(0).cast("bigint"), "opens": F.col("first_mark")})
    many = reports.where("n_ranges > 1").join(placed(reports), ["uid", "range_no"])
    columns = ["uid", "id", "structure", no, *at, mark]
    one, many = one.select(*keep).select(*columns), many.select(*keep).select(*columns)
    many = many.groupBy("uid", "unit_no").agg(F.first("id").alias("id"), F.first("structure").alias("structure"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("mark").alias("mark"))
    return one.unionByName(many).withColumn("n_chars", F.col("stop") - F.col("start"))


def prepared(df: DataFrame, text_col: str, structure_col: str, keep: Sequence[str]) -> DataFrame:
    """keep..., text, structure (lower case, unknown and null are flat) and uid for rows with a text."""
    s = F.lower(F.trim(F.coalesce(F.col(structure_col), F.lit("flat"))))
    return df.where(F.col(text_col).isNotNull()).select(
        *keep, F.col(text_col).alias("text"), F.when(s.isin(*MARKS), s).otherwise(F.lit("flat")).alias("structure"), F.monotonically_increasing_id().alias("uid")
    )


def units(df: DataFrame, id_col: str, text_col: str = "text", structure_col: str = "structure") -> DataFrame:
    """id, unit_no, start, stop, n_chars for the units of each document.

    A text that is null gives nothing, one without text no unit. Structures other than article,
    clause, numbered and qa_pair count as flat. Each row is a document of its own, also if ids
    repeat or are null. Lengths are code points without surrounding whitespace. The reports are written
    to the shared folder while the result is built.
    """
    src = prepared(df, text_col, structure_col, [F.col(id_col).alias("id")])
    return stitch(reports(src)).select("id", "unit_no", "start", "stop", "n_chars")


def units_found(df: DataFrame, id_col: str, limit: int = MAX_CHARS) -> DataFrame:
    """The units over the limit. Only ids and offsets are shuffled, never texts."""
    src = prepared(df, "text", "structure", [F.col(id_col).alias("id")])
    return stitch(reports(src)).where(F.col("n_chars") > limit).select("id", "unit_no", "start", "n_chars")


def cut_points(text: str, lo: int, hi: int, goal: int) -> int:
    """The place behind the last sentence end in text[lo:goal], else line end, else blank, else goal."""
    best = -1
    for m in _SENTENCE.finditer(text, lo, min(goal + 1, hi)):
        if m.end() <= goal:
            best = m.end()
    if best > lo:
        return best
    for sep in ("\n", " "):
        at = text.rfind(sep, lo + 1, goal)
        if at > lo:
            return at + 1
    return goal


def pieces_of(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, int]]:
    """Offsets of the pieces of a unit, each at most `limit` long and starting `overlap` before the
    end of the one before; one piece if the unit is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    stride = limit - overlap - reach
    cuts = [0]
    goal = stride + reach
    while n - (cuts[-1] - (overlap if len(cuts) > 1 else 0)) > limit:
        cuts.append(cut_points(text, goal - reach, n, goal))
        goal += stride
    cuts.append(n)
    return [(max(0, a - (overlap if i else 0)), b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def piece_at(text: str, base: int, start: int, stop: int, k: int, limit: int, overlap: int, reach: int) -> tuple[int, int] | None:
    """Piece k of a unit by itself, from a text that begins at offset `base` and covers its cells."""
    n, stride = stop - start, limit - overlap - reach

    def cut(j: int) -> int:
        goal = stride * j + reach
        return 0 if j == 0 else cut_points(text, start - base + goal - reach, stop - base, start - base + goal) - (start - base)

    def more(j: int) -> bool:  # does a cut follow cut j?
        return n - (cut(j) - (overlap if j else 0)) > limit

    if k and not more(k - 1):
        return None
    first = cut(k)
    last = cut(k + 1) if more(k) else n
    return start + max(0, first - (overlap if k else 0)), start + last


def ahead_of(limit: int, overlap: int, reach: int) -> int:
    """How far behind the place where a piece's grid cells begin its text may reach."""
    return 4 * limit + overlap + reach


def cells_of(units: DataFrame, limit: int, overlap: int, reach: int) -> DataFrame:
    """A row per grid cell of each unit: k, and needs, the offset from which on its text is needed."""
    stride = limit - overlap - reach
    n_cells = F.when(F.col("n_chars") <= limit, 1).otherwise(F.floor(F.col("n_chars") / stride) + 2).cast("int")
    cells = units.withColumn("k", F.explode(F.sequence(F.lit(0), n_cells - 1)))
    return cells.withColumn("needs", F.greatest(F.col("start"), F.col("start") + stride * (F.col("k") - 1) - overlap))


def _pieces(limit: int, overlap: int, reach: int):
    """The pieces of the cells of a range, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, off, text, cells in zip(*(batch.column(c).to_pylist() for c in ("id", "off", "text", "cells"))):
                for c in cells:
                    span = piece_at(text, off, c["start"], c["stop"], c["k"], limit, overlap, reach)
                    if span:
                        out.append((key, c["unit_no"], c["k"], span[0], (c["mark"] or "").strip(), text[span[0] - off : span[1] - off]))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "unit_no", "piece_no", "start", "section", "text"])

    return run


def split_documents(df: DataFrame, id_col: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, reach: int = REACH) -> DataFrame:
    """doc_id, unit_no, piece_no, start (offset in the text), section (the mark that opens the unit),
    text: all of every document in pieces of at most `limit` characters; consecutive pieces of one
    unit overlap by `overlap`. Nothing is dropped: the pieces cover every unit from end to end.

    Ranges are written with their text and what a piece may need behind it. Boundaries are stitched from
    the reports; each grid cell then goes to the range in which its text begins, an equi join as
    ranges of rows have one length, and pieces are emitted range by range. No task sees a document whole."""
    src = prepared(df, "text", "structure", [F.col(id_col).cast("string").alias("id")])
    ranges = reports(src, ahead_of(limit, overlap, reach))
    cells = cells_of(stitch(ranges), limit, overlap, reach).withColumn("range_no", F.floor(F.col("needs") / RANGE).cast("int"))
    per = cells.groupBy("uid", "range_no").agg(F.collect_list(F.struct("unit_no", "k", "start", "stop", "mark")).alias("cells"))  # at most one per unit or `stride` characters of a range
    at = ranges.select("uid", "range_no", "id", (F.col("range_no") * F.lit(RANGE).cast("bigint")).alias("off"), "text").join(per, ["uid", "range_no"])
    return at.select("id", "off", "text", "cells").mapInArrow(_pieces(limit, overlap, reach), "doc_id string, unit_no int, piece_no int, start bigint, section string, text string")


# Files


class FileText:
    """The characters of a UTF-8 file that begin in bytes [start, start + size), and those behind as far
    as they are asked for. Paths are local or URIs of any file system pyarrow knows."""

    def __init__(self, path: str, start: int, size: int):
        fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.file, self.start, self.size, self.step = fs.open_input_file(name), start, size, 4096
        self.total = self.file.size()
        self._read(size + 4 + self.step)

    def _read(self, n: int) -> None:
        self.file.seek(self.start)
        raw = self.file.read(min(n, max(self.total - self.start, 0)))
        self.at_end = self.start + len(raw) >= self.total
        lo, hi = 0, min(self.size, len(raw))
        while lo < min(4, len(raw)) and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1
        own = raw[lo:hi].decode("utf-8", "replace")
        self.text, self.own = own + raw[hi:].decode("utf-8", "replace" if self.at_end else "ignore"), len(own)

    def more(self) -> bool:
        """Read twice as far behind the range; false at the end of the file."""
        if self.at_end:
            return False
        self.step *= 2
        self._read(self.size + 4 + self.step)
        return True

    def ahead(self, chars: int) -> None:
        while len(self.text) - self.own < chars and self.more():
            pass

    def close_heading(self, structure: str) -> None:
        """Read on while the line that is open at the end of the range may still become a mark."""
        if structure not in MARKS:
            return
        open_mark = regex.compile(MARKS[structure].pattern)
        m = _LINE.match(self.text, self.text.rfind("\n", 0, self.own) + 1)
        if not m or m.end() >= self.own:
            return
        while not MARKS[structure].match(self.text, m.end()):
            if not open_mark.match(self.text, m.end(), partial=True) or not self.more():
                return


def _file_reports(size: int):
    """Ranges of UTF-8 files: a range owns the characters whose first byte lies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, path, k, n, structure in zip(*(batch.column(c).to_pylist() for c in ("uid", "path", "range_no", "n_ranges", "structure"))):
                f = FileText(path, k * size, size)
                f.close_heading(structure)
                row = (uid, path, k, n, f.own, *report(f.text, 0, f.own, structure), structure)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _types(pa.string()))], _NAMES)

    return run


def _file_pieces(size: int, limit: int, overlap: int, reach: int):
    pieces = _pieces(limit, overlap, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, off, cells in zip(*(batch.column(c) for c in ("id", "range_no", "off", "cells"))):
                f = FileText(path.as_py(), k.as_py() * size, size)
                f.ahead(ahead_of(limit, overlap, reach))
                rows = pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([off.as_py()]), pa.array([f.text]), pa.array([cells.as_py()], cells.type)], ["id", "off", "text", "cells"])
                for out in pieces(iter([rows])):
                    yield out.rename_columns(["path", *out.schema.names[1:]])

    return run


def _file_ranges(spark: SparkSession, files: Sequence[tuple[str, str, int]], range_bytes: int) -> DataFrame:
    rows = spark.createDataFrame([(i, p, s if s in MARKS else "flat", n) for i, (p, s, n) in enumerate(files)], "uid bigint, path string, structure string, n bigint")
    rows = rows.withColumn("n_ranges", F.greatest(F.ceil(F.col("n") / range_bytes), F.lit(1)).cast("int"))
    ranges = rows.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.col("n_ranges") - 1)))
    ranges = ranges.repartition(F.col("uid"), F.col("range_no"))
    return materialize(ranges.mapInArrow(_file_reports(range_bytes), REPORT.format(id="string")), "ranges")


def file_units(spark: SparkSession, files: Sequence[tuple[str, str, int]], range_bytes: int = 4 << 20) -> DataFrame:
    """path, unit_no, start, stop, n_chars of files in the shared file system, given as (path,
    structure, bytes): ranges of `range_bytes` are read by different workers, none reads a file whole."""
    return stitch(_file_ranges(spark, files, range_bytes)).select(F.col("id").alias("path"), "unit_no", "start", "stop", "n_chars")


def file_pieces(spark: SparkSession, files: Sequence[tuple[str, str, int]], range_bytes: int = 4 << 20, limit: int = MAX_CHARS, overlap: int = OVERLAP, reach: int = REACH) -> DataFrame:
    """path, unit_no, piece_no, start, section, text: the pieces of files, as split_documents gives them for rows.

    Boundaries are stitched first; then each grid cell of each unit goes to the range in which the text
    it needs begins, found by an equi join on coarse offsets, and every range is read once more to
    emit its pieces."""
    ranges, coarse = _file_ranges(spark, files, range_bytes), max(range_bytes // 4, 1)
    cells = cells_of(stitch(ranges), limit, overlap, reach).withColumn("bucket", F.floor(F.col("needs") / coarse))
    spans = ranges.where("n_chars > 0").join(placed(ranges).select("uid", "range_no", "off"), ["uid", "range_no"], "left").select("uid", "range_no", F.coalesce("off", F.lit(0)).alias("off"), F.col("n_chars").alias("range_chars"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("off") / coarse), F.floor((F.col("off") + F.col("range_chars") - 1) / coarse))))
    at = cells.join(spans, ["uid", "bucket"]).where((F.col("off") <= F.col("needs")) & (F.col("needs") < F.col("off") + F.col("range_chars")))
    per = at.groupBy("id", "uid", "range_no", "off").agg(F.collect_list(F.struct("unit_no", "k", "start", "stop", "mark")).alias("cells"))  # at most one per unit or `stride` characters of a range
    return per.select("id", "range_no", "off", "cells").mapInArrow(_file_pieces(range_bytes, limit, overlap, reach), "path string, unit_no int, piece_no int, start bigint, section string, text string")
