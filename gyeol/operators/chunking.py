"""Structure-aware chunking as column expressions: a document row becomes an array of chunks.

All of it is built from higher-order functions, so it runs in the JVM beside the scan, without a
shuffle and without Python. Packing keeps an accumulator (done pieces, buffer), as each step depends
on the buffer left by the one before. This family loses short pieces on purpose (under the minimum),
as its tests state; a lossless splitter is a different operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.functions.text import display_name, let, strip
from gyeol.session import spread

TARGET, LONGEST, SHORTEST, OVERLAP = 500, 900, 100, 80
MERGE_BELOW, FRAGMENT_BELOW, FAQ_WHOLE = 60, 20, 700
#: Where texts are cut, and what labels a piece.
SENTENCE_END = r"(?U)(?<=[다요음함][.!?])\s+"
ARTICLE = r"(?U)(?=제\s*\d+\s*조)"
CLAUSE = "(?=[①-⑮])"
NUMBERED = r"(?mdU)(?=^\s*(?:\d{1,2}[.)]|[가-힣][.)])\s)"
ARTICLE_LABEL = r"(?U)^제\s*(\d+)\s*조\s*[(（]?\s*([^)）\n]{0,24})?"
NUMBER_LABEL = r"(?U)^\s*(\d{1,2}[.)]|[가-힣][.)])"

_S = "array<string>"
_PAIR = "array<struct<text:string,label:string>>"


def _some(a: Column) -> Column:
    return F.filter(F.transform(a, strip), lambda x: F.length(x) > 0)


def split_sentences(text: Column) -> Column:
    """By line, then behind a final syllable with punctuation; no blank ones."""
    return _some(F.flatten(F.transform(_some(F.split(text, "\n")), lambda line: F.split(line, SENTENCE_END))))


def force_split(text: Column, step: Column, least: Column) -> Column:
    """Fixed steps; pieces under `least` are dropped."""
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / step), F.lit(0)).cast("int"))
    return F.filter(F.transform(at, lambda i: strip(F.substr(text, i * step + 1, step))), lambda p: F.length(p) >= least)


def split_by_length(text: Column, target: int | Column = TARGET, longest: int | Column = LONGEST, shortest: int | Column = SHORTEST, overlap: int = OVERLAP) -> Column:
    """Sentences packed to the target; each piece begins with the tail of the one before. A text
    within the limit stays whole, or goes if under the minimum; a sentence over it is cut by force."""
    target, longest, shortest = (F.lit(x).cast("int") if isinstance(x, int) else x for x in (target, longest, shortest))
    state = F.struct(F.array().cast(_S).alias("done"), F.lit("").alias("buf"))
    as_state = lambda done, buf: F.struct(done.alias("done"), buf.alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        buf, done = acc["buf"], acc["done"]
        flushed = F.when(buf != "", F.concat(done, F.array(buf))).otherwise(done)
        joined = F.when(buf != "", F.concat(buf, F.lit(" "), s)).otherwise(s)  # both are stripped
        tail = F.substr(buf, F.greatest(F.length(buf) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.lit("")
        carried = F.when(tail != "", strip(F.concat(tail, F.lit(" "), s))).otherwise(s)
        return (
            F.when(F.length(s) > longest, as_state(F.concat(flushed, force_split(s, target, shortest)), F.lit("")))
            .when((F.length(buf) + F.length(s) > target) & (buf != ""), as_state(F.concat(done, F.array(buf)), carried))
            .otherwise(as_state(done, joined))
        )

    packed = F.aggregate(split_sentences(text), state, step, lambda a: F.when(a["buf"] != "", F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]))
    whole = F.when(F.length(text) >= shortest, F.array(text)).otherwise(F.array().cast(_S))
    return F.when(F.length(text) <= longest, whole).otherwise(F.filter(packed, lambda p: F.length(p) >= shortest))


def pack(pieces: Column, target: int = TARGET) -> Column:
    """Neighbouring pieces joined by line breaks up to the target: (text, index of its first piece)."""
    kind = "array<struct<text:string,first:int>>"
    state = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("buf"), F.lit(0).alias("first"), F.lit(0).alias("i"))

    def step(a: Column, p: Column) -> Column:
        full = (F.length(a["buf"]) + F.length(p) > target) & (a["buf"] != "")
        piece = F.array(F.struct(a["buf"].alias("text"), a["first"].alias("first")))
        return F.struct(
            F.when(full, F.concat(a["done"], piece)).otherwise(a["done"]).alias("done"),
            F.when(full | (a["buf"] == ""), p).otherwise(F.concat(a["buf"], F.lit("\n"), p)).alias("buf"),
            F.when(full | (a["buf"] == ""), a["i"]).otherwise(a["first"]).alias("first"),
            (a["i"] + 1).alias("i"),
        )

    last = lambda a: F.when(a["buf"] != "", F.concat(a["done"], F.array(F.struct(a["buf"].alias("text"), a["first"].alias("first"))))).otherwise(a["done"])
    return F.aggregate(pieces, state, step, last)


def merge_short(pieces: Column, below: int = MERGE_BELOW) -> Column:
    """A piece under `below`, or behind one, is joined to the one before."""

    def step(a: Column, p: Column) -> Column:
        n = F.size(a)
        last = F.element_at(a, -1)
        join = (n > 0) & ((F.length(p) < below) | (F.length(F.try_element_at(a, F.lit(-1))) < below))
        return F.when(join, F.concat(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), p)))).otherwise(F.concat(a, F.array(p)))

    return F.aggregate(pieces, F.array().cast(_S), step)


def split_oversized(text: Column) -> Column:
    """By clause marks, packed; else by length; else the beginning."""
    packed = lambda subs: F.flatten(F.transform(pack(subs), lambda p: F.when(F.length(p["text"]) <= LONGEST, F.array(p["text"])).otherwise(split_by_length(p["text"]))))
    out = let(_some(F.split(text, CLAUSE)), lambda subs: F.when(F.size(subs) > 1, packed(subs)).otherwise(split_by_length(text)))
    return let(out, lambda o: F.when(F.size(o) > 0, o).otherwise(F.array(F.substr(text, F.lit(1), F.lit(LONGEST)))))


def article_label(piece: Column) -> Column:
    no, title = F.regexp_extract(piece, ARTICLE_LABEL, 1), strip(F.regexp_extract(piece, ARTICLE_LABEL, 2))
    bad = (F.length(title) > 20) | title.rlike("(다|다\\.|함|음)$") | (title == "")
    label = F.concat(F.lit("제"), no, F.lit("조"), F.when(bad, "").otherwise(F.concat(F.lit("("), title, F.lit(")"))))
    return F.when(piece.rlike(ARTICLE_LABEL), label).otherwise("")


def number_label(piece: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(piece, NUMBER_LABEL, 1), "[.)]+$", "")


def clause_label(piece: Column) -> Column:
    return F.regexp_extract(piece, "^([①-⑮])", 1)


def _labelled(texts: Column, label: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), label.alias("label")))


def article_pieces(text: Column) -> Column:
    merged = merge_short(_some(F.split(text, ARTICLE)))
    one = lambda p: let(article_label(p), lambda l: _labelled(F.when(F.length(p) <= LONGEST, F.array(p)).otherwise(split_oversized(p)), l))
    return F.flatten(F.transform(merged, one))


def packed_pieces(text: Column, cut: str, label) -> Column:
    """For clauses and numbered items: packed to the target, labelled by the first of each pack."""
    one = lambda raw, p: let(label(F.element_at(raw, p["first"] + 1)), lambda l: _labelled(F.when(F.length(p["text"]) <= LONGEST, F.array(p["text"])).otherwise(split_by_length(p["text"])), l))
    many = lambda raw: F.flatten(F.transform(pack(raw), lambda p: one(raw, p)))
    return let(_some(F.split(text, cut)), lambda raw: F.when(F.size(raw) < 2, _labelled(split_by_length(text), F.lit(""))).otherwise(many(raw)))


def structural(text: Column, pieces: Column) -> Column:
    """Under two pieces, or none but fragments: by length. Fragments are dropped."""
    flat = lambda: _labelled(split_by_length(text), F.lit(""))
    tidy = lambda a: F.filter(F.transform(a, lambda p: F.struct(strip(p["text"]).alias("text"), p["label"].alias("label"))), lambda p: F.length(p["text"]) >= FRAGMENT_BELOW)
    kept = tidy(let(pieces, lambda p: F.when(F.size(p) < 2, flat()).otherwise(p)))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(flat()))


def faq_pieces(text: Column) -> Column:
    """Whole up to 700 characters; else the answer is split and each piece repeats the question."""
    faq = lambda x: F.struct(x.alias("text"), F.lit("FAQ").alias("label"))

    def long(t: Column) -> Column:
        at = F.instr(t, "\nA. ")
        qa = t.startswith("Q. ") & (at > 0)
        question = F.when(qa, strip(F.substr(t, F.lit(4), at - 4))).otherwise("")
        answer = F.when(qa, strip(F.substr(t, at + 4, F.length(t)))).otherwise(t)
        prefix = let(question, lambda q: F.when(q != "", F.concat(F.lit("Q. "), q, F.lit("\nA. "))).otherwise(""))
        return let(F.struct(answer.alias("a"), prefix.alias("p")), lambda s: let(F.greatest(F.lit(TARGET) - F.length(s["p"]), F.lit(SHORTEST)).cast("int"), lambda b: parts(s, b)))

    def parts(s: Column, budget: Column) -> Column:
        got = let(split_by_length(s["a"], budget, budget, SHORTEST), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(s["a"])))
        return F.transform(got, lambda x: faq(strip(F.concat(s["p"], x))))

    return let(strip(text), lambda t: F.when(t == "", F.array().cast(_PAIR)).when(F.length(t) <= FAQ_WHOLE, F.array(faq(t))).otherwise(long(t)))


def chunk_documents(docs: DataFrame, by_structure: bool = True) -> DataFrame:
    """chunk_id, doc_id, chunk_order, text, section, char_count and what chunks inherit. Documents
    that aren't parsable or have no text give none; unknown structures are flat. metadata holds structure,
    compliance_no and is_latest, the last two null where docs has no such column."""
    s, text = F.lower(F.coalesce("structure", F.lit("flat"))), F.col("text")
    flat = _labelled(F.transform(split_by_length(text), strip), F.lit(""))
    pieces = F.when(s == "qa_pair", faq_pieces(text))
    if by_structure:
        pieces = (
            pieces.when(s == "article", structural(text, article_pieces(text)))
            .when(s == "clause", structural(text, packed_pieces(text, CLAUSE, clause_label)))
            .when(s == "numbered", structural(text, packed_pieces(text, NUMBERED, number_label)))
        )
    name = display_name(F.col("title"), F.col("subtitle"), F.col("orig_filename"))
    needed = ["doc_id", "text", "structure", "title", "subtitle", "orig_filename", "doc_type", "category", "effective_date", "source_url"]
    more = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("compliance_no", "string"), ("is_latest", "boolean"))]
    rows = spread(docs.where(F.col("is_parsable") & text.isNotNull()).select(*needed, *more)).select("doc_id", name.alias("doc_display_name"), "doc_type", "category", "effective_date", "source_url", s.alias("structure"), "compliance_no", "is_latest", F.posexplode_outer(pieces.otherwise(flat)).alias("pos", "piece"))
    rows = rows.where("pos is not null")  # posexplode itself would add a filter that makes all pieces a second time
    order = F.col("pos") + 1
    return rows.select(
        F.format_string("%s_c%03d", "doc_id", order).alias("chunk_id"), "doc_id", order.alias("chunk_order"), F.col("piece.text").alias("text"), F.col("piece.label").alias("section"),
        F.length("piece.text").alias("char_count"), "doc_display_name", "doc_type", "category", F.coalesce(F.col("effective_date").cast("string"), F.lit("")).alias("effective_date"), "source_url",
        F.struct("structure", "compliance_no", "is_latest").alias("metadata"),
    )


def length_stats(chunks: DataFrame, group: str) -> DataFrame:
    """n, whole average, upper median, value at 95 %, maximum and number over the limit, by group.

    Positions are those of a sorted list: n // 2 and int(0.95 n). Lengths are first counted by value,
    so the window runs over distinct lengths, not over rows."""
    from pyspark.sql.window import Window

    counts = chunks.groupBy(group, F.col("char_count").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy("v")
    total = Window.partitionBy(group)
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(total))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("v")))
    return c.groupBy(group).agg(
        F.max("total").alias("n"), F.floor(F.sum(F.col("v") * F.col("n")) / F.max("total")).alias("avg_chars"),
        at(F.floor(F.col("total") / 2)).alias("median_chars"), at(F.floor(F.col("total") * 0.95)).alias("p95_chars"), F.max("v").alias("max_chars"),
        F.coalesce(F.sum(F.when(F.col("v") > LONGEST, F.col("n"))), F.lit(0)).alias("n_over"),
    )
