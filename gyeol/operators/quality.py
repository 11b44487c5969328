"""Quality, duplicates and versions of documents and FAQ rows; numbering, sampling and remapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.functions import text as T
from gyeol.operators.overlaps import best_overlaps
from gyeol.session import materialize


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """df with a gapless number from 1 per keys in `order`, which must be unique within keys.

    A key may hold any share of the rows: rows are range-partitioned by keys and order, numbered
    within each part of a key, and raised by the prefix sum of the sizes of its earlier parts. The
    sizes are a row per key and part, however large the table."""
    parts = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, "ranged")
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    on = [local[c].eqNullSafe(sizes[c]) for c in keys] + [local["_part"] == sizes["_part"]]
    return local.join(sizes, on).select(*[local[c] for c in df.columns], (F.col("_local") + F.col("_before")).cast("bigint").alias(name))


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, original, is_duplicate for the parsable documents outside the FAQ with a hash: of equal
    hashes the first by file name (then id) stays. One aggregate finds the first of each hash."""
    d = docs.where(F.col("is_parsable") & (F.coalesce("doc_type", F.lit("")) != "FAQ") & T.filled(F.col("content_hash")).isNotNull()).select("doc_id", "content_hash", "orig_filename")
    first = d.groupBy("content_hash").agg(F.min(F.struct("orig_filename", "doc_id")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "content_hash").select("doc_id", F.col("f.orig_filename").alias("original"), (F.col("doc_id") != F.col("f.doc_id")).alias("is_duplicate"))


def mark_versions(docs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """doc_id, superseded_by of documents older than the latest of their title and subtitle; after
    duplicates are out. Needs a subtitle, a date, and two dates in the group; equal hashes stay."""
    key = T.squash(F.concat(F.col("title"), F.lit("|"), F.col("subtitle")))
    d = docs.where(F.col("is_parsable") & (F.coalesce("doc_type", F.lit("")) != "FAQ") & (F.coalesce("subtitle", F.lit("")) != "") & F.col("effective_date").isNotNull() & F.col("title").isNotNull())
    d = d.join(duplicates.where("is_duplicate").select("doc_id"), "doc_id", "left_anti").select("doc_id", "effective_date", "content_hash", key.alias("k"))
    top = d.groupBy("k").agg(F.max(F.struct("effective_date", "doc_id", "content_hash")).alias("l"), F.min("effective_date").alias("lo"), F.max("effective_date").alias("hi")).where("lo < hi")
    return d.join(top, "k").where((F.col("doc_id") != F.col("l.doc_id")) & ~F.col("content_hash").eqNullSafe(F.col("l.content_hash"))).select("doc_id", F.col("l.doc_id").alias("superseded_by"))


def date_issues(docs: DataFrame) -> DataFrame:
    """Dates over 30 days before, or two years after, the approval."""
    gap = F.datediff("effective_date", "compliance_date")
    d = docs.where(F.col("is_parsable") & (F.coalesce("doc_type", F.lit("")) != "FAQ")).withColumn("gap_days", gap)
    return d.where("gap_days < -30 or gap_days > 730").select("doc_id", "gap_days", F.when(F.col("gap_days") < 0, "approved_later").otherwise("long_ago").alias("issue"))


def apply_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """doc_id, title, subtitle, title_confidence with the corrected titles (doc_id, corrected_title,
    corrected_subtitle) where they aren't blank."""
    o = overrides.where(T.filled(F.col("corrected_title")).isNotNull() & T.filled(F.col("doc_id")).isNotNull()).dropDuplicates(["doc_id"])
    j = docs.join(o, "doc_id", "left")
    hit = F.col("corrected_title").isNotNull()
    return j.select(
        "doc_id", F.when(hit, F.trim("corrected_title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.coalesce(F.trim("corrected_subtitle"), F.lit(""))).otherwise(F.col("subtitle")).alias("subtitle"),
        F.when(hit, "manual").otherwise(F.col("title_confidence")).alias("title_confidence"),
    )


#: How a sentence ends.
SENTENCE = r"(합니다|입니다|한다|됩니다|바랍니다)[.\s]*$"


def title_problems(title: Column, subtitle: Column) -> Column:
    """The names of what is wrong with a title, in a fixed order."""
    t, s = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(subtitle, F.lit("")))
    rules = {
        "unreadable_font": t.contains("(cid:"),
        "starts_as_article": t.rlike(r"^제\s*\d+\s*조"),
        "clause_mark": t.rlike("[①-⑳]"),
        "document_number": t.rlike(r"^[0-9\-./ ]+$"),
        "sentence": t.rlike(SENTENCE),
        "too_long": F.length(t) > 45,
        "no_kind_word": ~t.rlike("|".join(T.KIND_WORDS)),
        "bad_subtitle": (s != "") & (s.rlike(SENTENCE) | (F.length(s) > 45)),
    }
    return F.when(t == "", F.array(F.lit("no_title"))).otherwise(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))


def title_candidates(docs: DataFrame, k: int = 4) -> DataFrame:
    """Up to k lines of the first 1200 characters that could be the title, in order of appearance."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.substring("text", 1, 1200), "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", T.WS, " ")))
    ok = lines.where(F.length("line").between(4, 45) & F.col("line").rlike("|".join(T.KIND_WORDS)) & ~F.col("line").rlike(r"\(cid:|[①-⑳]|준법감시인|보존년한") & ~F.col("line").rlike(SENTENCE))
    first = ok.groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))
    per = first.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "line"))), 1, k).alias("c"))  # lines of 1200 characters
    return per.select("doc_id", F.array_join(F.transform("c", lambda x: x["line"]), "|").alias("candidates"))


LABEL = r"^(Q\.|A\.|질문|답변)"
BROKEN = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]"


def faq_flags(faq: DataFrame, least_q: int = 8, least_a: int = 20, long_a: int = 1500) -> DataFrame:
    """faq_id, issue, detail for each thing wrong with a row; repeated rows are told once."""
    f = faq.select("faq_id", "bank_code", "category", "question", "answer", "source_url")
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    note = lambda cond, issue, detail: F.when(cond, F.struct(F.lit(issue).alias("issue"), detail.cast("string").alias("detail")))
    empty = [note(F.coalesce(F.col(c), F.lit("")) == "", "empty", F.lit(c)) for c in ("faq_id", "category", "question", "answer", "source_url")]
    rules = F.array_compact(
        F.array(
            *empty, note(F.length(q) < least_q, "question_short", F.length(q)), note(F.length(a) < least_a, "answer_short", F.length(a)), note(F.length(a) > long_a, "answer_long", F.length(a)),
            note(q.rlike(LABEL) | a.rlike(LABEL), "label_left", F.lit("")), note(q.rlike(BROKEN) | a.rlike(BROKEN), "broken_characters", F.lit("")),
        )
    )
    rows = f.select("faq_id", F.explode(rules).alias("r")).select("faq_id", "r.issue", "r.detail").distinct()
    twice = faq.groupBy("faq_id").agg(F.count("*").alias("n")).where("n > 1").select("faq_id", F.lit("duplicate_id").alias("issue"), F.col("n").cast("string").alias("detail"))
    return rows.unionByName(twice)


def faq_documents(faq: DataFrame) -> DataFrame:
    """FAQ rows as documents: one per faq_id, the one collected last; empty questions or answers are
    skipped; a status other than active makes it unparsable."""
    q, a = T.normalize_text("question"), T.normalize_text("answer")
    day = F.coalesce(F.try_to_date("collected_at", "yyyy-MM-dd"), F.try_to_date("collected_at", "yyyy.MM.dd"))
    f = faq.withColumn("q", q).withColumn("a", a).withColumn("day", day).where("q <> '' and a <> ''")
    last = f.groupBy("faq_id").agg(F.max(F.struct("day", "q", "a", "bank_code", "category", "source_url", "status")).alias("r")).select("faq_id", "r.*")
    text, status = F.concat(F.lit("Q. "), F.col("q"), F.lit("\nA. "), F.col("a")), F.coalesce("status", F.lit("active"))
    return last.select(
        F.col("faq_id").alias("doc_id"), "bank_code", F.col("q").alias("title"), text.alias("text"), F.lit("FAQ").alias("doc_type"), "category", F.when(status == "active", "qa_pair").otherwise("scanned").alias("structure"),
        F.col("day").alias("effective_date"), (status == "active").alias("is_parsable"), F.when(status != "active", F.concat(F.lit("status="), status)).otherwise("").alias("exclusion_reason"), F.length(text).alias("char_count"), T.content_hash(text).alias("content_hash"),
    )


def quota_dedup(faq: DataFrame, quota: int) -> DataFrame:
    """One row per question and answer (the first id), at most `quota` per bank and category."""
    d = faq.groupBy("question", "answer").agg(F.min(F.struct("faq_id", "bank_code", "category")).alias("r")).select("question", "answer", "r.*")
    w = Window.partitionBy("bank_code", "category").orderBy("faq_id", "question")
    return d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota)


def boilerplate(chunks: DataFrame, length: int = 150, min_docs: int = 3) -> DataFrame:
    """chunk_id, n_docs of chunks whose first `length` Hangul characters open chunks of `min_docs` documents."""
    fp = chunks.select("chunk_id", "doc_id", F.substring(F.regexp_replace("text", "[^가-힣]", ""), 1, length).alias("fp")).where(F.length("fp") == length)
    often = fp.groupBy("fp").agg(F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return fp.join(often, "fp").select("chunk_id", "n_docs")


#: Phrases of notices that many documents share.
BOILERPLATE = (
    r"금융감독원|분쟁조정을 신청|고객상담센터|1599-1111|1588-1111|자료열람요구권|위법계약해지|청약철회권|위법사실을 안 날|책임을 지지 않습니다|보증하지 않습니다|정확성을 보증"
    r"|참고용으로 제공되는|모든 요인을 설명한 것이 아|어떠한 손실에 대해서도|서명 또는 인|준법감시인|보존년한|이해를 돕고|참고자료이며|반드시 읽어보시기"
)


def suitable(text: Column, shortest: int = 150, longest: int = 900, foreign: float = 0.45) -> Column:
    """Long enough, short enough, mostly Hangul, and without a phrase of shared notices."""
    other = F.length(F.regexp_replace(text, r"(?U)[가-힣\s]", ""))
    return F.length(text).between(shortest, longest) & ~text.rlike(BOILERPLATE) & (other / F.length(text) <= foreign)


def quota_sample(pool: DataFrame, shares: dict[str, float], n: int, seed: str = "42", per_doc: dict[str, int] | None = None, default_per_doc: int = 3) -> DataFrame:
    """n rows by the shares of doc_type, categories in turn, at most so many of a document. Order is
    by a hash of seed and id. The sampling itself is the feature; windows are limited before shuffles."""
    per_doc = per_doc or {"FAQ": 1}
    h = pool.withColumn("h", F.md5(F.concat(F.lit(seed), F.col("chunk_id"))))
    cap = F.lit(default_per_doc)
    for t, k in per_doc.items():
        cap = F.when(F.col("doc_type") == t, k).otherwise(cap)
    h = h.withColumn("rd", F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "chunk_id"))).where(F.col("rd") <= max(default_per_doc, *per_doc.values())).where(F.col("rd") <= cap)
    most = max(round(n * s) for s in shares.values())
    h = h.withColumn("rc", F.row_number().over(Window.partitionBy("doc_type", "category").orderBy("h", "chunk_id"))).where(F.col("rc") <= most)
    quota = F.lit(0)
    for t, s in shares.items():
        quota = F.when(F.col("doc_type") == t, round(n * s)).otherwise(quota)
    h = h.withColumn("rt", F.row_number().over(Window.partitionBy("doc_type").orderBy("rc", "category"))).where(F.col("rt") <= most)
    return h.where(F.col("rt") <= quota).select("chunk_id", "doc_type", "category", F.col("rt").alias("pick"))


def expand_labels(sources: DataFrame, hits: DataFrame, verdicts: DataFrame, judge_top: int = 5) -> DataFrame:
    """query_id, found_rank, n_added, relevant (joined by a bar, the source first): the source chunk of each
    query (query_id, source), and of its first `judge_top` hits (query_id, chunk_id, rank) those with a yes
    (query_id, chunk_id). A source that isn't among the hits has rank 0 and nothing is added to it, as
    a failed search proves nothing."""
    found = sources.join(hits.select("query_id", F.col("chunk_id").alias("source"), "rank"), ["query_id", "source"], "left").select("query_id", "source", F.coalesce("rank", F.lit(0)).alias("found_rank"))
    near = hits.where(F.col("rank") <= judge_top).join(verdicts.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    more = near.join(found.where("found_rank > 0"), "query_id").where("chunk_id <> source").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("m"))  # at most `judge_top`
    j = found.join(more, "query_id", "left")
    ids = F.concat(F.array("source"), F.coalesce(F.transform("m", lambda x: x["chunk_id"]), F.array().cast("array<string>")))
    return j.select("query_id", "found_rank", F.coalesce(F.size("m"), F.lit(0)).cast("bigint").alias("n_added"), F.array_join(ids, "|").alias("relevant"))


def remap_labels(labels: DataFrame, old: DataFrame, new: DataFrame, least: float = 0.25, most: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """query_id, old_id, new_id, similarity, rank: old labelled chunks onto new chunks of the same
    document. An id that is still there with the same text stays; else the best by overlap of
    3-character sequences, from `least`, at most `most`, none under half of the best; ties by id from
    the greatest. Labels meet their document's chunks only, those of large documents block by block.
    sizes: doc_id, n, about how many new chunks a document has, where counting `new` is dear."""
    plain = lambda c, name: F.regexp_replace(c, "[^가-힣A-Za-z0-9]", "").alias(name)
    wanted = labels.select("query_id", F.col("chunk_id").alias("old_id")).distinct()
    labelled = old.join(labels.select("chunk_id").distinct(), "chunk_id", "left_semi").select("doc_id", F.col("chunk_id").alias("old_id"), plain("text", "ot"))
    sizes = new.groupBy("doc_id").agg(F.count("*").alias("n")) if sizes is None else sizes
    s = best_overlaps(labelled, new.select("doc_id", F.col("chunk_id").alias("new_id"), plain("text", "nt")), sizes, least, most)
    s = wanted.join(s, "old_id").select("query_id", "old_id", "new_id", "s")
    w = Window.partitionBy("query_id", "old_id").orderBy(F.round("s", 9).desc(), F.col("new_id").desc())
    s = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("best", F.max("s").over(Window.partitionBy("query_id", "old_id")))
    kept = s.where((F.col("best") < 2) & (F.col("s") >= F.col("best") * 0.5) | (F.col("s") == 2))
    return kept.select("query_id", "old_id", "new_id", F.round(F.least("s", F.lit(1.0)), 6).alias("similarity"), "rank")
