"""Queries that review: triage and register of documents, coverage of questions by the catalog, refusals
that should not be, changes of rules, expansion of labels, samples for review and tallies of judgements.

What a model or a person would judge is stood in for by the hash of ids; this exercises arithmetic,
not quality. Questions called hard stand for those to be refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.functions import text as T
from gyeol.operators import answer as A
from gyeol.operators import catalog as K
from gyeol.operators import gate as G
from gyeol.operators import layout as L
from gyeol.operators import quality as Q
from gyeol.operators import retrieval as R
from gyeol.plans import gate as PG
from gyeol.plans import service as PS
from gyeol.plans import text as PT
from gyeol.plans.quality import SQL as QUALITY_SQL
from gyeol.plans.quality import sample_quota
from gyeol.plans.search import _CHUNK_INDEX, _PFX, _QUESTIONS, _chunk_tokens, _sparse, chunk_hits, chunk_index
from gyeol.plans.text import CHUNKS_ONCE, LABELS, TOKENS, chunks_once
from gyeol.session import materialize
from gyeol.sources.tables import REGISTRY_COLUMNS, table

SCAN_BELOW = 100


def dq_triage(spark: SparkSession, d: str) -> DataFrame:
    """One row of facts per document; of scans, and of documents without pages, only their size."""
    b = table(spark, d, "bank_documents").where("text is not null")
    t = b.select("doc_id", "doc_type", F.col("orig_filename").alias("filename"), F.coalesce("page_count", F.lit(0)).alias("n_pages"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), T.plain_text("text").alias("text"))
    t = t.withColumn("n_chars", F.when(F.col("n_pages") > 0, F.length("text")).otherwise(0)).withColumn("chars_per_page", F.floor(F.col("n_chars") / F.greatest("n_pages", F.lit(1))))
    t = t.withColumn("is_scanned", (F.col("n_pages") > 0) & (F.col("chars_per_page") < SCAN_BELOW)).join(PT.f_title_keyword(spark, d), "doc_id", "left")
    read, x = (F.col("n_pages") > 0) & ~F.col("is_scanned"), F.col("text")
    n = lambda p: F.when(read, T.n_matches(x, p)).otherwise(0)
    no = F.concat(F.regexp_extract(x, T.TERMS_COMPLIANCE, 1), F.lit("-약관-"), F.regexp_extract(x, T.TERMS_COMPLIANCE, 2))
    return t.select(
        "doc_id", "doc_type", "filename", "n_pages", "n_chars", "chars_per_page", "is_scanned", F.lit("").alias("title_by_font"), F.when(read, F.coalesce("title_found", F.lit(""))).otherwise("").alias("title_by_keyword"),
        n(r"(?U)제\s*\d+\s*조").alias("n_articles"), n("[①-⑯]").alias("n_circled"), n(r"(?mdU)^\s*\d+\.\s").alias("n_numbered"), "n_tables",
        F.when(read, T.structure(x)).when(F.col("is_scanned"), "scanned").otherwise("").alias("structure"), F.when(read & x.rlike(T.TERMS_COMPLIANCE), no).otherwise("").alias("compliance_no"),
        F.when(read, F.date_format(T.compliance_date(x, 30, T.TERMS_COMPLIANCE), "yyyy-MM-dd")).alias("compliance_date"), F.when(F.col("n_pages") > 0, "").otherwise("no pages").alias("error"),
    )


def dq_triage_summary(spark: SparkSession, d: str) -> DataFrame:
    t = dq_triage(spark, d)
    return t.groupBy("doc_type", "structure").agg(F.count("*").alias("n"), F.sum(F.col("is_scanned").cast("int")).alias("n_scanned"), F.sum((F.col("title_by_keyword") != "").cast("int")).alias("n_titled"), F.sum("n_tables").alias("n_tables"))


def dq_date_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days from approval to effect, by type and by what they are taken for."""
    b = table(spark, d, "bank_documents").withColumn("gap", F.datediff("effective_date", "compliance_date")).where("gap is not null")
    kind = F.when(F.col("gap") < 0, "before").when(F.col("gap") > 30, "late").otherwise("usual")
    return b.groupBy("doc_type", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    """The register: all columns of documents but the text."""
    return table(spark, d, "bank_documents").select(*REGISTRY_COLUMNS)


# Catalog


PRODUCT = "([가-힣]+ [가-힣]+(?:예금|적금|대출|통장|신탁|펀드|약정|카드))"


def _analyses(spark: SparkSession, d: str) -> DataFrame:
    """The questions with what an analysis, here by pattern, says of them, as the JSON it would return."""
    r = table(spark, d, "retrieval_eval").withColumn("p", F.regexp_extract("question", PRODUCT, 1))
    raw = F.to_json(F.struct(
        F.col("p").alias("product"), F.when(F.col("p") != "", "specific_product").otherwise("none").alias("product_granularity"),
        (F.col("doc_type") == "FAQ").cast("string").alias("can_answer_with_general_terms"), (F.coalesce("difficulty", F.lit("")) != "easy").cast("string").alias("requires_product_specific_doc"), F.lit("0.8").alias("confidence"),
    ))
    return r.select("query_id", "question", "doc_type", "category", (F.coalesce("difficulty", F.lit("")) == "hard").alias("expected"), K.query_analysis(raw).alias("a"))


def catalog_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each question against the catalog: the product asked for, how it is covered, and a refusal if it isn't."""
    q = materialize(_analyses(spark, d), "analyses")
    entries = K.catalog(table(spark, d, "bank_documents")).where("bucket in ('product', 'family')")
    m = K.match_names(q.select(F.col("a.product").alias("name")).where("name is not null"), entries)
    j = q.join(m.select(F.col("name").alias("product"), "status", "doc_id", "n_candidates"), q["a.product"] == F.col("product"), "left").withColumn("status", F.coalesce("status", F.lit("none")))
    return j.select("query_id", "doc_type", "expected", "product", "status", "doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), K.coverage_refusal(F.col("a"), F.col("status")).alias("reason"))


def catalog_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each set of questions (by doc_type): statuses, refusals, and how they meet what is expected."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    refused = F.col("reason").isNotNull()
    g = catalog_questions(spark, d).groupBy("doc_type").agg(
        F.count("*").alias("n"), *[n(F.col("status") == s, f"n_{s}") for s in ("covered", "ambiguous", "unmatched", "none")], n(refused, "n_refused"), n(refused & F.col("expected"), "n_agree"), n(refused & ~F.col("expected"), "n_conflict")
    )
    return g.withColumn("share_refused", F.round(F.col("n_refused") / F.col("n"), 4))


def catalog_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Do the documents cited for a question (its first three hits) belong to the product asked for?"""
    q = _analyses(spark, d).select("query_id", F.coalesce("a.product", F.lit("")).alias("asked"))
    c = chunks_once(spark, d, "doc_display_name", "doc_type").select(F.col("chunk_id").alias("id"), T.clean_doc_name(F.coalesce("doc_display_name", F.lit(""))).alias("name"), "doc_type")
    cited = materialize(chunk_hits(spark, d, 3).join(c, "id").join(q, "query_id"), "cited")
    words = cited.select(F.explode(F.array_distinct(F.concat(T.name_tokens(F.col("asked")), T.name_tokens(F.col("name"))))).alias("token")).distinct()
    generic = PS.catalog_generic(spark, d).join(words, "token", "left_semi").agg(F.coalesce(F.collect_list("token"), F.array().cast("array<string>")).alias("generic"))  # words of the cited names only
    g = cited.groupBy("query_id", "asked").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "doc_type"))).alias("e")).crossJoin(F.broadcast(generic))  # three a question; one row
    names = F.transform("e", lambda x: x["name"])
    same = F.transform("e", lambda x: K.same_product(F.col("asked"), x["name"], F.col("generic")))
    g = g.select("query_id", "asked", names.alias("names"), same.alias("same"), K.n_distinct_products(F.transform(names, T.catalog_key)).alias("n_products"), F.forall("e", lambda x: F.coalesce(x["doc_type"] != "설명서", F.lit(True))).alias("only_terms"))
    v = K.product_verdict(F.col("asked"), F.col("same"), F.col("names"), F.col("n_products"), F.col("same"), F.col("only_terms"))
    return g.select("query_id", "n_products", F.size(F.filter("same", lambda x: x)).alias("n_same"), v.alias("verdict"))


# Refusals


RULES = {"own_attribute": G.OWN_ATTRIBUTE, "own_account": G.OWN_ACCOUNT, "first_person": G.FIRST_PERSON, "asks_personal": G.ASKS_PERSONAL, "general_rule": G.GENERAL_RULE, "time_variant": G.TIME_VARIANT, "out_of_scope": G.OUT_OF_SCOPE}


def gate_false_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Questions that can be answered but are refused: at which stage, why, which expressions of the rules
    match with what, and the best hit."""
    hits = materialize(chunk_hits(spark, d, 10), "hits")
    s = PG._signals(spark, d, hits).where("not expected").select("query_id", "question", "difficulty", "doc_type", "score_top1", "n_hits")
    best = hits.where("rank = 1").select("query_id", F.col("id").alias("top1_id"))
    fired = F.array_compact(F.array(*[F.when(F.col("question").rlike(p), F.concat(F.lit(f"{n}="), F.regexp_extract("question", p, 0))) for n, p in RULES.items()]))
    j = s.join(PG.gate_decisions(spark, d, hits).where("decision = 'refuse'"), "query_id").join(best, "query_id", "left")
    return j.select("query_id", "difficulty", "doc_type", "stage", "reason", F.array_join(fired, "|").alias("fired"), "n_hits", F.round("score_top1", 4).alias("top1"), "top1_id")


def gate_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """What refusing all questions for values would change, by difficulty: refusals before and after, lost and won."""
    q = F.col("question")
    was, now = G.question_rule(q).isNotNull(), G.question_rule(q).isNotNull() & ~q.rlike(G.GENERAL_RULE) | q.rlike(G.VALUE_QUESTION)
    r = table(spark, d, "retrieval_eval").select("difficulty", was.alias("was"), now.alias("now"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    w, o = F.col("was"), F.col("now")
    return r.groupBy("difficulty").agg(F.count("*").alias("n"), n(w, "n_was"), n(o, "n_now"), n(w & ~o, "n_lost"), n(~w & o, "n_won"))


def gate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence a verdict is asked on."""
    e = A.gate_evidence(chunk_hits(spark, d, 3), chunks_once(spark, d, "doc_display_name", "section", "text"))
    return e.select("query_id", F.md5("block").alias("block_md5"))


# Labels and samples


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def label_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The source of each question with those of its first five hits that a cached verdict says yes to; where
    the source isn't among the first twenty hits, the source alone."""
    r = table(spark, d, "retrieval_eval").select("query_id", F.element_at(F.split("relevant_chunk_ids", r"\|"), 1).alias("source"))
    hits = chunk_hits(spark, d, 20).select("query_id", F.col("id").alias("chunk_id"), "rank")
    verdicts = hits.select("query_id", "chunk_id").where(_hash("query_id", "chunk_id") < "8")
    return Q.expand_labels(r, hits, verdicts)


def sample_control(spark: SparkSession, d: str) -> DataFrame:
    """Twenty questions that can be answered, by the hash of their id: the sample is the feature."""
    r = table(spark, d, "retrieval_eval").where("coalesce(difficulty, '') <> 'hard'").withColumn("h", F.md5(F.concat(F.lit("7"), "query_id")))
    return r.orderBy("h", "query_id").limit(20).select("query_id", "difficulty", "doc_type")


def sample_refusal(spark: SparkSession, d: str) -> DataFrame:
    """Twelve refused questions, one of each reason in turn."""
    g = PG.gate_decisions(spark, d).where("decision = 'refuse'").withColumn("h", F.md5(F.concat(F.lit("42"), "query_id")))
    g = g.withColumn("turn", F.row_number().over(Window.partitionBy("reason").orderBy("h", "query_id"))).where("turn <= 12")
    return g.orderBy("turn", "reason").limit(12).select("query_id", "reason", "turn")


def sample_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Ten questions at the edge of the catalog."""
    c = catalog_questions(spark, d).where("status in ('ambiguous', 'unmatched')").withColumn("h", F.md5(F.concat(F.lit("42"), "query_id")))
    return c.orderBy("h", "query_id").limit(10).select("query_id", "product", "status")


LEVELS = {"easy": 0.3, "medium": 0.45, "hard": 0.25}
ALLOWED = {"FAQ": ("easy", "medium"), "설명서": ("easy", "medium", "hard"), "약관": ("medium", "hard")}


def sample_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Levels for the chunks of sample_quota, each that which lacks most so far."""
    s = sample_quota(spark, d).agg(F.array_sort(F.collect_list(F.struct("pick", "doc_type", "chunk_id"))).alias("s"))  # the rows of a sample
    s = s.withColumn("levels", L.assign_by_deficit(F.transform("s", lambda x: x["doc_type"]), ALLOWED, LEVELS))
    return s.select(F.explode(F.arrays_zip("s", "levels")).alias("z")).select("z.s.chunk_id", "z.s.doc_type", F.col("z.levels").alias("level"))


# Tallies


CRITERIA = ("grounded", "same_product", "numbers", "unknown_told", "usable")


def _verdict(*parts: Column | str) -> Column:
    h = _hash(*parts)
    return F.when(h < "8", "pass").when(h < "c", "fail").when(h < "e", "na").otherwise("?")


def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Passed, failed and unjudged answers by difficulty and criterion."""
    r = table(spark, d, "retrieval_eval").select(F.coalesce("difficulty", F.lit("none")).alias("difficulty"), *[_verdict("query_id", F.lit(c)).alias(c) for c in CRITERIA])
    return A.criterion_rates(r, list(CRITERIA), "difficulty")


def agreement_raters(spark: SparkSession, d: str) -> DataFrame:
    """Two raters by criterion, drafted apart from blind: agreement, kappa, failures the second missed or added."""
    r = table(spark, d, "retrieval_eval")
    x = r.select((F.md5("query_id") < "8").alias("blind"), F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), _verdict("query_id", F.lit(c)).alias("a"), _verdict(F.lit("2"), "query_id", F.lit(c)).alias("b")) for c in CRITERIA])).alias("x")).select("blind", "x.*")
    k = G.kappa(x, "a", "b", ["criterion", "blind"])
    fail = lambda c: F.col(c) == "fail"
    n = x.groupBy("criterion", "blind").agg(F.count(F.when(fail("a") & ~fail("b"), 1)).alias("n_missed"), F.count(F.when(~fail("a") & fail("b"), 1)).alias("n_over"), F.round(F.avg(fail("a").cast("double")), 6).alias("fail_rate"))
    return k.join(n, ["criterion", "blind"])


def mismatch_rates(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a wrong product as reviewed, by the reason they were found for."""
    r = table(spark, d, "retrieval_eval").withColumn("h", _hash("query_id", F.lit("m"))).where("h < '9'")
    return L.mismatch_tally(r.select("doc_type", (F.col("h") < "4").alias("is_real")), "doc_type")


# Indexes


def vocabulary_first(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies within the first 400 chunks by id: the sample is the feature."""
    first = chunks_once(spark, d, "doc_display_name", "section", "text").orderBy("chunk_id").limit(400)
    return first.select(F.explode(F.array_distinct(_chunk_tokens())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def self_check_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Does the first chunk, asked with its own text, find itself first?"""
    c = chunks_once(spark, d, "doc_display_name", "section", "text")
    first = c.orderBy("chunk_id").limit(1)
    hits = R.bm25_search(chunk_index(spark, d), R.query_terms(first, "chunk_id", _chunk_tokens()), 10)
    return first.select(F.col("chunk_id").alias("query_id")).join(hits.where("query_id = id").select("query_id", "rank"), "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).alias("found_rank"))


QUERIES = {
    "dq_triage": dq_triage, "dq_triage_summary": dq_triage_summary, "dq_date_gaps": dq_date_gaps, "registry": registry, "catalog_questions": catalog_questions, "catalog_coverage": catalog_coverage, "catalog_verdicts": catalog_verdicts,
    "gate_false_refusals": gate_false_refusals, "gate_rule_counts": gate_rule_counts, "gate_evidence": gate_evidence, "label_expansion": label_expansion, "sample_control": sample_control, "sample_refusal": sample_refusal,
    "sample_boundary": sample_boundary, "sample_difficulty": sample_difficulty, "answer_rates": answer_rates, "agreement_raters": agreement_raters, "mismatch_rates": mismatch_rates, "vocabulary_first": vocabulary_first, "self_check_sparse": self_check_sparse,
}

_FIND = rf"""p AS (SELECT doc_id, doc_type, orig_filename AS filename, coalesce(page_count, 0) AS n_pages, coalesce(n_tables, 0) AS n_tables, trim(regexp_replace(replace(replace(nfc_normalize(text), chr(12288), ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9)) AS text FROM bank_documents WHERE text IS NOT NULL),
    s AS (SELECT *, CASE WHEN n_pages > 0 THEN length(text) ELSE 0 END AS n_chars FROM p), u AS (SELECT *, n_chars // greatest(n_pages, 1) AS cpp FROM s), v AS (SELECT *, n_pages > 0 AND cpp < 100 AS scan, n_pages > 0 AND cpp >= 100 AS rd FROM u),
    kw AS ({PT.SQL['f_title_keyword']}),
    n AS (SELECT v.*, coalesce(title_found, '') AS kt, len(regexp_extract_all(text, '제[\s\p{{Z}}]*\p{{Nd}}+[\s\p{{Z}}]*조')) AS a, len(regexp_extract_all(text, '[①-⑯]')) AS c, len(regexp_extract_all(text, '(?m)^[\s\p{{Z}}]*\p{{Nd}}+\.[\s\p{{Z}}]')) AS m,
      regexp_extract(text, '(\d{{4}})[\s\p{{Z}}]*-[\s\p{{Z}}]*약관[\s\p{{Z}}]*-[\s\p{{Z}}]*(\d+)[\s\p{{Z}}]*호', 0) AS hit FROM v LEFT JOIN kw USING (doc_id)),
    tr AS (SELECT doc_id, doc_type, filename, n_pages::INT AS n_pages, n_chars::INT AS n_chars, cpp::BIGINT AS chars_per_page, scan AS is_scanned, '' AS title_by_font, CASE WHEN rd THEN kt ELSE '' END AS title_by_keyword, CASE WHEN rd THEN a ELSE 0 END::INT AS n_articles, CASE WHEN rd THEN c ELSE 0 END::INT AS n_circled,
      CASE WHEN rd THEN m ELSE 0 END::INT AS n_numbered, n_tables::INT AS n_tables, CASE WHEN scan THEN 'scanned' WHEN NOT rd THEN '' WHEN a >= 5 THEN 'article' WHEN c >= 10 THEN 'clause' WHEN m >= 5 THEN 'numbered' ELSE 'flat' END AS structure,
      CASE WHEN rd AND hit <> '' THEN regexp_extract(hit, '^(\d{{4}})', 1) || '-약관-' || regexp_extract(hit, '(\d+)[\s\p{{Z}}]*호$', 1) ELSE '' END AS compliance_no,
      CASE WHEN rd AND hit <> '' THEN strftime(try_strptime(nullif(regexp_extract(substr(text, (instr(text, hit) + length(hit))::BIGINT, 30), '\((\d{{4}}[.\-]\d{{1,2}}[.\-]\d{{1,2}})\)', 1), '').replace('.', '-'), '%Y-%m-%d'), '%Y-%m-%d') END AS compliance_date,
      CASE WHEN n_pages > 0 THEN '' ELSE 'no pages' END AS error FROM n)"""
_ASKED = "aq AS (SELECT *, nullif(regexp_extract(question, '([가-힣]+ [가-힣]+(?:예금|적금|대출|통장|신탁|펀드|약정|카드))', 1), '') AS product, coalesce(difficulty = 'hard', false) AS expected FROM retrieval_eval)"
_QKEY = PS._KEY
_COVER = f"""{_ASKED}, en AS (SELECT key AS k, min(doc_id) AS doc_id FROM ({PS.SQL['catalog_entries']}) WHERE bucket IN ('product', 'family') AND key <> '' GROUP BY 1),
    qn AS (SELECT DISTINCT product AS name, {_QKEY.format('product')} AS k FROM aq WHERE product IS NOT NULL),
    nr AS (SELECT qn.name, min(en.doc_id) AS near_id, count(*) AS n FROM qn JOIN en ON length(qn.k) >= 4 AND length(en.k) >= 4 AND (contains(en.k, qn.k) OR contains(qn.k, en.k)) GROUP BY 1),
    st AS (SELECT qn.name, CASE WHEN en.doc_id IS NOT NULL THEN 'covered' WHEN near_id IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS status, coalesce(en.doc_id, near_id) AS doc_id, coalesce(n, 0) AS n_candidates FROM qn LEFT JOIN en ON qn.k = en.k LEFT JOIN nr ON qn.name = nr.name),
    cv AS (SELECT query_id, doc_type, expected, product, coalesce(status, 'none') AS status, doc_id, coalesce(n_candidates, 0) AS n_candidates,
      CASE WHEN product IS NULL OR doc_type = 'FAQ' OR coalesce(difficulty, '') = 'easy' OR status = 'covered' THEN NULL WHEN status = 'ambiguous' THEN 'ambiguous_product' WHEN status = 'unmatched' THEN 'product_mismatch' END AS reason FROM aq LEFT JOIN st ON product = name)"""
_TOK = lambda c: f"list_filter(regexp_extract_all(lower({PT._CLEAN.replace('trim(n)', f'trim({c})')}), '[0-9a-z가-힣]+'), lambda x: length(x) >= 2)"
_REL = lambda a, b: f"(starts_with({a}, {b}) OR starts_with({b}, {a}))"
_V = lambda h: f"CASE WHEN {h} < '8' THEN 'pass' WHEN {h} < 'c' THEN 'fail' WHEN {h} < 'e' THEN 'na' ELSE '?' END"
_CRIT = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in CRITERIA) + "]) AS criterion)"

SQL = {
    "dq_triage": f"WITH {_FIND} SELECT * FROM tr",
    "dq_triage_summary": f"WITH {_FIND} SELECT doc_type, structure, count(*) AS n, count(*) FILTER (is_scanned) AS n_scanned, count(*) FILTER (title_by_keyword <> '') AS n_titled, sum(n_tables)::BIGINT AS n_tables FROM tr GROUP BY 1, 2",
    "dq_date_gaps": "WITH g AS (SELECT doc_type, date_diff('day', compliance_date, effective_date)::INT AS gap FROM bank_documents) SELECT doc_type, CASE WHEN gap < 0 THEN 'before' WHEN gap > 30 THEN 'late' ELSE 'usual' END AS kind, count(*) AS n, min(gap) AS least, max(gap) AS most FROM g WHERE gap IS NOT NULL GROUP BY 1, 2",
    "registry": "SELECT doc_id, bank_code, doc_type, category, title, subtitle, display_name, structure, effective_date, compliance_no, compliance_date, is_parsable, exclusion_reason, title_confidence, page_count, char_count, n_tables, content_hash, is_latest, superseded_by, source_url, source_path, orig_filename, parsed_at FROM bank_documents",
    "catalog_questions": f"WITH {_COVER} SELECT * FROM cv",
    "catalog_coverage": f"WITH {_COVER} SELECT doc_type, count(*) AS n, count(*) FILTER (status = 'covered') AS n_covered, count(*) FILTER (status = 'ambiguous') AS n_ambiguous, count(*) FILTER (status = 'unmatched') AS n_unmatched, count(*) FILTER (status = 'none') AS n_none, count(reason) AS n_refused, count(reason) FILTER (expected) AS n_agree, count(reason) FILTER (NOT expected) AS n_conflict, round(count(reason) / count(*)::DOUBLE, 4) AS share_refused FROM cv GROUP BY 1",
    "catalog_verdicts": f"""WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 3)}, {_ASKED}, gn AS ({PS.SQL['catalog_generic']}), gl AS (SELECT coalesce(list(token), []) AS gl FROM gn),
        ci AS (SELECT sp.query_id, rank, coalesce(product, '') AS asked, {PT._CLEAN.replace("trim(n)", "trim(coalesce(doc_display_name, ''))")} AS name, c.doc_type FROM sp JOIN c ON sp.id = c.chunk_id JOIN aq ON sp.query_id = aq.query_id),
        tk AS (SELECT *, list_filter({_TOK('asked')}, lambda x: NOT list_contains(gl, x)) AS ta, list_filter({_TOK('name')}, lambda x: NOT list_contains(gl, x)) AS tb, {_QKEY.format('asked')} AS ka, {_QKEY.format('name')} AS kb FROM ci, gl),
        sm AS (SELECT *, len(ta) > 0 AND len(tb) > 0 AND ((ka <> '' AND kb <> '' AND (contains(kb, ka) OR contains(ka, kb))) OR len(list_filter(ta, lambda s: len(list_filter(tb, lambda t: {_REL('s', 't')})) > 0)) > 0) AS same FROM tk),
        ag AS (SELECT query_id, any_value(asked) AS asked, count(*) AS n, count(*) FILTER (same) AS n_same, bool_and(coalesce(doc_type <> '설명서', true)) AS only_terms, coalesce(any_value(kb) FILTER (rank = 1), '') AS k1, coalesce(any_value(kb) FILTER (rank = 2), '') AS k2, coalesce(any_value(kb) FILTER (rank = 3), '') AS k3 FROM sm GROUP BY 1),
        c1 AS (SELECT *, k1 <> '' AS u1 FROM ag), c2 AS (SELECT *, k2 <> '' AND NOT (u1 AND {_REL('k1', 'k2')}) AS u2 FROM c1), c3 AS (SELECT *, k3 <> '' AND NOT (u1 AND {_REL('k1', 'k3')}) AND NOT (u2 AND {_REL('k2', 'k3')}) AS u3 FROM c2),
        np AS (SELECT *, u1::INT + u2::INT + u3::INT AS n_products FROM c3)
        SELECT query_id, n_products, n_same::INT AS n_same, CASE WHEN n = 0 THEN 'na' WHEN asked = '' THEN CASE WHEN n_products >= 2 THEN 'fail' ELSE 'na' END WHEN n_same = n THEN 'pass' WHEN n_same > 0 THEN 'fail' WHEN only_terms THEN 'na' ELSE 'fail' END AS verdict FROM np""",
    "gate_false_refusals": f"""{PG._JUDGED}, dc AS ({PG._DECIDED}) SELECT dc.query_id, difficulty, r.doc_type, stage, reason, concat_ws('|', {', '.join(f"CASE WHEN regexp_matches(question, '{p}') THEN '{n}=' || regexp_extract(question, '{p}', 0) END" for n, p in RULES.items())}) AS fired, n_hits, round(score_top1, 4) AS top1, sp.id AS top1_id
        FROM dc JOIN sg USING (query_id) JOIN (SELECT query_id, doc_type FROM retrieval_eval) r USING (query_id) LEFT JOIN sp ON sp.query_id = dc.query_id AND sp.rank = 1 WHERE decision = 'refuse' AND NOT expected""",
    "gate_rule_counts": f"WITH x AS (SELECT difficulty, ({PG._R0}) IS NOT NULL AS was, ({PG._R0}) IS NOT NULL AND NOT regexp_matches(question, '{G.GENERAL_RULE}') OR regexp_matches(question, '{G.VALUE_QUESTION}') AS now FROM retrieval_eval) SELECT difficulty, count(*) AS n, count(*) FILTER (was) AS n_was, count(*) FILTER (now) AS n_now, count(*) FILTER (was AND NOT now) AS n_lost, count(*) FILTER (NOT was AND now) AS n_won FROM x GROUP BY 1",
    "gate_evidence": f"WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 3)} SELECT query_id, md5(string_agg('[' || rank || '] ' || concat_ws(' ', nullif(doc_display_name, ''), nullif(section, '')) || chr(10) || substr(coalesce(text, ''), 1, 700), chr(10) || chr(10) ORDER BY rank)) AS block_md5 FROM sp JOIN c ON sp.id = c.chunk_id GROUP BY 1",
    "label_expansion": f"""WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 20)}, sr AS (SELECT query_id, string_split(relevant_chunk_ids, '|')[1] AS source FROM retrieval_eval), fr AS (SELECT sr.*, coalesce(rank, 0) AS found FROM sr LEFT JOIN sp ON sr.query_id = sp.query_id AND sr.source = sp.id),
        yes AS (SELECT fr.query_id, string_agg(sp.id, '|' ORDER BY rank) AS more, count(*) AS n FROM fr JOIN sp ON fr.query_id = sp.query_id WHERE found > 0 AND rank <= 5 AND sp.id <> source AND md5(sp.query_id || '|' || sp.id) < '8' GROUP BY 1)
        SELECT query_id, found::INT AS found_rank, coalesce(n, 0) AS n_added, concat_ws('|', source, more) AS relevant FROM fr LEFT JOIN yes USING (query_id)""",
    "sample_control": "SELECT query_id, difficulty, doc_type FROM retrieval_eval WHERE coalesce(difficulty, '') <> 'hard' ORDER BY md5('7' || query_id), query_id LIMIT 20",
    "sample_refusal": f"{PG._JUDGED}, dc AS ({PG._DECIDED}), tn AS (SELECT query_id, reason, row_number() OVER (PARTITION BY reason ORDER BY md5('42' || query_id), query_id)::INT AS turn FROM dc WHERE decision = 'refuse') SELECT * FROM tn ORDER BY turn, reason LIMIT 12",
    "sample_boundary": f"WITH {_COVER} SELECT query_id, product, status FROM cv WHERE status IN ('ambiguous', 'unmatched') ORDER BY md5('42' || query_id), query_id LIMIT 10",
    "sample_difficulty": f"""WITH RECURSIVE sq AS ({QUALITY_SQL['sample_quota']}), o AS (SELECT *, row_number() OVER (ORDER BY pick, doc_type, chunk_id) AS i, count(*) OVER () AS total FROM sq),
        f(i, e, m, h, level) AS (SELECT 0::BIGINT, 0, 0, 0, '' UNION ALL SELECT i, e + (level = 'easy')::INT, m + (level = 'medium')::INT, h + (level = 'hard')::INT, level FROM (SELECT o.i, e, m, h, CASE
          WHEN doc_type = 'FAQ' THEN CASE WHEN e - 0.3::DOUBLE * total <= m - 0.45::DOUBLE * total THEN 'easy' ELSE 'medium' END
          WHEN doc_type = '설명서' THEN CASE WHEN e - 0.3::DOUBLE * total <= least(m - 0.45::DOUBLE * total, h - 0.25::DOUBLE * total) THEN 'easy' WHEN m - 0.45::DOUBLE * total <= h - 0.25::DOUBLE * total THEN 'medium' ELSE 'hard' END
          ELSE CASE WHEN m - 0.45::DOUBLE * total <= h - 0.25::DOUBLE * total THEN 'medium' ELSE 'hard' END END AS level FROM f JOIN o ON o.i = f.i + 1))
        SELECT chunk_id, doc_type, level FROM o JOIN f USING (i)""",
    "answer_rates": f"WITH v AS (SELECT coalesce(difficulty, 'none') AS difficulty, criterion, {_V('''md5(query_id || '|' || criterion)''')} AS v FROM retrieval_eval, {_CRIT}), n AS (SELECT difficulty, criterion, count(*) FILTER (v = 'pass') AS n_pass, count(*) FILTER (v = 'fail') AS n_fail, count(*) FILTER (v NOT IN ('pass', 'fail')) AS n_na FROM v GROUP BY 1, 2) SELECT *, round(CASE WHEN n_pass + n_fail > 0 THEN n_pass / (n_pass + n_fail)::DOUBLE ELSE 0 END, 4) AS pass_rate FROM n",
    "agreement_raters": f"""WITH v AS (SELECT md5(query_id) < '8' AS blind, criterion, {_V('''md5(query_id || '|' || criterion)''')} AS a, {_V('''md5('2|' || query_id || '|' || criterion)''')} AS b FROM retrieval_eval, {_CRIT}),
        t AS (SELECT criterion, blind, count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS po, count(*) FILTER (a = 'fail' AND b <> 'fail') AS n_missed, count(*) FILTER (a <> 'fail' AND b = 'fail') AS n_over, avg((a = 'fail')::INT) AS fail_rate FROM v GROUP BY 1, 2),
        p AS (SELECT criterion, blind, sum(x * y) AS s FROM (SELECT criterion, blind, a AS l, count(*)::DOUBLE AS x FROM v GROUP BY 1, 2, 3) JOIN (SELECT criterion, blind, b AS l, count(*)::DOUBLE AS y FROM v GROUP BY 1, 2, 3) USING (criterion, blind, l) GROUP BY 1, 2),
        k AS (SELECT *, coalesce(s, 0) / (n * n)::DOUBLE AS pe FROM t LEFT JOIN p USING (criterion, blind))
        SELECT criterion, blind, n, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, n_missed, n_over, round(fail_rate, 6) AS fail_rate FROM k""",
    "mismatch_rates": "WITH m AS (SELECT doc_type, md5(query_id || '|m') AS h FROM retrieval_eval) SELECT doc_type, count(*) AS n, count(*) FILTER (h < '4') AS n_real, round(avg((h < '4')::INT), 4) AS precision FROM m WHERE h < '9' GROUP BY 1",
    "vocabulary_first": f"""WITH {CHUNKS_ONCE}, f AS (SELECT * FROM c ORDER BY chunk_id LIMIT 400) SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format("CASE WHEN " + _PFX + " <> '' THEN " + _PFX + " || chr(10) || coalesce(text, '') ELSE text END")})) AS term FROM f) GROUP BY 1""",
    "self_check_sparse": f"WITH {_CHUNK_INDEX}, fi AS (SELECT chunk_id AS query_id, itext FROM cx ORDER BY chunk_id LIMIT 1), {_sparse('SELECT query_id, ' + TOKENS.format('itext') + ' AS t FROM fi', 10)} SELECT fi.query_id, coalesce(rank, 0)::INT AS found_rank FROM fi LEFT JOIN sp ON sp.query_id = fi.query_id AND sp.id = fi.query_id",
}
