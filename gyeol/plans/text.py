"""Queries of the column functions over documents, chunks, FAQ rows and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import text as T
from gyeol.sources.tables import table

#: White space as the JVM and DuckDB can both say it.
SP = r"[\s\p{Z}\x0b\x{85}]"
COMMON = ", ".join(f"'{w}'" for w in T.COMMON_TERMS)
TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-z가-힣]+'), lambda x: length(x) >= 2)"


def chunks_once(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per chunk_id, the one loaded last, with the columns named: no other is read."""
    c = table(spark, d, "chunks").where(F.col("chunk_id").isNotNull())
    twice = c.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")  # ids alone are shuffled
    last = c.join(twice, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max(F.struct("loaded_at", *cols)).alias("r"))
    once = c.join(twice, "chunk_id", "left_anti").select("chunk_id", *cols)
    return once.unionByName(last.select("chunk_id", *[F.col(f"r.{x}").alias(x) for x in cols]))


CHUNKS_ONCE = "c AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"


def f_normalize(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bank_documents").select("doc_id", T.normalize_text("text").alias("t"))
    return b.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def f_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bank_documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def f_filename(spark: SparkSession, d: str) -> DataFrame:
    b, f = table(spark, d, "bank_documents"), F.col("orig_filename")
    return b.select("doc_id", T.filename_date(f).alias("file_date"), T.filename_type(f).alias("kind"), T.filename_category(f).alias("file_category"), T.filename_hint(f).alias("hint"))


def f_citation(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bank_documents").withColumn("name", T.display_name(F.col("title"), F.col("subtitle"), F.col("orig_filename")))
    return b.select("doc_id", "name", T.document_citation(F.col("name"), F.col("doc_type"), F.col("effective_date")).alias("citation"), T.clean_doc_name(F.col("name")).alias("clean_name"))


def f_chunk_text(spark: SparkSession, d: str) -> DataFrame:
    c, col = chunks_once(spark, d, "doc_display_name", "section", "doc_type", "effective_date", "text"), F.col
    cite = T.chunk_citation(col("doc_display_name"), col("section"), col("doc_type"), col("effective_date"))
    index = T.indexable_text(col("doc_display_name"), col("section"), col("text"))
    counted = T.indexable_text(col("doc_display_name"), col("section"), col("text"), keep_faq=True)
    return c.select("chunk_id", cite.alias("citation"), F.md5(index).alias("indexed_md5"), F.length(counted).alias("counted_chars"), T.chunk_to_doc(col("chunk_id")).alias("from_id"), T.citation_key(cite).alias("doc_key"))


def f_structure(spark: SparkSession, d: str) -> DataFrame:
    b, t = table(spark, d, "bank_documents").where("text is not null"), F.col("text")
    return b.select(
        "doc_id", T.n_matches(t, r"(?U)제\s*\d+\s*조").alias("n_articles"), T.n_matches(t, "[①-⑯]").alias("n_circled"), T.n_matches(t, r"(?mdU)^\s*\d+\.\s").alias("n_numbered"),
        T.structure(t).alias("detected"), T.is_scan(F.length(t), F.col("page_count")).alias("is_scan"),
    )


def f_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of approvals as printed: the text, and behind it the number and date of the register."""
    b, t = table(spark, d, "bank_documents"), F.concat_ws(" ", "text", F.concat(F.lit("심의필 제"), "compliance_no", F.lit(" ("), F.date_format("compliance_date", "yyyy.M.d"), F.lit(")")))
    return b.select("doc_id", T.compliance_no(t).alias("found_no"), T.compliance_date(t).alias("found_date")).where("found_no is not null")


def f_title_keyword(spark: SparkSession, d: str) -> DataFrame:
    """The first of the first 25 lines, at most 60 characters, that names a kind of document."""
    lines = table(spark, d, "bank_documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 25)).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "[ \t\xa0　]+", " ")))
    hit = lines.where((F.length("line") > 0) & (F.length("line") <= 60) & F.col("line").rlike("|".join(T.KIND_WORDS)))
    return hit.groupBy("doc_id").agg(F.min_by("line", "pos").alias("title_found"))


def f_question_terms(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieval_eval")
    return r.select("query_id", F.array_join(T.terms(F.col("question")), " ").alias("terms"), F.array_join(T.word_tokens(F.col("question")), " ").alias("tokens"))


def labels_long(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieval_eval")
    return r.select("query_id", "question", "difficulty", "doc_type", F.explode(F.split("relevant_chunk_ids", r"\|")).alias("chunk_id")).where("chunk_id <> ''")


def f_lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Best share of a question's terms in one of its labelled chunks, with both measures of copying."""
    pairs = labels_long(spark, d).join(chunks_once(spark, d, "text").select("chunk_id", "text"), "chunk_id").where("text is not null")
    q, t = F.col("question"), F.col("text")
    pairs = pairs.select("query_id", "chunk_id", T.lexical_overlap(T.terms(q), t).alias("lexical"), T.stem_overlap(q, t).alias("stems"))
    best = pairs.groupBy("query_id").agg(F.max("lexical").alias("lexical"), F.max("stems").alias("stems"))
    bucket = F.when(F.col("lexical") >= 0.5, "high").when(F.col("lexical") >= 0.25, "middle").otherwise("low")
    return best.select("query_id", F.round("lexical", 6).alias("lexical"), F.round("stems", 6).alias("stems"), bucket.alias("bucket"))


def f_hard_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms by which a question gives its document or chunk away."""
    pairs = labels_long(spark, d).join(chunks_once(spark, d, "text", "doc_display_name").select("chunk_id", "text", "doc_display_name"), "chunk_id")
    name = T.first_shared_term(F.col("doc_display_name"), F.col("question"), "[가-힣A-Za-z]{3,}", False, 3)
    text = T.first_shared_term(F.col("question"), F.col("text"), "[가-힣]{4,}", True, 4)
    return pairs.select("query_id", "chunk_id", name.alias("name_term"), text.alias("text_term"))


def f_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Damage to spacing by document type."""
    c = chunks_once(spark, d, "doc_type", "text").where("text is not null").withColumn("r", T.space_ratio(F.col("text"))).withColumn("run", T.longest_hangul_run(F.col("text")))
    return c.groupBy("doc_type").agg(
        F.count("*").alias("n_chunks"), F.sum((F.col("r") < 0.10).cast("int")).alias("n_damaged"), F.round(F.avg("r"), 6).alias("avg_ratio"), F.max("run").alias("longest_run"),
        F.sum(T.has_blank(F.col("text")).cast("int")).alias("n_blank"),
    )


def f_gram_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sequence sets of titles and their overlap with the subtitle."""
    b = table(spark, d, "bank_documents")
    g, h = T.gram_set(F.col("title")), T.gram_set(F.col("subtitle"))
    return b.select("doc_id", F.size(g).alias("n_title"), F.size(h).alias("n_subtitle"), F.round(T.overlap(g, h), 6).alias("overlap"))


def f_faq_clean(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faq_records")
    return f.select("faq_id", T.faq_label_free(F.col("question")).alias("question_clean"), F.length(T.faq_label_free(F.col("answer"))).alias("answer_chars")).distinct()


def f_sentences(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faq_records").select("faq_id", "answer").distinct()
    return f.select("faq_id", F.posexplode(T.sentences(F.col("answer"))).alias("pos", "sentence"))


def f_cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of model calls, and those that a cache of the easy questions misses."""
    r = table(spark, d, "retrieval_eval").withColumn("key", T.cache_key(F.lit("model"), F.lit("prompt"), F.col("question")))
    have = r.where("difficulty = 'easy'").select("key").distinct()
    return r.join(have, "key", "left_anti").select("query_id", "key")


QUERIES = {
    "f_normalize": f_normalize, "f_content_hash": f_content_hash, "f_filename": f_filename, "f_citation": f_citation, "f_chunk_text": f_chunk_text,
    "f_structure": f_structure, "f_compliance": f_compliance, "f_title_keyword": f_title_keyword, "f_question_terms": f_question_terms,
    "f_lexical_overlap": f_lexical_overlap, "f_hard_terms": f_hard_terms, "f_spacing": f_spacing, "f_gram_sets": f_gram_sets, "f_faq_clean": f_faq_clean,
    "f_sentences": f_sentences, "f_cache_key": f_cache_key,
}

_NAME = "CASE WHEN nullif(subtitle, '') IS NOT NULL AND subtitle IS DISTINCT FROM nullif(title, '') THEN coalesce(title, '') || ' - ' || subtitle ELSE coalesce(nullif(title, ''), orig_filename) END"
_CLEAN = "CASE WHEN instr(trim(n), ' - ') = 0 OR (length(trim(substr(trim(n), instr(trim(n), ' - ') + 3))) <= 24 AND instr(trim(substr(trim(n), instr(trim(n), ' - ') + 3)), ':') = 0) THEN trim(n) ELSE trim(substr(trim(n), 1, instr(trim(n), ' - ') - 1)) END"
_CITE = "concat_ws(' ', nullif(doc_display_name, ''), CASE WHEN nullif(section, '') <> 'FAQ' THEN section END, CASE WHEN nullif(effective_date, '') IS NOT NULL THEN '(' || effective_date || CASE WHEN doc_type = 'FAQ' THEN ' 수집)' ELSE ' 시행)' END END)"
_PREFIX = "concat_ws(' ', nullif(doc_display_name, ''), CASE WHEN nullif(section, '') <> 'FAQ' THEN section END)"
_PREFIX_ALL = "concat_ws(' ', nullif(doc_display_name, ''), nullif(section, ''))"
_TERMS = f"list_filter(list_transform(regexp_extract_all(coalesce(question, ''), '[가-힣A-Za-z]{{2,}}'), lambda w: regexp_replace(w, '({T.PARTICLES})$', '')), lambda w: length(w) >= 2 AND w NOT IN ('하나은행', '하나', '은행', '경우', '어떻게', '무엇', '어떤', '언제', '얼마', '있나요', '하나요', '되나요', '인가요', '합니까', '됩니까', '가능', '필요', '제가', '저는', '내가', '우리', '그거', '이거', '때문', '위해', '대해'))"
_STEMS = f"list_filter(regexp_extract_all(question, '[가-힣]{{3,}}'), lambda w: w NOT IN ({COMMON}) AND substr(w, 1, 2) NOT IN ({COMMON}))"
LABELS = "labels AS (SELECT query_id, question, difficulty, doc_type, unnest(string_split(relevant_chunk_ids, '|')) AS chunk_id FROM retrieval_eval)"
_GRAMS = "CASE WHEN {0} = '' THEN [] WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"
_COMP = r"제?[\s\p{Z}]*(\d{4})[\s\p{Z}]*-[\s\p{Z}]*(약관|상품|설명서)[\s\p{Z}]*-[\s\p{Z}]*(\d+)[\s\p{Z}]*호"
_FAQ = lambda c: rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce({c}, ''), '{SP}+', ' ', 'g')), '^(Q\.|A\.|질문|답변)\s*', ''), '^(Q\.|A\.|질문|답변)\s*', ''))"

SQL = {
    "f_normalize": rf"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(12288), ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), ' *\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS t FROM bank_documents)
        SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM n""",
    "f_content_hash": f"SELECT doc_id, sha256(regexp_replace(text, '{SP}+', '', 'g')) AS hash FROM bank_documents",
    "f_filename": r"""SELECT doc_id, CAST(try_strptime(nullif(regexp_extract(orig_filename, '(?i)_(\d{8})\.pdf$', 1), ''), '%Y%m%d') AS DATE) AS file_date,
        CASE WHEN contains(orig_filename, '_terms_') THEN '약관' ELSE '설명서' END AS kind,
        CASE """ + " ".join(f"WHEN contains(orig_filename, '_{c}_') THEN '{c}'" for c in T.CATEGORIES) + r""" ELSE 'unknown' END AS file_category,
        array_to_string(list_slice(string_split(regexp_replace(orig_filename, '(?i)\.pdf$', ''), '_'), 4, len(string_split(orig_filename, '_')) - 1), ' ') AS hint FROM bank_documents""",
    "f_citation": f"""WITH n AS (SELECT *, {_NAME} AS n FROM bank_documents) SELECT doc_id, n AS name,
        concat_ws(' ', n, CASE WHEN effective_date IS NOT NULL THEN '(' || strftime(effective_date, '%Y-%m-%d') || CASE WHEN doc_type = 'FAQ' THEN ' 수집)' ELSE ' 시행)' END END) AS citation, {_CLEAN} AS clean_name FROM n""",
    "f_chunk_text": rf"""WITH {CHUNKS_ONCE}, x AS (SELECT *, {_CITE} AS cite, {_PREFIX} AS p, {_PREFIX_ALL} AS pa FROM c)
        SELECT chunk_id, cite AS citation, md5(CASE WHEN p <> '' THEN p || chr(10) || coalesce(text, '') ELSE text END) AS indexed_md5,
        length(CASE WHEN pa <> '' THEN pa || chr(10) || coalesce(text, '') ELSE text END)::INT AS counted_chars,
        regexp_replace(chunk_id, '_c[^_]*$', '') AS from_id, trim(regexp_extract(cite, '^(.*?)\s*(?:제\d+조|제\d+항|\(|$)', 1)) AS doc_key FROM x""",
    "f_structure": r"""WITH n AS (SELECT doc_id, page_count, length(text) AS l, len(regexp_extract_all(text, '제[\s\p{Z}]*\p{Nd}+[\s\p{Z}]*조')) AS a, len(regexp_extract_all(text, '[①-⑯]')) AS c,
        len(regexp_extract_all(text, '(?m)^[\s\p{Z}]*\p{Nd}+\.[\s\p{Z}]')) AS m FROM bank_documents WHERE text IS NOT NULL)
        SELECT doc_id, a::INT AS n_articles, c::INT AS n_circled, m::INT AS n_numbered, CASE WHEN a >= 5 THEN 'article' WHEN c >= 10 THEN 'clause' WHEN m >= 5 THEN 'numbered' ELSE 'flat' END AS detected,
        floor(l / greatest(coalesce(page_count, 0), 1)) < 100 AS is_scan FROM n""",
    "f_compliance": rf"""WITH p AS (SELECT doc_id, concat_ws(' ', text, '심의필 제' || compliance_no || ' (' || strftime(compliance_date, '%Y.%-m.%-d') || ')') AS text FROM bank_documents), n AS (SELECT doc_id, text, regexp_extract(text, '{_COMP}', 0) AS hit FROM p),
        m AS (SELECT doc_id, regexp_extract(hit, '{_COMP}', 1) || '-' || regexp_extract(hit, '{_COMP}', 2) || '-' || regexp_extract(hit, '{_COMP}', 3) AS found_no,
        substr(text, (instr(text, hit) + length(hit))::BIGINT, 40) AS tail FROM n WHERE hit <> '')
        SELECT doc_id, found_no, CAST(try_strptime(nullif(regexp_extract(tail, '\((\d{{4}}[.\-]\d{{1,2}}[.\-]\d{{1,2}})\)', 1), '').replace('.', '-'), '%Y-%m-%d') AS DATE) AS found_date FROM m""",
    "f_title_keyword": rf"""WITH l AS (SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 25)) AS line, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 25), 1) AS pos FROM bank_documents),
        t AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \t\x{{a0}}\x{{3000}}]+', ' ', 'g')) AS line FROM l)
        SELECT doc_id, arg_min(line, pos) AS title_found FROM t WHERE length(line) BETWEEN 1 AND 60 AND regexp_matches(line, '{"|".join(T.KIND_WORDS)}') GROUP BY doc_id""",
    "f_question_terms": f"SELECT query_id, array_to_string({_TERMS}, ' ') AS terms, array_to_string({TOKENS.format('question')}, ' ') AS tokens FROM retrieval_eval",
    "f_lexical_overlap": f"""WITH {CHUNKS_ONCE}, {LABELS}, p AS (SELECT query_id, text, {_TERMS} AS w, {_STEMS} AS s FROM labels JOIN (SELECT chunk_id, text FROM c WHERE text IS NOT NULL) USING (chunk_id)),
        b AS (SELECT query_id, max(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(text, x))) / len(w)::DOUBLE ELSE 0 END) AS lexical,
        max(CASE WHEN len(s) >= 3 THEN len(list_filter(s, lambda x: contains(text, substr(x, 1, 3)))) / len(s)::DOUBLE ELSE 0 END) AS stems FROM p GROUP BY 1)
        SELECT query_id, round(lexical, 6) AS lexical, round(stems, 6) AS stems, CASE WHEN lexical >= .5 THEN 'high' WHEN lexical >= .25 THEN 'middle' ELSE 'low' END AS bucket FROM b""",
    "f_hard_terms": f"""WITH {CHUNKS_ONCE}, {LABELS}, p AS (SELECT query_id, chunk_id, question, text, doc_display_name AS dn FROM labels JOIN (SELECT chunk_id, text, doc_display_name FROM c) USING (chunk_id))
        SELECT query_id, chunk_id, list_filter(regexp_extract_all(coalesce(dn, ''), '[가-힣A-Za-z]{{3,}}'), lambda w: w NOT IN ({COMMON}) AND substr(w, 1, 2) NOT IN ({COMMON}) AND contains(question, w))[1] AS name_term,
        list_filter(list_transform(regexp_extract_all(question, '[가-힣]{{4,}}'), lambda w: regexp_replace(w, '({T.PARTICLES})$', '')), lambda w: length(w) >= 4 AND w NOT IN ({COMMON}) AND contains(text, w))[1] AS text_term FROM p""",
    "f_spacing": rf"""WITH {CHUNKS_ONCE}, s AS (SELECT doc_type, text, CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, ' ', ''))) / length(text)::DOUBLE ELSE 0 END AS r,
        coalesce(list_max(list_transform(regexp_extract_all(text, '[가-힣]{{12,}}'), lambda x: length(x))), 0) AS run FROM c WHERE text IS NOT NULL)
        SELECT doc_type, count(*) AS n_chunks, count(*) FILTER (r < 0.10) AS n_damaged, round(avg(r), 6) AS avg_ratio, max(run)::INT AS longest_run, count(*) FILTER (regexp_matches(text, '\(\s*\)|\(\s*%\s*\)|（\s*）|_{{3,}}|\.{{5,}}|☐|□')) AS n_blank FROM s GROUP BY 1""",
    "f_gram_sets": f"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(title, ''), '[^가-힣A-Za-z0-9]', '', 'g') AS t, regexp_replace(coalesce(subtitle, ''), '[^가-힣A-Za-z0-9]', '', 'g') AS s FROM bank_documents),
        g AS (SELECT doc_id, {_GRAMS.format('t')} AS a, {_GRAMS.format('s')} AS b FROM n)
        SELECT doc_id, len(a)::INT AS n_title, len(b)::INT AS n_subtitle, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE ELSE 0 END, 6) AS overlap FROM g""",
    "f_faq_clean": f"SELECT DISTINCT faq_id, {_FAQ('question')} AS question_clean, length({_FAQ('answer')})::INT AS answer_chars FROM faq_records",
    "f_sentences": rf"""WITH s AS (SELECT faq_id, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?]){SP}+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: length(x) > 5) AS l FROM (SELECT DISTINCT faq_id, answer FROM faq_records))
        SELECT faq_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS sentence FROM s""",
    "f_cache_key": "WITH k AS (SELECT *, substr(sha256('model|prompt|' || question), 1, 24) AS key FROM retrieval_eval) SELECT query_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE difficulty = 'easy')",
}
