"""Queries of chunking, quality, duplicates, versions, sampling and remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import text as T
from gyeol.operators import chunking as C
from gyeol.operators import quality as Q
from gyeol.operators import similar as S
from gyeol.plans import chunk_sql
from gyeol.plans.text import _GRAMS, _NAME, CHUNKS_ONCE, LABELS, SP, chunks_once, labels_long
from gyeol.session import materialize
from gyeol.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bank_documents")


def chunk_structural(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_docs(spark, d)).select("*", "metadata.*").drop("metadata")


def chunk_flat(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_docs(spark, d), by_structure=False).select("*", "metadata.*").drop("metadata")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_once(spark, d, "doc_type", "text").where("text is not null").select("doc_type", F.length("text").alias("char_count"))
    return C.length_stats(c, "doc_type")


def chunk_stats_by_doc(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_once(spark, d, "doc_id", "text").where("text is not null")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.floor(F.sum(F.length("text")) / F.count("*")).alias("avg_chars"), F.max(F.length("text")).alias("max_chars"))


def chunk_force_split(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over the limit cut at fixed steps."""
    c = chunks_once(spark, d, "text").where(F.length("text") > C.LONGEST)
    return c.select("chunk_id", F.posexplode(C.force_split(F.col("text"), F.lit(C.TARGET), F.lit(C.SHORTEST))).alias("pos", "piece")).select("chunk_id", "pos", F.md5("piece").alias("piece_md5"))


def sentences_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_once(spark, d, "text").where("text is not null")
    return c.select("chunk_id", F.size(C.split_sentences(F.col("text"))).alias("n_sentences"))


def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return Q.mark_duplicates(_docs(spark, d))


def dq_versions(spark: SparkSession, d: str) -> DataFrame:
    return Q.mark_versions(_docs(spark, d), Q.mark_duplicates(_docs(spark, d)))


def dq_dates(spark: SparkSession, d: str) -> DataFrame:
    return Q.date_issues(_docs(spark, d))


def _latest_titles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "registry_snapshots")
    last = s.groupBy("doc_id").agg(F.max(F.struct("snapshot_no", "delivered_at", "title", "subtitle")).alias("r"))
    return last.select("doc_id", F.col("r.title").alias("corrected_title"), F.col("r.subtitle").alias("corrected_subtitle"))


def dq_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Titles corrected by the last row of the register."""
    return Q.apply_overrides(_docs(spark, d), _latest_titles(spark, d))


def dq_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Ids numbered per kind and category in the order of file names."""
    f = _docs(spark, d).select("doc_id", "bank_code", "orig_filename", T.filename_type(F.col("orig_filename")).alias("kind"), T.filename_category(F.col("orig_filename")).alias("cat"))
    n = Q.numbered(f, ["bank_code", "kind", "cat"], ["orig_filename", "doc_id"])
    return n.select("doc_id", F.concat_ws("_", "bank_code", F.when(F.col("kind") == "약관", "terms").otherwise("desc"), "cat", F.lpad(F.col("seq").cast("string"), 6, "0")).alias("new_id"))


def dq_old_versions(spark: SparkSession, d: str) -> DataFrame:
    """Superseded documents beside their successors, with the days between their dates."""
    b = _docs(spark, d)
    new = b.select(F.col("doc_id").alias("superseded_by"), F.col("effective_date").alias("new_date"), F.col("title").alias("new_title"))
    old = b.where("not is_latest and superseded_by is not null").select("doc_id", "superseded_by", "effective_date", "title")
    return old.join(new, "superseded_by", "left").select("doc_id", "superseded_by", F.datediff("new_date", "effective_date").alias("days"), (F.col("title") == F.col("new_title")).alias("same_title"))


def dq_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    b = _docs(spark, d).where(T.filled(F.col("content_hash")).isNotNull())
    return b.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n_docs > 1")


def dq_titles(spark: SparkSession, d: str) -> DataFrame:
    b = _docs(spark, d)
    p = b.select("doc_id", F.array_join(Q.title_problems(F.col("title"), F.col("subtitle")), "|").alias("reasons"))
    return p.join(Q.title_candidates(b.where("text is not null")), "doc_id", "left").select("doc_id", "reasons", F.coalesce("candidates", F.lit("")).alias("candidates"))


def dq_faq(spark: SparkSession, d: str) -> DataFrame:
    return Q.faq_flags(table(spark, d, "faq_records"))


def dq_similar_questions(spark: SparkSession, d: str) -> DataFrame:
    """Links of each distinct question that has any: how many, and the closest."""
    p = S.similar_texts(table(spark, d, "faq_records"), "faq_id", "question")
    both = p.select(F.explode(F.array("id_a", "id_b")).alias("faq_id"), "ratio")  # one pass over the pairs
    return both.groupBy("faq_id").agg(F.count("*").alias("n_links"), F.max("ratio").alias("closest"))


def dq_faq_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faq_records")
    return f.groupBy("category").agg(F.count("*").alias("n"), F.min(F.length("question")).alias("min_q"), F.max(F.length("question")).alias("max_q"), F.round(F.avg(F.length("answer")), 4).alias("avg_a"))


def faq_documents(spark: SparkSession, d: str) -> DataFrame:
    return Q.faq_documents(table(spark, d, "faq_records"))


def faq_quota(spark: SparkSession, d: str) -> DataFrame:
    return Q.quota_dedup(table(spark, d, "faq_records"), 20).select("faq_id", "bank_code", "category", "rn")


def dq_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return Q.boilerplate(chunks_once(spark, d, "doc_id", "text"))


def dq_eval_set(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the evaluation set: repeated ids, empty questions, labels without chunk or twice."""
    r, l = table(spark, d, "retrieval_eval"), labels_long(spark, d)
    ids = table(spark, d, "chunks").select("chunk_id").distinct()
    note = lambda df, issue: df.select("query_id", F.lit(issue).alias("issue"))
    return (
        note(r.groupBy("query_id").count().where("count > 1"), "repeated_id")
        .union(note(r.where(T.filled(F.col("question")).isNull()), "empty_question"))
        .union(note(r.where(T.filled(F.col("relevant_chunk_ids")).isNull()), "no_label"))
        .union(note(l.join(ids, "chunk_id", "left_anti"), "missing_chunk"))
        .union(note(l.groupBy("query_id", "chunk_id").count().where("count > 1"), "label_twice"))
    )


def dq_eval_flags(spark: SparkSession, d: str) -> DataFrame:
    """Review flags of each question."""
    r = table(spark, d, "retrieval_eval")
    n = F.size(F.filter(F.split("relevant_chunk_ids", r"\|"), lambda x: x != ""))
    note = lambda c, s: F.when(c, F.lit(s))
    flags = F.array_compact(F.array(note(F.length("question") < 12, "short"), note(F.length("question") > 80, "long"), note(n > 3, "many_labels"), note(F.col("difficulty").isNull(), "no_difficulty"), note(F.col("answer_hint").isNull(), "no_hint")))
    return r.select("query_id", n.alias("n_labels"), F.array_join(flags, "|").alias("flags"))


def dq_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Composition of the evaluation set, over all and by each attribute, in one pass."""
    r = table(spark, d, "retrieval_eval").select("difficulty", "doc_type", "category")
    g = r.groupingSets([[], ["difficulty"], ["doc_type"], ["category"]], "difficulty", "doc_type", "category").agg(F.grouping_id("difficulty", "doc_type", "category").alias("g"), F.count("*").alias("n"))
    return g.select(F.when(F.col("g") == 3, "difficulty").when(F.col("g") == 5, "doc_type").when(F.col("g") == 6, "category").otherwise("all").alias("dim"), F.coalesce("difficulty", "doc_type", "category").alias("value"), "n")


def sample_quota(spark: SparkSession, d: str) -> DataFrame:
    """A sample for question writing: by document type, categories in turn, few of one document."""
    c = chunks_once(spark, d, "doc_id", "doc_type", "category", "text").where(Q.suitable(F.col("text"))).select("chunk_id", "doc_id", "doc_type", "category")
    c = c.join(Q.boilerplate(chunks_once(spark, d, "doc_id", "text")).select("chunk_id"), "chunk_id", "left_anti")
    return Q.quota_sample(c, {"설명서": 0.5, "약관": 0.3, "FAQ": 0.2}, 100)


def sample_blank(spark: SparkSession, d: str) -> DataFrame:
    """One chunk with a blank to fill in per document, the first by the hash of its id."""
    c = chunks_once(spark, d, "doc_id", "text").where(T.has_blank(F.col("text"))).withColumn("h", F.md5(F.concat(F.lit("7"), F.col("chunk_id"))))
    return c.groupBy("doc_id").agg(F.min(F.struct("h", "chunk_id")).alias("m")).select("doc_id", F.col("m.chunk_id").alias("chunk_id"))


def sample_strata(spark: SparkSession, d: str) -> DataFrame:
    """Two questions of each difficulty and document type."""
    from pyspark.sql.window import Window

    r = table(spark, d, "retrieval_eval").withColumn("difficulty", F.coalesce("difficulty", F.lit("none"))).withColumn("h", F.md5(F.concat(F.lit("42"), F.col("query_id"))))
    w = Window.partitionBy("difficulty", "doc_type").orderBy("h", "query_id")
    return r.withColumn("pick", F.row_number().over(w)).where("pick <= 2").select("query_id", "difficulty", "doc_type", "pick")


def remap(spark: SparkSession, d: str) -> DataFrame:
    """Labels carried from the given chunks to chunks cut anew by structure."""
    labels = labels_long(spark, d)
    ids = labels.select("chunk_id").distinct()
    old = chunks_once(spark, d, "doc_id", "text").join(ids, "chunk_id", "left_semi").select("chunk_id", "doc_id", "text")
    wanted = table(spark, d, "chunks").join(ids, "chunk_id", "left_semi").select("doc_id").distinct()  # only documents of labels are cut anew
    new = C.chunk_documents(_docs(spark, d).join(wanted, "doc_id", "left_semi")).select("chunk_id", "doc_id", "text")
    sizes = table(spark, d, "chunks").groupBy("doc_id").agg(F.count("*").alias("n"))  # new chunks are about as many, and are made once
    return Q.remap_labels(labels, old, new, sizes=sizes)


def remap_self(spark: SparkSession, d: str) -> DataFrame:
    """Labels carried from the given chunks to the same chunks under the ids of their successors."""
    labels, c = labels_long(spark, d), table(spark, d, "chunks")
    wanted = c.join(labels.select("chunk_id").distinct(), "chunk_id", "left_semi").select("doc_id").distinct()
    there = c.join(wanted, "doc_id", "left_semi").select("chunk_id").distinct()  # ids alone, so texts are moved once
    last = c.join(there, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "doc_id", "text")).alias("r"))
    old = materialize(last.select("chunk_id", "r.doc_id", "r.text").where("text is not null"), "remapped")  # it is read as old, as new and for sizes
    new = old.withColumn("chunk_id", F.concat(F.col("chunk_id"), F.lit("n")))
    return Q.remap_labels(labels, old, new)


QUERIES = {
    "chunk_structural": chunk_structural, "chunk_flat": chunk_flat, "chunk_stats": chunk_stats, "chunk_stats_by_doc": chunk_stats_by_doc, "chunk_force_split": chunk_force_split,
    "sentences_of_chunks": sentences_of_chunks, "dq_duplicates": dq_duplicates, "dq_versions": dq_versions, "dq_dates": dq_dates, "dq_overrides": dq_overrides, "dq_sequence": dq_sequence,
    "dq_old_versions": dq_old_versions, "dq_hash_groups": dq_hash_groups, "dq_titles": dq_titles, "dq_faq": dq_faq, "dq_similar_questions": dq_similar_questions, "dq_faq_counts": dq_faq_counts, "faq_documents": faq_documents, "faq_quota": faq_quota,
    "dq_boilerplate": dq_boilerplate, "dq_eval_set": dq_eval_set, "dq_eval_flags": dq_eval_flags, "dq_manifest": dq_manifest, "sample_quota": sample_quota, "sample_blank": sample_blank,
    "sample_strata": sample_strata, "remap": remap, "remap_self": remap_self,
}

_IN = "is_parsable AND coalesce(doc_type, '') <> 'FAQ'"
_DUP = f"""du AS (SELECT doc_id, orig_filename, content_hash, count(*) OVER (PARTITION BY content_hash) AS n, first_value(orig_filename) OVER w AS original, row_number() OVER w AS rn
    FROM bank_documents WHERE {_IN} AND nullif(trim(content_hash), '') IS NOT NULL WINDOW w AS (PARTITION BY content_hash ORDER BY orig_filename, doc_id))"""
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize({0}), chr(12288), ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), ' *\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
_SENT = "(합니다|입니다|한다|됩니다|바랍니다)[.\\s]*$"
_KINDS = "|".join(T.KIND_WORDS)
_OKAY = rf"length(text) BETWEEN 150 AND 900 AND length(regexp_replace(text, '[가-힣\s\p{{Z}}\x0b\x{{85}}]', '', 'g')) / length(text)::DOUBLE <= 0.45" + " AND NOT regexp_matches(text, '금융감독원|분쟁조정을 신청|고객상담센터|1599-1111|1588-1111|자료열람요구권|위법계약해지|청약철회권|위법사실을 안 날|책임을 지지 않습니다|보증하지 않습니다|정확성을 보증|참고용으로 제공되는|모든 요인을 설명한 것이 아|어떠한 손실에 대해서도|서명 또는 인|준법감시인|보존년한|이해를 돕고|참고자료이며|반드시 읽어보시기')"
_BOIL = f"fp AS (SELECT chunk_id, doc_id, substr(regexp_replace(text, '[^가-힣]', '', 'g'), 1, 150) AS fp FROM c), bo AS (SELECT chunk_id, n_docs FROM fp JOIN (SELECT fp, count(DISTINCT doc_id) AS n_docs FROM fp WHERE length(fp) = 150 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3) USING (fp))"
_FILEKIND = "CASE WHEN contains(orig_filename, '_terms_') THEN '약관' ELSE '설명서' END"
_FILECAT = "CASE " + " ".join(f"WHEN contains(orig_filename, '_{c}_') THEN '{c}'" for c in T.CATEGORIES) + " ELSE 'unknown' END"

SQL = {
    "chunk_structural": chunk_sql.chunks(True, _NAME),
    "chunk_flat": chunk_sql.chunks(False, _NAME),
    "chunk_stats": f"""WITH {CHUNKS_ONCE}, s AS (SELECT doc_type, list_sort(list(length(text))) AS l FROM c WHERE text IS NOT NULL GROUP BY 1)
        SELECT doc_type, len(l) AS n, floor(list_sum(l) / len(l))::BIGINT AS avg_chars, l[(len(l) // 2 + 1)::BIGINT]::INT AS median_chars, l[(floor(len(l) * 0.95::DOUBLE) + 1)::BIGINT]::INT AS p95_chars, l[-1]::INT AS max_chars, len(list_filter(l, lambda x: x > 900)) AS n_over FROM s""",
    "chunk_stats_by_doc": f"WITH {CHUNKS_ONCE} SELECT doc_id, count(*) AS n_chunks, (sum(length(text)) // count(*))::BIGINT AS avg_chars, max(length(text))::INT AS max_chars FROM c WHERE text IS NOT NULL GROUP BY 1",
    "chunk_force_split": rf"""WITH {CHUNKS_ONCE}, p AS (SELECT chunk_id, i, regexp_replace(substr(text, i * 500 + 1, 500), '^{SP}+|{SP}+$', '', 'g') AS piece FROM (SELECT chunk_id, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS i FROM c WHERE length(text) > 900))
        SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1)::INT AS pos, md5(piece) AS piece_md5 FROM p WHERE length(piece) >= 100""",
    "sentences_of_chunks": rf"""WITH {CHUNKS_ONCE} SELECT chunk_id, len(list_filter(string_split(regexp_replace(text, '([다요음함][.!?]){SP}+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}\x0b\x{{85}}]')))::INT AS n_sentences FROM c WHERE text IS NOT NULL""",
    "dq_duplicates": f"WITH {_DUP} SELECT doc_id, original, rn > 1 AS is_duplicate FROM du WHERE n > 1",
    "dq_versions": f"""WITH {_DUP}, v AS (SELECT doc_id, effective_date, content_hash, regexp_replace(title || '|' || subtitle, '{SP}+', '', 'g') AS k FROM bank_documents
        WHERE {_IN} AND coalesce(subtitle, '') <> '' AND title IS NOT NULL AND effective_date IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM du WHERE n > 1 AND rn > 1)),
        t AS (SELECT k, arg_max(struct_pack(d := doc_id, h := content_hash), (effective_date, doc_id)) AS l FROM v GROUP BY k HAVING min(effective_date) < max(effective_date))
        SELECT doc_id, l.d AS superseded_by FROM v JOIN t USING (k) WHERE doc_id <> l.d AND content_hash IS DISTINCT FROM l.h""",
    "dq_dates": f"SELECT doc_id, date_diff('day', compliance_date, effective_date)::INT AS gap_days, CASE WHEN date_diff('day', compliance_date, effective_date) < 0 THEN 'approved_later' ELSE 'long_ago' END AS issue FROM bank_documents WHERE {_IN} AND (date_diff('day', compliance_date, effective_date) < -30 OR date_diff('day', compliance_date, effective_date) > 730)",
    "dq_overrides": """WITH o AS (SELECT doc_id, title AS ct, subtitle AS cs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY snapshot_no DESC, delivered_at DESC NULLS LAST, title DESC NULLS LAST, subtitle DESC NULLS LAST) AS rn FROM registry_snapshots) WHERE rn = 1 AND nullif(trim(title), '') IS NOT NULL)
        SELECT b.doc_id, CASE WHEN ct IS NOT NULL THEN trim(ct) ELSE title END AS title, CASE WHEN ct IS NOT NULL THEN coalesce(trim(cs), '') ELSE subtitle END AS subtitle, CASE WHEN ct IS NOT NULL THEN 'manual' ELSE title_confidence END AS title_confidence FROM bank_documents b LEFT JOIN o USING (doc_id)""",
    "dq_sequence": f"SELECT doc_id, concat_ws('_', bank_code, CASE WHEN kind = '약관' THEN 'terms' ELSE 'desc' END, cat, lpad(row_number() OVER (PARTITION BY bank_code, kind, cat ORDER BY orig_filename, doc_id)::VARCHAR, 6, '0')) AS new_id FROM (SELECT doc_id, bank_code, orig_filename, {_FILEKIND} AS kind, {_FILECAT} AS cat FROM bank_documents)",
    "dq_old_versions": "SELECT o.doc_id, o.superseded_by, date_diff('day', o.effective_date, n.effective_date)::INT AS days, o.title = n.title AS same_title FROM bank_documents o LEFT JOIN bank_documents n ON o.superseded_by = n.doc_id WHERE NOT o.is_latest AND o.superseded_by IS NOT NULL",
    "dq_hash_groups": "SELECT content_hash, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM bank_documents WHERE nullif(trim(content_hash), '') IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dq_titles": rf"""WITH t AS (SELECT doc_id, text, trim(coalesce(title, '')) AS t, trim(coalesce(subtitle, '')) AS s FROM bank_documents),
        r AS (SELECT doc_id, CASE WHEN t = '' THEN 'no_title' ELSE concat_ws('|', CASE WHEN contains(t, '(cid:') THEN 'unreadable_font' END, CASE WHEN regexp_matches(t, '^제\s*\d+\s*조') THEN 'starts_as_article' END,
          CASE WHEN regexp_matches(t, '[①-⑳]') THEN 'clause_mark' END, CASE WHEN regexp_matches(t, '^[0-9\-./ ]+$') THEN 'document_number' END, CASE WHEN regexp_matches(t, '{_SENT}') THEN 'sentence' END,
          CASE WHEN length(t) > 45 THEN 'too_long' END, CASE WHEN NOT regexp_matches(t, '{_KINDS}') THEN 'no_kind_word' END, CASE WHEN s <> '' AND (regexp_matches(s, '{_SENT}') OR length(s) > 45) THEN 'bad_subtitle' END) END AS reasons FROM t),
        l AS (SELECT doc_id, unnest(string_split(substr(text, 1, 1200), chr(10))) AS line, generate_subscripts(string_split(substr(text, 1, 1200), chr(10)), 1) AS pos FROM bank_documents WHERE text IS NOT NULL),
        m AS (SELECT doc_id, line, min(pos) AS pos FROM (SELECT doc_id, pos, trim(regexp_replace(line, '{SP}+', ' ', 'g')) AS line FROM l) WHERE length(line) BETWEEN 4 AND 45 AND regexp_matches(line, '{_KINDS}') AND NOT regexp_matches(line, '\(cid:|[①-⑳]|준법감시인|보존년한') AND NOT regexp_matches(line, '{_SENT}') GROUP BY 1, 2),
        k AS (SELECT doc_id, array_to_string(list_slice(list(line ORDER BY pos), 1, 4), '|') AS candidates FROM m GROUP BY 1)
        SELECT doc_id, reasons, coalesce(candidates, '') AS candidates FROM r LEFT JOIN k USING (doc_id)""",
    "dq_faq": r"""WITH f AS (SELECT *, coalesce(question, '') AS q, coalesce(answer, '') AS a FROM faq_records),
        r AS (SELECT faq_id, 'empty' AS issue, unnest(list_filter(['faq_id', 'category', 'question', 'answer', 'source_url'], lambda x: CASE x WHEN 'faq_id' THEN coalesce(faq_id, '') WHEN 'category' THEN coalesce(category, '') WHEN 'question' THEN q WHEN 'answer' THEN a ELSE coalesce(source_url, '') END = '')) AS detail FROM f
          UNION ALL SELECT faq_id, 'question_short', length(q)::VARCHAR FROM f WHERE length(q) < 8 UNION ALL SELECT faq_id, 'answer_short', length(a)::VARCHAR FROM f WHERE length(a) < 20
          UNION ALL SELECT faq_id, 'answer_long', length(a)::VARCHAR FROM f WHERE length(a) > 1500 UNION ALL SELECT faq_id, 'label_left', '' FROM f WHERE regexp_matches(q, '^(Q\.|A\.|질문|답변)') OR regexp_matches(a, '^(Q\.|A\.|질문|답변)')
          UNION ALL SELECT faq_id, 'broken_characters', '' FROM f WHERE regexp_matches(q || chr(10) || a, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]'))
        SELECT DISTINCT faq_id, issue, detail FROM r UNION ALL SELECT faq_id, 'duplicate_id', count(*)::VARCHAR FROM faq_records GROUP BY 1 HAVING count(*) > 1""",
    "dq_faq_counts": "SELECT category, count(*) AS n, min(length(question))::INT AS min_q, max(length(question))::INT AS max_q, round(avg(length(answer)), 4) AS avg_a FROM faq_records GROUP BY 1",
    "faq_documents": f"""WITH f AS (SELECT *, {_NORM.format('question')} AS q, {_NORM.format('answer')} AS a, CAST(coalesce(try_strptime(collected_at, '%Y-%m-%d'), try_strptime(collected_at, '%Y.%m.%d')) AS DATE) AS day FROM faq_records),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY faq_id ORDER BY day DESC NULLS LAST, q DESC, a DESC, bank_code DESC NULLS LAST, category DESC NULLS LAST, source_url DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM f WHERE q <> '' AND a <> '') WHERE rn = 1)
        SELECT faq_id AS doc_id, bank_code, q AS title, 'Q. ' || q || chr(10) || 'A. ' || a AS text, 'FAQ' AS doc_type, category, CASE WHEN coalesce(status, 'active') = 'active' THEN 'qa_pair' ELSE 'scanned' END AS structure, day AS effective_date, coalesce(status, 'active') = 'active' AS is_parsable,
        CASE WHEN coalesce(status, 'active') <> 'active' THEN 'status=' || status ELSE '' END AS exclusion_reason, length('Q. ' || q || chr(10) || 'A. ' || a)::INT AS char_count, sha256(regexp_replace('Q. ' || q || chr(10) || 'A. ' || a, '{SP}+', '', 'g')) AS content_hash FROM l""",
    "faq_quota": "WITH g AS (SELECT question, answer, min((faq_id, bank_code, category)) AS r FROM faq_records GROUP BY 1, 2), h AS (SELECT question, r[1] AS faq_id, r[2] AS bank_code, r[3] AS category FROM g) SELECT faq_id, bank_code, category, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY bank_code, category ORDER BY faq_id, question) AS rn FROM h) WHERE rn <= 20",
    "dq_boilerplate": f"WITH {CHUNKS_ONCE}, {_BOIL} SELECT chunk_id, n_docs FROM bo",
    "dq_eval_set": f"""WITH {LABELS}, l AS (SELECT * FROM labels WHERE chunk_id <> '') SELECT query_id, 'repeated_id' AS issue FROM retrieval_eval GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT query_id, 'empty_question' FROM retrieval_eval WHERE nullif(trim(question), '') IS NULL
        UNION ALL SELECT query_id, 'no_label' FROM retrieval_eval WHERE nullif(trim(relevant_chunk_ids), '') IS NULL UNION ALL SELECT query_id, 'missing_chunk' FROM l WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) UNION ALL SELECT query_id, 'label_twice' FROM l GROUP BY query_id, chunk_id HAVING count(*) > 1""",
    "dq_eval_flags": "WITH r AS (SELECT *, len(list_filter(string_split(relevant_chunk_ids, '|'), lambda x: x <> '')) AS n FROM retrieval_eval) SELECT query_id, n::INT AS n_labels, concat_ws('|', CASE WHEN length(question) < 12 THEN 'short' END, CASE WHEN length(question) > 80 THEN 'long' END, CASE WHEN n > 3 THEN 'many_labels' END, CASE WHEN difficulty IS NULL THEN 'no_difficulty' END, CASE WHEN answer_hint IS NULL THEN 'no_hint' END) AS flags FROM r",
    "dq_manifest": "SELECT 'all' AS dim, NULL AS value, count(*) AS n FROM retrieval_eval UNION ALL SELECT 'difficulty', difficulty, count(*) FROM retrieval_eval GROUP BY difficulty UNION ALL SELECT 'doc_type', doc_type, count(*) FROM retrieval_eval GROUP BY doc_type UNION ALL SELECT 'category', category, count(*) FROM retrieval_eval GROUP BY category",
    "sample_quota": f"""WITH {CHUNKS_ONCE}, {_BOIL}, h AS (SELECT chunk_id, doc_id, doc_type, category, md5('42' || chunk_id) AS h FROM c WHERE {_OKAY} AND chunk_id NOT IN (SELECT chunk_id FROM bo)),
        a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, chunk_id) AS rd FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY doc_type, category ORDER BY h, chunk_id) AS rc FROM a WHERE rd <= CASE WHEN doc_type = 'FAQ' THEN 1 ELSE 3 END),
        e AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY rc, category) AS rt FROM b WHERE rc <= 50)
        SELECT chunk_id, doc_type, category, rt::INT AS pick FROM e WHERE rt <= CASE doc_type WHEN '설명서' THEN 50 WHEN '약관' THEN 30 WHEN 'FAQ' THEN 20 ELSE 0 END""",
    "sample_blank": rf"WITH {CHUNKS_ONCE} SELECT doc_id, arg_min(chunk_id, (md5('7' || chunk_id), chunk_id)) AS chunk_id FROM c WHERE regexp_matches(text, '\(\s*\)|\(\s*%\s*\)|（\s*）|_{{3,}}|\.{{5,}}|☐|□') GROUP BY 1",
    "sample_strata": "SELECT query_id, difficulty, doc_type, pick::INT AS pick FROM (SELECT query_id, coalesce(difficulty, 'none') AS difficulty, doc_type, row_number() OVER (PARTITION BY coalesce(difficulty, 'none'), doc_type ORDER BY md5('42' || query_id), query_id) AS pick FROM retrieval_eval) WHERE pick <= 2",
    "remap": f"""WITH {CHUNKS_ONCE}, {LABELS}, o AS (SELECT DISTINCT query_id, chunk_id AS old_id, doc_id, regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g') AS t FROM (SELECT query_id, chunk_id FROM labels) JOIN (SELECT chunk_id, doc_id, text FROM c) USING (chunk_id)),
        n AS (SELECT chunk_id AS new_id, doc_id, regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g') AS u FROM ({chunk_sql.chunks(True, _NAME)}) WHERE doc_id IN (SELECT doc_id FROM o)),
        og AS (SELECT *, {_GRAMS.format('t')} AS a FROM o), ng AS (SELECT *, {_GRAMS.format('u')} AS b FROM n),
        p AS (SELECT query_id, old_id, new_id, CASE WHEN old_id = new_id AND t = u THEN 2 WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE ELSE 0 END AS s FROM og JOIN ng USING (doc_id)),
        r AS (SELECT *, row_number() OVER w AS rank, max(s) OVER (PARTITION BY query_id, old_id) AS best FROM p WHERE s >= 0.25 WINDOW w AS (PARTITION BY query_id, old_id ORDER BY round(s, 9) DESC, new_id DESC))
        SELECT query_id, old_id, new_id, round(least(s, 1), 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3 AND (best < 2 AND s >= best * 0.5 OR s = 2)""",
    "remap_self": f"""WITH {CHUNKS_ONCE}, {LABELS}, o AS (SELECT DISTINCT query_id, chunk_id AS old_id, doc_id, regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g') AS t FROM (SELECT query_id, chunk_id FROM labels) JOIN (SELECT chunk_id, doc_id, text FROM c WHERE text IS NOT NULL) USING (chunk_id)),
        n AS (SELECT chunk_id || 'n' AS new_id, doc_id, regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g') AS u FROM c WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM o)),
        og AS (SELECT *, {_GRAMS.format('t')} AS a FROM o), ng AS (SELECT *, {_GRAMS.format('u')} AS b FROM n),
        p AS (SELECT query_id, old_id, new_id, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE ELSE 0 END AS s FROM og JOIN ng USING (doc_id)),
        r AS (SELECT *, row_number() OVER w AS rank, max(s) OVER (PARTITION BY query_id, old_id) AS best FROM p WHERE s >= 0.25 WINDOW w AS (PARTITION BY query_id, old_id ORDER BY round(s, 9) DESC, new_id DESC))
        SELECT query_id, old_id, new_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3 AND s >= best * 0.5""",
}
