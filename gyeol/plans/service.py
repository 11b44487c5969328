"""Queries of the catalog, of answer assembly and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import text as T
from gyeol.operators import answer as A
from gyeol.operators import catalog as K
from gyeol.operators import encode as E
from gyeol.operators import gate as G
from gyeol.operators import retrieval as R
from gyeol.plans.gate import _DECIDED, _JUDGED, _verdicts, gate_decisions
from gyeol.plans.search import _CHUNK_INDEX, _QUESTIONS, _sparse, chunk_hits
from gyeol.plans.text import _CLEAN, SP, chunks_once, labels_long
from gyeol.session import materialize
from gyeol.sources.tables import table
from gyeol.streaming import ingest as S

EVIDENCE = ("doc_display_name", "section", "effective_date", "text", "doc_type", "metadata")


def catalog_entries(spark: SparkSession, d: str) -> DataFrame:
    return K.catalog(table(spark, d, "bank_documents"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bank_documents").where("doc_type <> 'FAQ' and is_latest").select("doc_id", "title").withColumn("key", T.catalog_key(F.col("title")))


def catalog_match(spark: SparkSession, d: str) -> DataFrame:
    """The quoted names of the register, and its first words, against the titles of documents."""
    s = table(spark, d, "registry_snapshots").where("title is not null")
    quoted = F.regexp_extract("title", "[『「](.+?)[』」]", 1)
    asked = s.select(F.explode(F.array(quoted, F.col("title"))).alias("name")).where("name <> ''")
    return K.match_names(asked, _titles(spark, d))


def catalog_generic(spark: SparkSession, d: str) -> DataFrame:
    return K.generic_tokens(table(spark, d, "bank_documents").where("title is not null").select(F.col("title").alias("name")))


def answer_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = A.evidence(chunk_hits(spark, d, 3), chunks_once(spark, d, *EVIDENCE))
    return e.select("query_id", F.size("evidence").alias("n_evidence"), F.md5("block").alias("block_md5"))


def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and evidence of all questions; texts come from cached answers of half of them."""
    hits = materialize(chunk_hits(spark, d, 10), "hits")
    e = A.evidence(hits, chunks_once(spark, d, *EVIDENCE))
    r = table(spark, d, "retrieval_eval")
    cached = r.where("answer_hint is not null").select("query_id", F.col("answer_hint").alias("answer"))
    return A.build_answers(gate_decisions(spark, d, hits), e, cached).select("query_id", "decision", "stage", "reason", "answer", "n_evidence", "has_old")


def answer_missing_calls(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose call isn't in a cache that holds those about terms."""
    r = table(spark, d, "retrieval_eval")
    cache = r.where("doc_type = '약관'").select(T.cache_key(F.lit("m"), F.col("question")).alias("key"))
    return A.missing_calls(r, cache, F.lit("m"), F.col("question")).select("query_id", "key")


def answer_support(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of answers of the FAQ with cached verdicts on each, here by the hash of its place for three in
    four; a sentence without verdict isn't supported."""
    f = table(spark, d, "faq_records").groupBy("faq_id").agg(F.max("answer").alias("answer"))
    s = f.select(F.col("faq_id").alias("id"), F.posexplode(T.sentences(F.col("answer"))).alias("pos", "sentence")).withColumn("h", F.md5(F.concat_ws("|", "id", F.col("pos").cast("string"))))
    cache = s.where("h < 'c'").select("id", "pos", (F.col("h") < "a").alias("supported"))
    return A.sentence_support(s.drop("h").join(cache, ["id", "pos"], "left"))


def answer_display(spark: SparkSession, d: str) -> DataFrame:
    """What is shown for each question."""
    hits = materialize(chunk_hits(spark, d, 10), "hits")
    cached = table(spark, d, "retrieval_eval").where("answer_hint is not null").select("query_id", F.col("answer_hint").alias("answer"))
    built = A.build_answers(gate_decisions(spark, d, hits), A.evidence(hits, chunks_once(spark, d, *EVIDENCE)), cached)
    return A.display(built).select("query_id", F.length("display").alias("n_chars"), F.md5("display").alias("display_md5"))


def answer_cache_grown(spark: SparkSession, d: str) -> DataFrame:
    """A cache of verdicts on terms, grown by the results of the calls it lacked."""
    r = table(spark, d, "retrieval_eval")
    cache = r.where("doc_type = '약관'").select(T.cache_key(F.lit("m"), F.col("question")).alias("key"), F.lit("old").alias("result"))
    return A.grown_cache(cache, r.select(T.cache_key(F.lit("m"), F.col("question")).alias("key"), F.lit("new").alias("result")))


DIM = 256


def pipeline_hits(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fusion of hashed vectors and BM25 over chunks for the questions of retrieval_eval."""
    c = chunks_once(spark, d, "doc_display_name", "section", "text")
    text = T.indexable_text(F.col("doc_display_name"), F.col("section"), F.col("text"))
    vectors = E.encode_texts(c.select("chunk_id", text.alias("t")), "chunk_id", "t", E.hashing_encoder(DIM), DIM)
    asked = E.encode_texts(table(spark, d, "retrieval_eval"), "query_id", "question", E.hashing_encoder(DIM), DIM)
    dense = R.dense_search(vectors, "id", "vector", asked, "id", "vector", 100)
    return R.fuse_weighted(R.candidates(dense, chunk_hits(spark, d, 100)), 0.5, 10)


def pipeline_answers(spark: SparkSession, d: str) -> DataFrame:
    """From question to answer: retrieval, rules, signals, cached verdicts, evidence."""
    hits = materialize(pipeline_hits(spark, d).select("query_id", "id", "rank", "score"), "hits")
    c = chunks_once(spark, d, *EVIDENCE)
    q = table(spark, d, "retrieval_eval").select("query_id", "question")
    s = G.signals(q, hits, c.select(F.col("chunk_id").alias("id"), "text"))
    decided = G.judge(s, _verdicts(spark, d), 0.75, 0.08, 0.2)
    return A.build_answers(decided, A.evidence(hits, c)).select("query_id", "decision", "stage", "reason", "n_evidence", "has_old", "json")


def pipeline_quality(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the fused search by document, overall and by difficulty."""
    q = table(spark, d, "retrieval_eval").select("query_id", "difficulty", "doc_type")
    hits = R.collapse_to_docs(pipeline_hits(spark, d), T.chunk_to_doc(F.col("id")))
    relevant = labels_long(spark, d).select("query_id", T.chunk_to_doc(F.col("chunk_id")).alias("id")).distinct()
    return R.averaged(R.per_query(q, relevant, hits), ["difficulty", "doc_type"], ("recall_1", "recall_5", "recall_10", "rr", "ndcg_10"))


def stream_new_faq(spark: SparkSession, d: str) -> DataFrame:
    return S.run_new_to_table(S.new_faq(S.file_stream(spark, d, "faq_records")), "faq", ["content_hash"])


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = S.run_to_table(S.event_windows(S.file_stream(spark, d, "events")), "events")
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    "catalog_entries": catalog_entries, "catalog_match": catalog_match, "catalog_generic": catalog_generic, "answer_evidence": answer_evidence, "answer_batch": answer_batch,
    "answer_missing_calls": answer_missing_calls, "answer_support": answer_support, "answer_display": answer_display, "answer_cache_grown": answer_cache_grown, "pipeline_answers": pipeline_answers, "pipeline_quality": pipeline_quality, "stream_new_faq": stream_new_faq, "stream_event_windows": stream_event_windows,
}

_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^0-9a-z가-힣]', '', 'g')"
_NAME = _CLEAN.replace("trim(n)", "trim(coalesce(doc_display_name, ''))")
_HEAD = f"concat_ws(' ', nullif(trim({_NAME}), ''), CASE WHEN coalesce(section, '') NOT IN ('', 'FAQ') THEN section END, CASE WHEN coalesce(effective_date, '') <> '' THEN '(' || effective_date || ' 시행)' END)"
_EV = f", ev AS (SELECT sp.query_id, count(*) AS n, string_agg('[' || sp.rank || '] ' || {_HEAD} || chr(10) || substr(coalesce(text, ''), 1, 700), chr(10) || chr(10) ORDER BY sp.rank) AS block, bool_or(NOT coalesce(metadata.is_latest, true)) AS old FROM sp JOIN c ON sp.id = c.chunk_id WHERE sp.rank <= 3 GROUP BY 1)"

_BARE = lambda c: f"regexp_replace(regexp_replace(trim({c}), '{K.TAILS}', ''), '^[ –—·-]+|[ –—·-]+$', '', 'g')"

SQL = {
    "catalog_entries": f"""WITH t AS (SELECT *, trim(coalesce(title, '')) AS t FROM bank_documents WHERE coalesce(doc_type, '') <> 'FAQ'),
        h AS (SELECT *, CASE WHEN contains(t, ' - ') THEN substr(t, 1, instr(t, ' - ') - 1) ELSE t END AS head, CASE WHEN contains(t, ' - ') THEN trim(substr(t, instr(t, ' - ') + 3)) ELSE '' END AS tail FROM t),
        n AS (SELECT *, {_BARE('head')} AS bh, CASE WHEN regexp_matches(tail, '^[^(:][^:]{{0,23}}$') AND len(regexp_extract_all(tail, '[0-9]')) <= length(tail) * 0.3 THEN {_BARE('tail')} ELSE '' END AS bt, trim(regexp_extract(t, '{K.QUOTED}', 1)) AS quoted FROM h),
        p AS (SELECT *, CASE WHEN quoted <> '' THEN quoted WHEN length(bt) > length(bh) THEN bt ELSE bh END AS name,
          CASE WHEN NOT coalesce(is_parsable, false) THEN 'skipped_unparsable' WHEN NOT coalesce(is_latest, false) THEN 'skipped_old' WHEN t = '' THEN 'skipped_untitled' WHEN CASE WHEN quoted <> '' THEN quoted WHEN length(bt) > length(bh) THEN bt ELSE bh END = '' THEN 'skipped_unnamed'
          WHEN (doc_type = '약관' AND contains(title, '약관')) OR regexp_matches(title, '기본약관|이용약관') THEN 'general' WHEN quoted <> '' THEN 'product' ELSE 'family' END AS bucket FROM n),
        r AS (SELECT doc_id, bucket, CASE WHEN bucket = 'general' THEN CASE category WHEN 'deposit' THEN '예금' WHEN 'loan' THEN '대출' WHEN 'digital_banking' THEN '전자금융' WHEN 'fx' THEN '외환' WHEN 'trust' THEN '신탁·투자' WHEN 'retirement_pension' THEN '퇴직연금' WHEN 'derivatives' THEN '장외파생' WHEN 'others' THEN '기타' ELSE category END WHEN NOT starts_with(bucket, 'skipped') THEN name END AS name, doc_type, category FROM p) SELECT doc_id, bucket, name, {_KEY.format('name')} AS key, doc_type, category FROM r""",
    "catalog_match": f"""WITH q AS (SELECT DISTINCT name, {_KEY.format('name')} AS k FROM (SELECT unnest([regexp_extract(title, '[『「](.+?)[』」]', 1), title]) AS name FROM registry_snapshots WHERE title IS NOT NULL) WHERE name <> ''),
        e AS (SELECT k, min(doc_id) AS doc_id FROM (SELECT doc_id, {_KEY.format('title')} AS k FROM bank_documents WHERE doc_type <> 'FAQ' AND is_latest) WHERE k <> '' GROUP BY 1),
        x AS (SELECT q.name, min(e.doc_id) AS near_id, count(*) AS n FROM q JOIN e ON length(q.k) >= 4 AND length(e.k) >= 4 AND (contains(e.k, q.k) OR contains(q.k, e.k)) GROUP BY 1)
        SELECT q.name, CASE WHEN q.k = '' THEN 'none' WHEN e.doc_id IS NOT NULL THEN 'covered' WHEN near_id IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN q.k <> '' THEN coalesce(e.doc_id, near_id) END AS doc_id, coalesce(n, 0) AS n_candidates FROM q LEFT JOIN e ON q.k = e.k LEFT JOIN x ON q.name = x.name""",
    "catalog_generic": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower({_CLEAN}), '[0-9a-z가-힣]+'), lambda x: length(x) >= 2))) AS token FROM (SELECT title AS n FROM bank_documents WHERE title IS NOT NULL)) GROUP BY 1 HAVING count(*) >= 10",
    "answer_evidence": f"WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 3)}{_EV} SELECT query_id, n::INT AS n_evidence, md5(block) AS block_md5 FROM ev",
    "answer_batch": f"{_JUDGED}{_EV}, dc AS ({_DECIDED}) SELECT dc.query_id, decision, stage, reason, CASE WHEN decision = 'answer' THEN coalesce(answer_hint, '근거를 확인해 주십시오.') ELSE '' END AS answer, CASE WHEN stage = 'pattern' THEN 0 ELSE coalesce(n, 0) END::INT AS n_evidence, stage <> 'pattern' AND coalesce(old, false) AS has_old FROM dc LEFT JOIN ev USING (query_id) JOIN retrieval_eval USING (query_id)",
    "answer_missing_calls": "WITH k AS (SELECT *, substr(sha256('m|' || question), 1, 24) AS key FROM retrieval_eval) SELECT query_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_type = '약관')",
    "answer_support": rf"""WITH f AS (SELECT faq_id, max(answer) AS a FROM faq_records GROUP BY 1), s AS (SELECT faq_id AS id, list_filter(list_transform(string_split(regexp_replace(a, '([.!?]){SP}+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: length(x) > 5) AS l FROM f),
        e AS (SELECT id, md5(id || '|' || (generate_subscripts(l, 1) - 1)::VARCHAR) AS h, unnest(l) AS x FROM s) SELECT id, count(*) AS n_sentences, count(*) FILTER (h >= 'a') AS n_unsupported, bool_or(h >= 'a') AS hallucinated FROM e GROUP BY 1""",
    "answer_display": f"""{_JUDGED}, dc AS ({_DECIDED}), ev AS (SELECT sp.query_id, string_agg(chr(10) || chr(10) || substr('①②③④⑤⑥⑦⑧⑨⑩', rank, 1) || ' ' || {_HEAD} || CASE WHEN coalesce(metadata.is_latest, true) THEN '' ELSE '  ※ 최신본이 아닐 수 있음' END || chr(10) || '   ' || substr(coalesce(text, ''), 1, 600) || CASE WHEN length(coalesce(text, '')) > 600 THEN ' …' ELSE '' END, '' ORDER BY rank) AS e FROM sp JOIN c ON sp.id = c.chunk_id WHERE rank <= 3 GROUP BY 1),
        t AS (SELECT dc.query_id, CASE WHEN decision = 'answer' THEN '[답변]' || chr(10) || coalesce(answer_hint, '근거를 확인해 주십시오.') ELSE '[답변 불가]' || chr(10) || coalesce(chr(10) || chr(10) || '(사유: ' || reason || ' / 판정: ' || stage || ')', '') END || CASE WHEN stage <> 'pattern' AND e IS NOT NULL THEN chr(10) || chr(10) || '[근거]' || e ELSE '' END AS d FROM dc LEFT JOIN ev USING (query_id) JOIN retrieval_eval USING (query_id))
        SELECT query_id, length(d)::INT AS n_chars, md5(d) AS display_md5 FROM t""",
    "answer_cache_grown": "WITH k AS (SELECT substr(sha256('m|' || question), 1, 24) AS key, doc_type FROM retrieval_eval), o AS (SELECT key FROM k WHERE doc_type = '약관') SELECT key, 'old' AS result FROM o UNION ALL SELECT DISTINCT key, 'new' FROM k WHERE key NOT IN (SELECT key FROM o)",
    "stream_new_faq": f"SELECT DISTINCT sha256(regexp_replace(concat_ws(chr(10), question, answer), '{SP}+', '', 'g')) AS content_hash, length(regexp_replace(concat_ws(chr(10), question, answer), '{SP}+', '', 'g'))::INT AS n_chars FROM faq_records",
    "stream_event_windows": "WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, total FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)",
}
