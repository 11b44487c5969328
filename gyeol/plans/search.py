"""Queries of sparse and dense retrieval, fusion, metrics and vocabulary.

Searches over chunks take the questions of retrieval_eval. Searches over documents take as queries
the documents, or vectors, whose id is divisible by 100, against all rows; a document's first line is
its query text. Vectors and documents share ids only by number, which exercises fusion, not quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import text as T
from gyeol.operators import retrieval as R
from gyeol.plans.text import CHUNKS_ONCE, LABELS, TOKENS, chunks_once, labels_long
from gyeol.session import fingerprint, materialize
from gyeol.sources.tables import table

METRICS = ("recall_1", "recall_5", "recall_10", "full_recall_5", "precision_5", "rr", "ndcg_10")


def _chunk_tokens():
    return T.word_tokens(T.indexable_text(F.col("doc_display_name"), F.col("section"), F.col("text")))


def chunk_index(spark: SparkSession, d: str):
    """The index of the chunks, made once per application for the files as they are."""
    c = chunks_once(spark, d, "doc_display_name", "section", "text")
    return R.stored_bm25_index(spark, "chunk-index", fingerprint(table(spark, d, "chunks")), c, "chunk_id", _chunk_tokens())


def question_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.query_terms(table(spark, d, "retrieval_eval"), "query_id", T.word_tokens(F.col("question")))


def chunk_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.bm25_search(chunk_index(spark, d), question_terms(spark, d), k)


def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return chunk_hits(spark, d, 10).select("query_id", F.col("id").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term."""
    idf = chunk_index(spark, d)[1]
    return idf.select("term", F.col("df").cast("bigint").alias("df"), F.round("idf", 6).alias("idf"))


def bm25_score_all(spark: SparkSession, d: str) -> DataFrame:
    """The score of every chunk for the first question by id: zero where no term is in common."""
    r = table(spark, d, "retrieval_eval")
    first = r.agg(F.min_by(F.struct("query_id", "question"), "query_id").alias("q")).select("q.*")
    scores = R.bm25_scores(chunk_index(spark, d), R.query_terms(first, "query_id", T.word_tokens(F.col("question"))))
    return chunks_once(spark, d, "doc_id").select(F.col("chunk_id").alias("id")).join(scores, "id", "left").select(F.col("id").alias("chunk_id"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def self_check(spark: SparkSession, d: str) -> DataFrame:
    """Does each query vector find itself first? n and the number that do."""
    hits = _dense(spark, d, 1, False).where("rank = 1")
    return hits.agg(F.count("*").alias("n"), F.sum((F.col("query_id") == F.col("id")).cast("int")).alias("n_self_first"))


def _dense(spark: SparkSession, d: str, k: int, exclude_self: bool = True) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    return R.dense_search(e, "vec_id", "embedding", q, "vec_id", "embedding", k, exclude_self)


def dense_top10(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 10).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def dense_norms(spark: SparkSession, d: str) -> DataFrame:
    n = R.norms(table(spark, d, "embeddings"), "embedding")
    return n.select(F.round("min_norm", 5).alias("min_norm"), F.round("max_norm", 5).alias("max_norm"), "n", "min_dim", "max_dim")


def dense_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the dense search; relevant are the other vectors of the same label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = q.join(e, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"))
    m = R.per_query(q, relevant, _dense(spark, d, 20))
    return m.select("query_id", "label", "n_rel", *[F.round(c, 6).alias(c) for c in (*METRICS, "score_gap")], "first_hit_rank")


def _candidates(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    terms = R.query_terms(docs.where("doc_id % 100 = 0").withColumn("line", F.split("text", "\n", 2)[0]), "doc_id", T.word_tokens(F.col("line")))
    index = R.stored_bm25_index(spark, "document-index", fingerprint(docs), docs, "doc_id", T.word_tokens(F.col("text")))
    sparse = R.bm25_search(index, terms, k)
    return R.candidates(_dense(spark, d, k, False), sparse)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"), "dense_rank", "sparse_rank", "source")


def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.fuse_weighted(_candidates(spark, d), 0.5, 10))


def hybrid_weighted_z(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.fuse_weighted(_candidates(spark, d), 0.5, 10, R.z_sigmoid))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.fuse_rrf(_candidates(spark, d), 0.5, 10))


def fusion_grid(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate at 5 and mean reciprocal rank of eleven configurations over one retrieval; relevant
    are documents of the query's source and doc_type, itself left out."""
    cands = materialize(_candidates(spark, d), "candidates")
    x = table(spark, d, "documents").select("doc_id", "source", "doc_type")
    q = x.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "source", "doc_type")
    pool = cands.select("query_id", "id").distinct().join(q, "query_id").join(x.select(F.col("doc_id").alias("id"), F.col("source").alias("s2"), F.col("doc_type").alias("t2")), "id")
    relevant = materialize(pool.where("query_id <> id and source = s2 and doc_type = t2").select("query_id", "id"), "relevant")
    queries = q.select("query_id")
    alone = lambda side: R.top_k(cands.where(f"{side}_rank is not null").withColumn("score", F.col(f"{side}_score")), 10).select("query_id", "id", "rank", "score")
    configs = {"dense": alone("dense"), "sparse": alone("sparse")}
    for a in (0.3, 0.5, 0.7):
        configs[f"weighted_{a}"] = R.fuse_weighted(cands, a, 10)
        configs[f"weighted_z_{a}"] = R.fuse_weighted(cands, a, 10, R.z_sigmoid)
        configs[f"rrf_{a}"] = R.fuse_rrf(cands, a, 10)
    out = None
    for name, hits in configs.items():
        m = R.per_query(queries, relevant, hits.select("query_id", "id", "rank", "score"))
        one = m.agg(F.lit(name).alias("config"), F.count("*").alias("n"), F.round(F.avg("recall_5"), 4).alias("recall_5"), F.round(F.avg("rr"), 4).alias("mrr"))
        out = one if out is None else out.union(one)
    return out


def fusion_best(spark: SparkSession, d: str) -> DataFrame:
    """The configuration with the best hit rate at 5, then rank, then name."""
    return fusion_grid(spark, d).orderBy(F.desc("recall_5"), F.desc("mrr"), "config").limit(1)


def _eval(spark: SparkSession, d: str, doc_level: bool = False) -> DataFrame:
    q = table(spark, d, "retrieval_eval").select("query_id", "difficulty", "doc_type")
    relevant = labels_long(spark, d).select("query_id", F.col("chunk_id").alias("id")).distinct()
    hits = chunk_hits(spark, d, 20).select("query_id", "id", "rank", "score")
    if doc_level:
        relevant = relevant.select("query_id", T.chunk_to_doc(F.col("id")).alias("id")).distinct()
        hits = R.collapse_to_docs(hits, T.chunk_to_doc(F.col("id")))
    return R.per_query(q, relevant, hits)


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    m = _eval(spark, d)
    return m.select("query_id", "n_rel", *[F.round(c, 6).alias(c) for c in (*METRICS, "top1_score", "score_gap")], "first_hit_rank", R.failure_bucket(F.col("first_hit_rank")).alias("bucket"))


def eval_averages(spark: SparkSession, d: str) -> DataFrame:
    return R.averaged(_eval(spark, d), ["difficulty", "doc_type"], METRICS)


def eval_doc_level(spark: SparkSession, d: str) -> DataFrame:
    return R.averaged(_eval(spark, d, True), [], METRICS)


def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a hit in the first five, with those five."""
    m = _eval(spark, d).where("first_hit_rank = 0 or first_hit_rank > 5").select("query_id", "first_hit_rank", R.failure_bucket(F.col("first_hit_rank")).alias("failure_type"), F.round("score_gap", 6).alias("score_gap"))
    top = chunk_hits(spark, d, 5).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), "|").alias("top5"))
    return m.join(top, "query_id", "left").withColumn("top5", F.coalesce("top5", F.lit("")))


def eval_crosstab(spark: SparkSession, d: str) -> DataFrame:
    m = _eval(spark, d).withColumn("b", R.failure_bucket(F.col("first_hit_rank")))
    return m.groupBy("doc_type").pivot("b", ["top5", "6-20", "beyond_20"]).count().na.fill(0).select("doc_type", F.col("top5").alias("n_top5"), F.col("6-20").alias("n_6_20"), F.col("beyond_20").alias("n_beyond_20"))


def eval_success_scores(spark: SparkSession, d: str) -> DataFrame:
    m = _eval(spark, d).withColumn("success", F.col("recall_5") > 0)
    return m.groupBy("success").agg(F.count("*").alias("n"), F.round(F.avg("top1_score"), 4).alias("avg_top1"), F.round(F.avg("score_gap"), 4).alias("avg_gap"))


def _typed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of the index with the type of their chunk."""
    return chunk_index(spark, d)[3].join(chunks_once(spark, d, "doc_type").select(F.col("chunk_id").alias("id"), "doc_type"), "id")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieval_eval").select("query_id", F.explode(F.array_distinct(T.word_tokens(F.col("question")))).alias("term"))
    counts = r.groupBy("term").agg(F.countDistinct("query_id").alias("query_count"))
    v = R.vocabulary(_typed_tokens(spark, d), "id", "doc_type", F.col("tokens"), counts)
    return v.select("term", "df", F.round("ratio", 6).alias("ratio"), F.round("type_std", 5).alias("type_std"), "query_count", "verdict")


def typical_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.typical_terms(_typed_tokens(spark, d), "id", "doc_type", F.col("tokens"))


QUERIES = {
    "bm25_top10": bm25_top10, "bm25_terms": bm25_terms, "bm25_score_all": bm25_score_all, "self_check": self_check, "dense_top10": dense_top10, "dense_norms": dense_norms,
    "dense_by_label": dense_by_label, "hybrid_weighted": hybrid_weighted, "hybrid_weighted_z": hybrid_weighted_z, "hybrid_rrf": hybrid_rrf, "fusion_grid": fusion_grid, "fusion_best": fusion_best,
    "eval_per_query": eval_per_query, "eval_averages": eval_averages, "eval_doc_level": eval_doc_level, "eval_failures": eval_failures, "eval_crosstab": eval_crosstab,
    "eval_success_scores": eval_success_scores, "vocabulary": vocabulary, "typical_terms": typical_terms,
}

_PFX = "concat_ws(' ', nullif(doc_display_name, ''), CASE WHEN nullif(section, '') <> 'FAQ' THEN section END)"


def _index(docs: str, doc_id: str, text: str) -> str:
    return f"""
tok AS (SELECT {doc_id} AS id, {TOKENS.format(text)} AS t FROM {docs}),
st AS (SELECT count(*)::DOUBLE AS nd, avg(len(t)::DOUBLE) AS avgdl FROM tok),
post AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY id, len(t), term),
rawidf AS (SELECT term, count(*) AS df, ln(any_value(nd) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf)"""


def _sparse(queries: str, k: int) -> str:
    return f"""
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(t) AS term FROM ({queries})) GROUP BY 1, 2),
sc AS (SELECT query_id, id, sum(qf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM qt JOIN post USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= {k} AND score > 0)"""


_CHUNK_INDEX = CHUNKS_ONCE + ", cx AS (SELECT chunk_id, CASE WHEN " + _PFX + " <> '' THEN " + _PFX + " || chr(10) || coalesce(text, '') ELSE text END AS itext FROM c)," + _index("cx", "chunk_id", "itext")
_QUESTIONS = f"SELECT query_id, {TOKENS.format('question')} AS t FROM retrieval_eval"
_DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)," + _index("docs", "doc_id", "text")
_LINES = f"SELECT doc_id AS query_id, {TOKENS.format('split_part(text, chr(10), 1)')} AS t FROM docs WHERE doc_id % 100 = 0"


def _dense_sql(k: int, self_too: bool) -> str:
    return f"""
dn AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 {'' if self_too else 'AND q.vec_id <> e.vec_id'})) WHERE rank <= {k})"""


_CANDS = f"WITH {_DOCS}, {_sparse(_LINES, 100)}, {_dense_sql(100, True)}, " + """
ca AS (SELECT coalesce(dn.query_id, sp.query_id) AS query_id, coalesce(dn.id, sp.id) AS id, dn.rank AS dr, dn.score AS ds, sp.rank AS sr, sp.score AS ss
       FROM dn FULL OUTER JOIN sp ON dn.query_id = sp.query_id AND dn.id = sp.id)"""
_MM = "CASE WHEN {0} IS NULL THEN 0 WHEN max({0}) OVER w - min({0}) OVER w < 1e-9 THEN 1 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
_ZS = "CASE WHEN stddev_pop({0}) OVER w IS NULL OR stddev_pop({0}) OVER w < 1e-9 THEN CASE WHEN {0} IS NULL THEN 0 ELSE 0.5 END ELSE 1 / (1 + exp(-(coalesce({0}, min({0}) OVER w) - avg({0}) OVER w) / stddev_pop({0}) OVER w)) END"
_OUT = """SELECT query_id, id AS doc_id, rank::INT AS rank, round(score, 6) AS score, coalesce(dr, 0)::INT AS dense_rank, coalesce(sr, 0)::INT AS sparse_rank,
CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 'both' WHEN dr IS NOT NULL THEN 'dense' ELSE 'sparse' END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id {0}) AS rank FROM f) WHERE rank <= 10"""


def _metrics(queries: str, hits: str, relevant: str, more: str = "") -> str:
    """CTE m with the metrics of each query."""
    ks = {k: f"count(*) FILTER (hit AND rank <= {k})" for k in (1, 5, 10)}
    return f"""
rl AS (SELECT DISTINCT query_id, id FROM ({relevant})), nr AS (SELECT query_id, count(*) AS n_rel FROM rl GROUP BY 1),
mk AS (SELECT h.*, rl.id IS NOT NULL AS hit FROM ({hits}) h LEFT JOIN rl ON h.query_id = rl.query_id AND h.id = rl.id),
g AS (SELECT query_id, min(rank) FILTER (hit) AS fh, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, {ks[1]} AS n1, {ks[5]} AS n5, {ks[10]} AS n10,
      sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (hit AND rank <= 10) AS dcg FROM mk GROUP BY 1),
m AS (SELECT q.query_id {more}, coalesce(n_rel, 0) AS n_rel, (coalesce(n1, 0) > 0)::INT::DOUBLE AS recall_1, (coalesce(n5, 0) > 0)::INT::DOUBLE AS recall_5, (coalesce(n10, 0) > 0)::INT::DOUBLE AS recall_10,
      CASE WHEN n_rel > 0 THEN coalesce(n5, 0) / n_rel::DOUBLE ELSE 0 END AS full_recall_5, coalesce(n5, 0) / 5.0::DOUBLE AS precision_5, coalesce(1.0::DOUBLE / fh, 0) AS rr,
      CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) ELSE 0 END AS ndcg_10,
      coalesce(fh, 0)::INT AS first_hit_rank, coalesce(s1, 0) AS top1_score, coalesce(s1 - s2, 0) AS score_gap
      FROM ({queries}) q LEFT JOIN nr USING (query_id) LEFT JOIN g USING (query_id))"""


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
_AVG = ", ".join(f"round(avg({c}), 4) AS {c}" for c in METRICS)
_EVAL = f"WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 20)}, {LABELS}, " + _metrics("SELECT query_id, difficulty, doc_type FROM retrieval_eval", "SELECT * FROM sp", "SELECT query_id, chunk_id AS id FROM labels WHERE chunk_id <> ''", ", difficulty, doc_type")
_DOC_HITS = "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, score FROM (SELECT query_id, regexp_replace(id, '_c[^_]*$', '') AS id, min(rank) AS r, arg_min(score, rank) AS score FROM sp GROUP BY 1, 2)"
_BUCKET = "CASE WHEN first_hit_rank BETWEEN 1 AND 5 THEN 'top5' WHEN first_hit_rank BETWEEN 6 AND 20 THEN '6-20' ELSE 'beyond_20' END"

SQL = {
    "bm25_top10": f"WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 10)} SELECT query_id, id AS chunk_id, rank::INT AS rank, round(score, 6) AS score FROM sp",
    "bm25_terms": f"WITH {_CHUNK_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_score_all": f"WITH {_CHUNK_INDEX}, {_sparse('SELECT * FROM (' + _QUESTIONS + ') ORDER BY query_id LIMIT 1', 10)} SELECT chunk_id, round(coalesce(score, 0), 6) AS score FROM c LEFT JOIN sc ON chunk_id = sc.id",
    "self_check": f"WITH {_dense_sql(1, True)} SELECT count(*) AS n, count(*) FILTER (query_id = id) AS n_self_first FROM dn",
    "dense_top10": f"WITH {_dense_sql(10, False)} SELECT query_id, id AS vec_id, rank::INT AS rank, round(score, 6) AS score FROM dn",
    "dense_norms": "SELECT round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm, count(*) AS n, min(l)::INT AS min_dim, max(l)::INT AS max_dim FROM (SELECT len(embedding) AS l, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "dense_by_label": f"WITH {_dense_sql(20, False)}, " + _metrics("SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0", "SELECT * FROM dn", "SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0", ", label")
    + f" SELECT query_id, label, n_rel, {_ROUNDED}, round(score_gap, 6) AS score_gap, first_hit_rank FROM m",
    "hybrid_weighted": f"{_CANDS}, f AS (SELECT *, 0.5::DOUBLE * {_MM.format('ds')} + 0.5::DOUBLE * {_MM.format('ss')} AS score FROM ca WINDOW w AS (PARTITION BY query_id)) " + _OUT.format(""),
    "hybrid_weighted_z": f"{_CANDS}, f AS (SELECT *, 0.5::DOUBLE * {_ZS.format('ds')} + 0.5::DOUBLE * {_ZS.format('ss')} AS score FROM ca WINDOW w AS (PARTITION BY query_id)) " + _OUT.format(""),
    "hybrid_rrf": f"{_CANDS}, f AS (SELECT *, coalesce(0.5::DOUBLE / (60 + dr), 0) + coalesce(0.5::DOUBLE / (60 + sr), 0) AS score FROM ca) " + _OUT.format("DESC"),
    "eval_per_query": f"{_EVAL} SELECT query_id, n_rel, {_ROUNDED}, round(top1_score, 6) AS top1_score, round(score_gap, 6) AS score_gap, first_hit_rank, {_BUCKET} AS bucket FROM m",
    "eval_averages": f"{_EVAL} SELECT 'overall' AS dim, NULL AS value, count(*) AS n, {_AVG} FROM m UNION ALL SELECT 'difficulty', difficulty, count(*), {_AVG} FROM m GROUP BY difficulty UNION ALL SELECT 'doc_type', doc_type, count(*), {_AVG} FROM m GROUP BY doc_type",
    "eval_doc_level": f"WITH {_CHUNK_INDEX}, {_sparse(_QUESTIONS, 20)}, {LABELS}, " + _metrics("SELECT query_id FROM retrieval_eval", _DOC_HITS, "SELECT query_id, regexp_replace(chunk_id, '_c[^_]*$', '') AS id FROM labels WHERE chunk_id <> ''")
    + f" SELECT 'overall' AS dim, NULL::VARCHAR AS value, count(*) AS n, {_AVG} FROM m",
    "eval_failures": f"{_EVAL} SELECT m.query_id, first_hit_rank, {_BUCKET} AS failure_type, round(score_gap, 6) AS score_gap, coalesce(t.top5, '') AS top5 FROM m LEFT JOIN (SELECT query_id, string_agg(id, '|' ORDER BY rank) AS top5 FROM sp WHERE rank <= 5 GROUP BY 1) t ON m.query_id = t.query_id WHERE first_hit_rank = 0 OR first_hit_rank > 5",
    "eval_crosstab": f"{_EVAL} SELECT doc_type, count(*) FILTER ({_BUCKET} = 'top5') AS n_top5, count(*) FILTER ({_BUCKET} = '6-20') AS n_6_20, count(*) FILTER ({_BUCKET} = 'beyond_20') AS n_beyond_20 FROM m GROUP BY 1",
    "eval_success_scores": f"{_EVAL} SELECT recall_5 > 0 AS success, count(*) AS n, round(avg(top1_score), 4) AS avg_top1, round(avg(score_gap), 4) AS avg_gap FROM m GROUP BY 1",
    "vocabulary": f"""WITH {CHUNKS_ONCE}, x AS (SELECT doc_type AS kind, list_distinct({TOKENS.format("CASE WHEN " + _PFX + " <> '' THEN " + _PFX + " || chr(10) || coalesce(text, '') ELSE text END")}) AS t FROM c),
        k AS (SELECT kind, count(*) AS total FROM x GROUP BY 1), ct AS (SELECT term, kind, count(*) AS n FROM (SELECT kind, unnest(t) AS term FROM x) GROUP BY 1, 2),
        p AS (SELECT term, sum(n) AS df, sum(n / total::DOUBLE) AS s1, sum((n / total::DOUBLE) * (n / total::DOUBLE)) AS s2 FROM ct JOIN k USING (kind) GROUP BY 1),
        qc AS (SELECT term, count(DISTINCT query_id) AS query_count FROM (SELECT query_id, unnest({TOKENS.format('question')}) AS term FROM retrieval_eval) GROUP BY 1),
        v AS (SELECT term, df, df / (SELECT sum(total) FROM k)::DOUBLE AS ratio, sqrt(greatest(s2 / (SELECT count(*) FROM k) - (s1 / (SELECT count(*) FROM k)) * (s1 / (SELECT count(*) FROM k)), 0)) AS sd, coalesce(query_count, 0) AS query_count FROM p LEFT JOIN qc USING (term))
        SELECT term, df::BIGINT AS df, round(ratio, 6) AS ratio, round(sd, 5) AS type_std, query_count, CASE WHEN ratio >= 0.35 AND round(sd, 9) < 0.15 AND query_count <= 2 THEN 'drop' WHEN ratio >= 0.35 AND query_count > 2 THEN 'keep_queried' WHEN ratio >= 0.35 THEN 'keep_typed' ELSE 'keep' END AS verdict FROM v""",
    "typical_terms": f"""WITH {CHUNKS_ONCE}, x AS (SELECT doc_type AS kind, list_distinct({TOKENS.format("CASE WHEN " + _PFX + " <> '' THEN " + _PFX + " || chr(10) || coalesce(text, '') ELSE text END")}) AS t FROM c),
        k AS (SELECT kind, count(*) AS total FROM x GROUP BY 1), ct AS (SELECT term, kind, count(*) AS n FROM (SELECT kind, unnest(t) AS term FROM x) GROUP BY 1, 2),
        s AS (SELECT kind, term, n / total::DOUBLE AS i, CASE WHEN a - total > 0 THEN (df - n) / (a - total)::DOUBLE ELSE 0 END AS o FROM ct JOIN k USING (kind) JOIN (SELECT term, sum(n) AS df FROM ct GROUP BY 1) USING (term), (SELECT sum(total) AS a FROM k) WHERE n >= 10)
        SELECT kind, rank::INT AS rank, term, round(i, 6) AS in_ratio FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(i - o, 9) DESC, term DESC) AS rank FROM s WHERE i > 0.15 AND i > o * 3) WHERE rank <= 8""",
}

_MMF = "SELECT *, {a}::DOUBLE * " + _MM.format("ds") + " + {b}::DOUBLE * " + _MM.format("ss") + " AS score FROM ca WINDOW w AS (PARTITION BY query_id)"
_ZSF = "SELECT *, {a}::DOUBLE * " + _ZS.format("ds") + " + {b}::DOUBLE * " + _ZS.format("ss") + " AS score FROM ca WINDOW w AS (PARTITION BY query_id)"
_RRF = "SELECT *, coalesce({a}::DOUBLE / (60 + dr), 0) + coalesce({b}::DOUBLE / (60 + sr), 0) AS score FROM ca"
_GRID = {"dense": ("SELECT *, ds AS score FROM ca WHERE dr IS NOT NULL", ""), "sparse": ("SELECT *, ss AS score FROM ca WHERE sr IS NOT NULL", "")}
for _a, _b in ((0.3, 0.7), (0.5, 0.5), (0.7, 1 - 0.7)):
    _GRID |= {f"weighted_{_a}": (_MMF.format(a=_a, b=_b), ""), f"weighted_z_{_a}": (_ZSF.format(a=_a, b=_b), ""), f"rrf_{_a}": (_RRF.format(a=_a, b=_b), "DESC")}
SQL["fusion_grid"] = f"""{_CANDS}, q AS (SELECT doc_id AS query_id, source, doc_type FROM documents WHERE doc_id % 100 = 0),
    rl AS (SELECT DISTINCT ca.query_id, ca.id FROM ca JOIN q ON ca.query_id = q.query_id JOIN documents x ON ca.id = x.doc_id WHERE ca.query_id <> ca.id AND q.source = x.source AND q.doc_type = x.doc_type),
    hits AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS config, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id {o}) AS rank FROM ({f})" for n, (f, o) in _GRID.items()) + """),
    fh AS (SELECT config, query_id, min(rank) AS r FROM hits JOIN rl USING (query_id, id) WHERE rank <= 10 GROUP BY 1, 2)
    SELECT config, count(*) AS n, round(avg((coalesce(r, 99) <= 5)::INT), 4) AS recall_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM (SELECT DISTINCT config FROM hits) CROSS JOIN (SELECT query_id FROM q) LEFT JOIN fh USING (config, query_id) GROUP BY 1"""
SQL["fusion_best"] = f"SELECT * FROM ({SQL['fusion_grid']}) ORDER BY recall_5 DESC, mrr DESC, config LIMIT 1"
