"""Sparse and dense retrieval, fusion of both, and retrieval metrics, for tables of queries.

Sparse: an inverted index is three tables (postings, document frequencies, lengths); a search is an
equi join on terms. Postings are partitioned by document once; the weights of the queries' terms, few
beside them, are broadcast after a check of their number, so that the sum per query and document needs
no further shuffle. The search for the k best of a bounded query set goes further: Arrow batches of
token arrays are scored by numpy against all queries, and only the best leave a task.
Dense: the query set goes through in blocks of bounded size; each block is one matrix product per
batch of vectors, of which only the best k leave. Top-k windows are limited before their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gyeol.session import materialize, stored

K1, B, IDF_FLOOR = 1.2, 0.75, 0.25
BLOCK_QUERIES = 4096
#: Up to so many weights of query terms are broadcast; more are joined by shuffle.
BROADCAST_WEIGHTS = 500_000


# Sparse


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, term, tf and the length dl of the document, partitioned by id."""
    t = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).repartition("id")
    rows = t.select("id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).where("term is not null")  # explode itself would tokenize a second time, in a filter
    return rows.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25_index(docs: DataFrame, id_col: str, tokens: Column) -> tuple[DataFrame, ...]:
    """(postings, df with idf, stats, tokens per document): Okapi BM25; an idf below zero becomes `IDF_FLOOR` times the
    mean idf, the mean being over the values as they were."""
    p = postings(docs, id_col, tokens)
    return p, *_idf_and_stats(p, docs, tokens), docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))


def _idf_and_stats(p: DataFrame, docs: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    sizes = docs.select(F.size(tokens).cast("double").alias("dl"))
    stats = sizes.agg(F.count("*").cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = p.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean_idf") * IDF_FLOOR).otherwise(F.col("raw")).alias("idf"))
    return idf, stats


def stored_bm25_index(spark: SparkSession, name: str, key: str, docs: DataFrame, id_col: str, tokens: Column) -> tuple[DataFrame, ...]:
    """bm25_index over tables of the shared folder: texts are tokenized once, and terms counted once."""

    def build():
        t = materialize(docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")), f"{name}-tokens")
        terms = t.select("id", F.explode(F.array_distinct("tokens")).alias("term"))
        return t, *_idf_and_stats(terms, t, F.col("tokens"))

    t, idf, stats = stored(spark, name, key, build)
    return postings(t, "id", F.col("tokens")), idf, stats, t


def query_terms(queries: DataFrame, query_col: str, tokens: Column) -> DataFrame:
    """query_id, term, qf; a term that a query repeats counts as often."""
    q = queries.select(F.col(query_col).alias("query_id"), F.explode(tokens).alias("term"))
    return q.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def bm25_scores(index: tuple[DataFrame, ...], terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score for every pair with a term in common."""
    p, idf, stats = index[:3]
    weights = terms.join(idf.select("term", "idf"), "term")
    few = terms.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS
    tf = F.col("tf").cast("double")
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl").cast("double") / F.col("avgdl")))
    saturated = p.crossJoin(F.broadcast(stats)).select("id", "term", part.alias("s"))
    joined = saturated.join(F.broadcast(weights) if few else weights, "term")
    return joined.groupBy("id", "query_id").agg(F.sum(F.col("s") * F.col("idf") * F.col("qf")).alias("score"))


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", descending_id: bool = False) -> DataFrame:
    """The k best of each group: score rounded to 9 digits, then id; rank from 1."""
    order = [F.round(score, 9).desc(), F.col("id").desc() if descending_id else F.col("id").asc()]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


class _Weights:
    """The terms of a query set: for each the queries that hold it and its weight in them."""

    def __init__(self, rows: pa.Table, avgdl: float, k1: float, b: float):
        self.avgdl, self.k1, self.b = avgdl, k1, b
        term, query = rows.column("term").combine_chunks().dictionary_encode(), rows.column("query_id").combine_chunks().dictionary_encode()
        self.terms, self.queries = term.dictionary, query.dictionary
        t = term.indices.to_numpy()
        order = np.argsort(t, kind="stable")
        self.at = np.searchsorted(t[order], np.arange(len(self.terms) + 1))
        self.query = query.indices.to_numpy()[order].astype(np.int64)
        self.weight = (rows.column("idf").to_numpy() * rows.column("qf").to_numpy())[order]


def _best(k: int, weights):
    """From documents as token arrays: for each query those among the k best of the task, ties kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        nq, nt = len(w.queries), len(w.terms)
        floor = np.full(nq, -np.inf)
        q_all, s_all, id_all, held = [], [], [], 0

        def compact():
            nonlocal q_all, s_all, id_all, held
            q, s, ids = np.concatenate(q_all), np.concatenate(s_all), pa.concat_arrays(id_all)
            order = np.lexsort((-s, q))
            q, s = q[order], s[order]
            first = np.searchsorted(q, np.arange(nq + 1))
            kth = first[:-1] + k - 1
            full = kth < first[1:]
            floor[full] = np.round(s[kth[full]], 9)
            keep = np.round(s, 9) >= floor[q]
            q_all, s_all, id_all, held = [q[keep]], [s[keep]], [ids.take(pa.array(order[keep]))], int(keep.sum())

        for batch in batches:
            ids, tokens = batch.column("id"), batch.column("tokens")
            dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=w.terms), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(dl)), dl)[term >= 0]
            pair, tf = np.unique(doc * nt + term[term >= 0], return_counts=True)
            doc, term = pair // nt, pair % nt
            part = tf * (w.k1 + 1) / (tf + w.k1 * (1 - w.b + w.b * dl[doc] / w.avgdl))
            step = max(1, 2_000_000 // nq)
            for lo in range(0, len(dl), step):
                a, b = np.searchsorted(doc, (lo, lo + step))
                n = w.at[term[a:b] + 1] - w.at[term[a:b]]
                if not n.sum():
                    continue
                ends = np.cumsum(n)
                place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(w.at[term[a:b]], n)
                cell = np.repeat(doc[a:b] - lo, n) * nq + w.query[place]
                score = np.bincount(cell, np.repeat(part[a:b], n) * w.weight[place], step * nq)
                score = np.where(np.bincount(cell, minlength=step * nq) > 0, score, -np.inf).reshape(step, nq)
                d, q = np.nonzero((np.round(score, 9) >= floor) & (score > 0))
                q_all.append(q)
                s_all.append(score[d, q])
                id_all.append(ids.take(pa.array(d + lo)))
                held += len(d)
                if held > 3_000_000:
                    compact()
        if held:
            compact()
            for lo in range(0, held, 200_000):
                cut = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([w.queries.take(pa.array(q_all[0][cut])), id_all[0][cut], pa.array(s_all[0][cut])], ["query_id", "id", "score"])

    return run


def bm25_search(index: tuple[DataFrame, ...], terms: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank; scores of zero or less are dropped after the top k.

    With a query set of a bounded number of terms and the tokens at hand, each task scores its
    documents against all queries and lets only the k best of each leave: the pairs of query and
    document, far more than all else, never become rows. Otherwise terms are joined by shuffle."""
    if len(index) < 4 or terms.limit(BROADCAST_WEIGHTS + 1).count() > BROADCAST_WEIGHTS:
        return top_k(bm25_scores(index, terms, k1, b), k).where("score > 0")
    _, idf, stats, tokens = index
    spark = tokens.sparkSession
    schema = f"query_id {terms.schema['query_id'].dataType.simpleString()}, id {tokens.schema['id'].dataType.simpleString()}, score double"
    rows = terms.join(idf.select("term", "idf"), "term").select("query_id", "term", "qf", "idf").toArrow()
    if not rows.num_rows:
        return top_k(spark.createDataFrame([], schema), k)
    weights = spark.sparkContext.broadcast(_Weights(rows, stats.first().avgdl, k1, b))
    return top_k(tokens.mapInArrow(_best(k, weights), schema), k)


# Dense


def _dense_best(queries, k: int):
    """From vectors: for each query those among the k best of the task, ties kept until the final window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, nq = queries.value, len(queries.value)
        floor = np.full(nq, -np.inf)
        q_all, s_all, id_all, held = [], [], [], 0

        def compact():
            nonlocal q_all, s_all, id_all, held
            q, s, ids = np.concatenate(q_all), np.concatenate(s_all), pa.concat_arrays(id_all)
            order = np.lexsort((-s, q))
            q, s = q[order], s[order]
            first = np.searchsorted(q, np.arange(nq + 1))
            kth = first[:-1] + k - 1
            full = kth < first[1:]
            floor[full] = np.round(s[kth[full]], 9)
            keep = np.round(s, 9) >= floor[q]
            q_all, s_all, id_all, held = [q[keep]], [s[keep]], [ids.take(pa.array(order[keep]))], int(keep.sum())

        step = max(1, 4_000_000 // max(nq, 1))
        for batch in batches:
            ids, vectors = batch.column("id"), batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
            for lo in range(0, len(vectors), step):
                scores = matrix @ flat[lo : lo + step].T
                rounded = np.round(scores, 9)
                n = rounded.shape[1]
                least = np.maximum(floor, np.partition(rounded, n - k, axis=1)[:, n - k]) if n > k else floor
                q, d = np.nonzero(rounded >= least[:, None])
                q_all.append(q)
                s_all.append(scores[q, d])
                id_all.append(ids.take(pa.array(d + lo)))
                held += len(q)
                if held > 3_000_000:
                    compact()
        if held:
            compact()
            for lo in range(0, held, 200_000):
                cut = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(q_all[0][cut].astype(np.int32)), id_all[0][cut], pa.array(s_all[0][cut])], ["q", "id", "score"])

    return run


def dense_search(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_col: str, query_vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, id, score, rank by exact inner product, ties by id. k beyond the table gives all. All
    vectors have one dimension. Queries go in blocks of BLOCK_QUERIES, each broadcast once and matched in one
    pass over the vectors; only the k best of a task leave it."""
    spark = vectors.sparkSession
    src = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind, qkind = src.schema["id"].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
    out, ids, rows = None, [], []

    def block(out):
        part = src.mapInArrow(_dense_best(spark.sparkContext.broadcast(np.array(rows, np.float64)), k + exclude_self), f"q int, id {kind}, score double")
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {qkind}")
        part = part.join(F.broadcast(names), "q").select("query_id", "id", "score")  # at most BLOCK_QUERIES rows
        return part if out is None else out.union(part)

    for r in queries.where(F.col(query_vector).isNotNull()).select(query_col, query_vector).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_QUERIES:
            out, ids, rows = block(out), [], []
    if ids or out is None:
        out = block(out) if ids else spark.createDataFrame([], f"query_id {qkind}, id {kind}, score double")
    if exclude_self:
        out = out.where("query_id <> id")
    return top_k(out, k)


def norms(vectors: DataFrame, vector_col: str) -> DataFrame:
    """min_norm, max_norm, n, min_dim, max_dim: the checks of a vector table."""
    v = vectors.select(F.size(vector_col).alias("dim"), F.sqrt(F.aggregate(F.col(vector_col).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    return v.agg(F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"), F.count("*").alias("n"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"))


# Fusion


def candidates(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, id with the rank and score of each side, null where absent."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    return d.join(s, ["query_id", "id"], "full_outer")


def min_max(score: str) -> Column:
    """0 to 1 over those present of a query; absent 0; no span: 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(F.col(score).isNull(), 0.0).when(hi - lo < 1e-9, 1.0).otherwise((F.col(score) - lo) / (hi - lo))


def z_sigmoid(score: str) -> Column:
    """Sigmoid of the z-score over those present (population deviation); absent takes the least
    value present; no spread: 0.5, absent 0."""
    w = Window.partitionBy("query_id")
    mean, std = F.avg(score).over(w), F.stddev_pop(score).over(w)
    value = 1 / (1 + F.exp(-(F.col(score) - mean) / std))
    least = 1 / (1 + F.exp(-(F.min(score).over(w) - mean) / std))
    flat = std.isNull() | (std < 1e-9)
    return F.when(flat, F.when(F.col(score).isNull(), 0.0).otherwise(0.5)).otherwise(F.coalesce(value, least))


def source_of() -> Column:
    d, s = F.col("dense_rank").isNotNull(), F.col("sparse_rank").isNotNull()
    return F.when(d & s, "both").when(d, "dense").when(s, "sparse").otherwise("none")


def fuse_weighted(cands: DataFrame, alpha: float, k: int, norm=min_max) -> DataFrame:
    """alpha of the dense and the rest of the sparse score, normed; ties by id."""
    scored = cands.withColumn("score", alpha * norm("dense_score") + (1 - alpha) * norm("sparse_score"))
    return _finish(top_k(scored, k))


def fuse_rrf(cands: DataFrame, alpha: float, k: int, c: int = 60) -> DataFrame:
    """Reciprocal ranks; what is absent adds nothing; ties by id from the greatest."""
    part = lambda r, w: F.coalesce(w / (c + F.col(r)), F.lit(0.0))
    scored = cands.withColumn("score", part("dense_rank", alpha) + part("sparse_rank", 1 - alpha))
    return _finish(top_k(scored, k, descending_id=True))


def _finish(hits: DataFrame) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank")]
    return hits.select("query_id", "id", "rank", "score", *zero, source_of().alias("source"))


# Metrics


def per_query(queries: DataFrame, relevant: DataFrame, hits: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row per query, also without hits: hit rate, full recall and precision at k, reciprocal
    rank, first hit, NDCG, best score and its lead. queries: query_id...; relevant: query_id, id;
    hits: query_id, id, rank, score."""
    rel = relevant.distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = hits.join(rel.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    at = lambda k: (F.col("hit") == 1) & (F.col("rank") <= k)
    aggs = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second")]
    for k in ks:
        aggs += [F.count(F.when(at(k), 1)).alias(f"_n{k}"), F.sum(F.when(at(k), 1 / F.log2(F.col("rank") + 1.0))).alias(f"_dcg{k}")]
    got = marked.groupBy("query_id").agg(*aggs)
    out = queries.join(n_rel, "query_id", "left").join(got, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols = {
        "rr": zero(1.0 / F.col("first_hit")),
        "first_hit_rank": F.coalesce("first_hit", F.lit(0)),
        "top1_score": zero(F.col("top1_score")),
        "score_gap": zero(F.col("top1_score") - F.col("_second")),
    }
    for k in ks:
        n = F.coalesce(f"_n{k}", F.lit(0))
        best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_rel", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
        cols |= {
            f"recall_{k}": (n > 0).cast("double"),
            f"full_recall_{k}": F.when(F.col("n_rel") > 0, n / F.col("n_rel")).otherwise(F.lit(0.0)),
            f"precision_{k}": n / F.lit(k),
            f"ndcg_{k}": F.when(F.col("n_rel") > 0, zero(F.col(f"_dcg{k}")) / best).otherwise(F.lit(0.0)),
        }
    return out.select(*queries.columns, "n_rel", *[c.alias(n) for n, c in cols.items()])


def averaged(metrics: DataFrame, dims: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Macro averages, overall and by each dimension, in one pass: dim, value, n, names..."""
    sets = [[]] + [[d] for d in dims]
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in names]]
    grouped = metrics.groupingSets(sets, *dims).agg(*aggs, F.grouping_id(*dims).alias("_g")) if dims else metrics.agg(*aggs, F.lit(0).alias("_g"))
    n = len(dims)
    dim, value = F.lit("overall"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        one = F.col("_g") == (2**n - 1) - 2 ** (n - 1 - i)
        dim, value = F.when(one, d).otherwise(dim), F.when(one, F.col(d).cast("string")).otherwise(value)
    return grouped.select(dim.alias("dim"), value.alias("value"), "n", *names)


def failure_bucket(first_hit: Column) -> Column:
    return F.when((first_hit > 0) & (first_hit <= 5), "top5").when((first_hit > 5) & (first_hit <= 20), "6-20").otherwise("beyond_20")


def collapse_to_docs(hits: DataFrame, doc: Column) -> DataFrame:
    """Hits per document: the best of its chunks, ranked anew."""
    best = hits.withColumn("doc", doc).groupBy("query_id", "doc").agg(F.min(F.struct("rank", "score")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.rank")
    return best.select("query_id", F.col("doc").alias("id"), F.row_number().over(w).alias("rank"), F.col("b.score").alias("score"))


# Vocabulary


def vocabulary(docs: DataFrame, id_col: str, kind_col: str, tokens: Column, query_df: DataFrame, threshold: float = 0.35, spread: float = 0.15) -> DataFrame:
    """term, df, ratio, type_std (over all kinds, also those without the term), query_count, verdict."""
    base = docs.select(F.col(id_col).alias("id"), F.col(kind_col).alias("kind"), F.array_distinct(tokens).alias("tokens"))
    totals = base.groupBy("kind").agg(F.count("*").alias("total"))
    counts = base.select("kind", F.explode_outer("tokens").alias("term")).where("term is not null").groupBy("term", "kind").agg(F.count("*").alias("n"))
    sums = totals.agg(F.sum("total").alias("n_all"), F.count("*").alias("n_kinds"))
    rated = counts.join(F.broadcast(totals), "kind").withColumn("r", F.col("n") / F.col("total"))  # a row per kind of document
    per = rated.groupBy("term").agg(F.sum("n").alias("df"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2")).crossJoin(F.broadcast(sums))
    mean = F.col("s1") / F.col("n_kinds")
    std = F.sqrt(F.greatest(F.col("s2") / F.col("n_kinds") - mean * mean, F.lit(0.0)))
    out = per.select("term", "df", (F.col("df") / F.col("n_all")).alias("ratio"), std.alias("type_std")).join(query_df, "term", "left").withColumn("query_count", F.coalesce("query_count", F.lit(0)))
    common = F.col("ratio") >= threshold
    verdict = F.when(common & (F.round("type_std", 9) < spread) & (F.col("query_count") <= 2), "drop").when(common & (F.col("query_count") > 2), "keep_queried").when(common, "keep_typed").otherwise("keep")
    return out.withColumn("verdict", verdict)


def typical_terms(docs: DataFrame, id_col: str, kind_col: str, tokens: Column, k: int = 8) -> DataFrame:
    """The k terms of each kind most over-represented in it (10 texts, 15 %, 3 times the rest)."""
    base = docs.select(F.col(kind_col).alias("kind"), F.array_distinct(tokens).alias("tokens"))
    totals = base.groupBy("kind").agg(F.count("*").alias("total"))
    counts = base.select("kind", F.explode_outer("tokens").alias("term")).where("term is not null").groupBy("term", "kind").agg(F.count("*").alias("n"))
    alls = totals.agg(F.sum("total").alias("n_all"))
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    big = counts.where("n >= 10").join(df, "term").join(F.broadcast(totals), "kind").crossJoin(F.broadcast(alls))
    rest = F.col("n_all") - F.col("total")
    big = big.withColumn("in_ratio", F.col("n") / F.col("total")).withColumn("out_ratio", F.when(rest > 0, (F.col("df") - F.col("n")) / rest).otherwise(F.lit(0.0)))
    big = big.where((F.col("in_ratio") > 0.15) & (F.col("in_ratio") > F.col("out_ratio") * 3))
    w = Window.partitionBy("kind").orderBy(F.round(F.col("in_ratio") - F.col("out_ratio"), 9).desc(), F.col("term").desc())
    return big.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("kind", "rank", "term", F.round("in_ratio", 6).alias("in_ratio"))
