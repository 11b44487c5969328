"""Queries pN_ of the problems of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.llm import leak, lines, neardup, residue, split, tokens
from gyeol.sources.tables import table


def _parsable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bank_documents").where("is_parsable").select("doc_id", "text", "structure")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.units_found(_parsable(spark, d), "doc_id").select(F.col("id").alias("doc_id"), "unit_no").distinct()


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document with a text, also of those that aren't parsable."""
    return split.split_documents(table(spark, d, "bank_documents").select("doc_id", "text", "structure"), "doc_id")


def _positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return lines.repeated_blocks(table(spark, d, "chunks"), "chunk_id", "doc_id", "text", lines.source_key(F.col("doc_type"), F.col("category")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.covered(_positions(spark, d)[0]).where("id is not null").select(F.col("id").alias("chunk_id"), "line_no").distinct()


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks of each length span enough documents of their source, of those that are the longest at some line."""
    source = F.split("src", "\x1f")
    b = _positions(spark, d)[1].withColumn("doc_type", F.nullif(source[0], F.lit("\x00"))).withColumn("category", F.nullif(source[1], F.lit("\x00")))
    return b.groupBy("doc_type", "category", "block_lines").agg(F.count("*").alias("n_blocks"), F.max("n_docs").alias("most_docs"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated(table(spark, d, "chunks"), "chunk_id", "text", _positions(spark, d)[0])


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, d, "chunks"), "chunk_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs().select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "chunk_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both tables under common columns; chunk rows are made one per chunk_id later. Rows without
    id are each a text of their own, told apart by `row`."""
    c = table(spark, d, "chunks").select(F.lit("chunks").alias("origin"), F.col("chunk_id").alias("text_id"), F.col("doc_type").alias("source"), tokens.language(F.col("lang")).alias("lang"), F.col("category").alias("domain"), F.col("loaded_at").alias("at"), "text")
    x = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("text_id"), "source", tokens.language(F.col("lang")).alias("lang"), "domain", F.col("collected_at").alias("at"), "text")
    return c.unionByName(x).withColumn("row", F.when(F.col("text_id").isNull(), F.monotonically_increasing_id()))


def p6_tokens(spark: SparkSession, d: str) -> DataFrame:
    """origin, text_id, source, lang, domain, n_chars, n_tokens: one row per text, each chunk_id
    counted once, by its row loaded last."""
    rows = tokens.token_counts(_texts(spark, d), ["origin", "text_id", "row", "source", "lang", "domain", "at"])
    last = rows.groupBy("origin", "text_id", "row").agg(F.max(F.struct("at", "n_chars", "n_tokens", "source", "lang", "domain")).alias("r"))
    return last.select("origin", "text_id", "r.source", "r.lang", "r.domain", "r.n_chars", "r.n_tokens")


def p6_budget(spark: SparkSession, d: str) -> DataFrame:
    """Totals per origin, source (doc_type for chunks), language and domain (category for chunks)."""
    return (
        p6_tokens(spark, d)
        .groupBy("origin", "source", "lang", "domain")
        .agg(F.count("*").alias("n_texts"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items")).select("doc_id", "item_id")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names of products (in the titles of documents, or their subtitles) and of banks."""
    b = table(spark, d, "bank_documents").where("doc_type != 'FAQ'")
    quoted, guide = F.regexp_extract("title", "『([^』]+)』", 1), F.regexp_extract("title", "^(.+) product guide$", 1)
    products = b.select(F.explode(F.array(quoted, guide, "subtitle")).alias("name"))
    banks = table(spark, d, "faq_records").select(F.col("bank_name").alias("name"))
    return products.union(banks).where("length(trim(name)) > 1").distinct()


def p8_reworded(spark: SparkSession, d: str) -> DataFrame:
    return leak.reworded_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), names=_names(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents").where(F.col("doc_id").isNotNull()), "doc_id").select("doc_id").distinct()


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = residue.residue(table(spark, d, "documents"), "doc_id")
    return found.groupBy("kind").agg(F.count("*").alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_chunks": p1_chunks,
        "p3_found": p3_found, "p3_blocks": p3_blocks, "p3_clean": p3_clean,
        "p5_found": p5_found, "p5_groups": p5_groups,
        "p6_budget": p6_budget, "p6_tokens": p6_tokens,
        "p7_ids": p7_ids,
        "p8_found": p8_found, "p8_reworded": p8_reworded,
        "p9_found": p9_found, "p9_kinds": p9_kinds,
    }


P3_LINES = """
lines AS (
  SELECT chunk_id, doc_id, text, doc_type AS t, category AS c, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM chunks WHERE text IS NOT NULL),
keyed AS (SELECT *, regexp_replace(lower(nfc_normalize(line)), '[^\\p{L}]', '', 'g') AS k FROM lines),
docs AS (SELECT doc_type AS t, category AS c, count(DISTINCT doc_id) AS n FROM chunks GROUP BY 1, 2),
often AS (
  SELECT keyed.t, keyed.c, k FROM keyed JOIN docs ON keyed.t IS NOT DISTINCT FROM docs.t AND keyed.c IS NOT DISTINCT FROM docs.c WHERE length(k) >= 12
  GROUP BY keyed.t, keyed.c, k, n HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 10 >= n),
hit AS (
  SELECT DISTINCT chunk_id, text, line_no FROM keyed JOIN often
  ON keyed.t IS NOT DISTINCT FROM often.t AND keyed.c IS NOT DISTINCT FROM often.c AND keyed.k = often.k)
"""

P3_BLOCKS = f"""
WITH {P3_LINES},
counting AS (
  SELECT DISTINCT chunk_id, text, doc_id, t, c, k, line_no FROM keyed WHERE length(k) >= 12),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id, text, doc_id, t, c ORDER BY line_no) AS p FROM counting),
kept AS (
  SELECT placed.*, p - row_number() OVER (PARTITION BY chunk_id, text, doc_id, placed.t, placed.c ORDER BY p) AS run
  FROM placed SEMI JOIN often ON placed.t IS NOT DISTINCT FROM often.t AND placed.c IS NOT DISTINCT FROM often.c AND placed.k = often.k),
suffix AS (
  SELECT chunk_id, text, doc_id, t, c, p,
         list(k) OVER (PARTITION BY chunk_id, text, doc_id, t, c, run ORDER BY p ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS s FROM kept),
prefix AS (SELECT *, unnest(generate_series(1, len(s))) AS m FROM suffix),
named AS (SELECT chunk_id, text, doc_id, t, c, p, m, s[1:m] AS b FROM prefix),
counts AS (SELECT t, c, b, count(DISTINCT doc_id) AS docs_of FROM named GROUP BY ALL),
spans AS (
  SELECT counts.* FROM counts JOIN docs ON counts.t IS NOT DISTINCT FROM docs.t AND counts.c IS NOT DISTINCT FROM docs.c
  WHERE docs_of >= 4 AND docs_of * 10 >= n),
longest AS (
  SELECT named.t, named.c, max(m) AS m, arg_max(named.b, m) AS b, arg_max(docs_of, m) AS docs_of
  FROM named JOIN spans ON named.t IS NOT DISTINCT FROM spans.t AND named.c IS NOT DISTINCT FROM spans.c AND named.b = spans.b
  GROUP BY chunk_id, text, doc_id, named.t, named.c, p)
SELECT t AS doc_type, c AS category, m::INT AS block_lines, count(DISTINCT b) AS n_blocks, max(docs_of) AS most_docs
FROM longest GROUP BY t, c, m
"""

P3_CLEAN = f"""
WITH {P3_LINES},
marked AS (
  SELECT DISTINCT l.chunk_id, l.text, l.line_no, l.line, h.line_no IS NOT NULL AS gone
  FROM lines l LEFT JOIN hit h ON l.chunk_id IS NOT DISTINCT FROM h.chunk_id AND l.text = h.text AND l.line_no = h.line_no)
SELECT chunk_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text, count(*) FILTER (gone)::INT AS n_removed
FROM marked GROUP BY chunk_id, marked.text
UNION ALL SELECT DISTINCT chunk_id, NULL, 0 FROM chunks WHERE text IS NULL
"""


_W = r"[\s\p{Z}\x0b\x{85}]"
_DIGITS = rf"[0-9０-９]({_W}*[0-9０-９])*"
_HEADS = {
    "article": rf"제{_W}*{_DIGITS}{_W}*조{_W}*(?:의{_W}*{_DIGITS}{_W}*)?[(（\[［{{｛<＜〈《「『【〔〖〘⟨⟪].*?[)）\]］}}｝>＞〉》」』】〕〗〙⟩⟫]",
    "clause": "[①-⑳⓪-⓴⓵-⓾❶-➓㉑-㉟㊱-㊿]",
    "numbered": rf"[0-9]{{1,2}}[.)]{_W}",
    "qa_pair": r"[QA]\.",
}
_TEXT = r"[^\s\p{Z}\x0b\x{85}]"
P1_UNITS = rf"""
d AS (
  SELECT doc_id, text, is_parsable, CASE WHEN lower(trim(structure)) IN ('article', 'clause', 'numbered', 'qa_pair') THEN lower(trim(structure)) ELSE 'flat' END AS kind
  FROM bank_documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, is_parsable, kind, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
m AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, CASE kind
    {' '.join(f"WHEN '{k}' THEN regexp_matches(line, '^{_W}*{h}')" for k, h in _HEADS.items())}
    ELSE regexp_matches(line, '{_TEXT}') AND coalesce(NOT regexp_matches(lag(line) OVER w, '{_TEXT}'), true) END AS opens
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS unit_no FROM m),
r AS (SELECT doc_id, any_value(is_parsable) AS is_parsable, any_value(kind) AS kind, unit_no::INT AS unit_no, min(off) AS off, string_agg(line, chr(10) ORDER BY i) AS raw FROM n GROUP BY doc_id, unit_no),
u AS (SELECT *, regexp_replace(raw, '^{_W}+|{_W}+$', '', 'g') AS t, off + length(raw) - length(regexp_replace(raw, '^{_W}+', '')) AS start FROM r)
"""
P1_FOUND = f"WITH {P1_UNITS} SELECT doc_id, unit_no FROM u WHERE is_parsable AND length(t) > 900"
# a cut depends on its own cell of the grid only: goal 600 j + 220, the 220 characters before it
P1_CHUNKS = rf"""
WITH {P1_UNITS},
g AS (
  SELECT doc_id, unit_no, start, t, length(t) AS n,
    CASE WHEN unit_no = 0 THEN '' ELSE regexp_replace(CASE kind {' '.join(f"WHEN '{k}' THEN regexp_extract(t, '^({h})', 1)" for k, h in _HEADS.items())} ELSE '' END, '{_W}+$', '') END AS section,
    unnest(generate_series(0, length(t) // 600 + 2)) AS j FROM u WHERE t <> ''),
c AS (
  SELECT *, 600 * j AS lo, 600 * j + 220 AS goal, substr(t, (600 * j + 1)::BIGINT, 221) AS win, substr(t, (600 * j + 2)::BIGINT, 219) AS inner_win FROM g),
k AS (
  SELECT *, CASE WHEN j = 0 THEN 0
    WHEN regexp_matches(win, '(?s)[.!?。…]["''”’)\]』」】]*\s') THEN lo + length(regexp_extract(win, '(?s)^(.*[.!?。…]["''”’)\]』」】]*)\s', 1))
    WHEN contains(inner_win, chr(10)) THEN lo + 2 + length(regexp_extract(inner_win, '(?s)^(.*)\n', 1))
    WHEN contains(inner_win, ' ') THEN lo + 2 + length(regexp_extract(inner_win, '(?s)^(.*) ', 1))
    ELSE goal END AS cut FROM c),
p AS (
  SELECT *, n - (cut - CASE WHEN j > 0 THEN 80 ELSE 0 END) > 900 AS more, lead(cut) OVER w AS next_cut, lag(n - (cut - CASE WHEN j > 0 THEN 80 ELSE 0 END) > 900) OVER w AS before
  FROM k WINDOW w AS (PARTITION BY doc_id, unit_no ORDER BY j)),
q AS (SELECT *, CASE WHEN j > 0 THEN cut - 80 ELSE 0 END AS a, CASE WHEN more THEN next_cut ELSE n END AS b FROM p WHERE j = 0 OR before)
SELECT doc_id, unit_no, j::INT AS piece_no, (start + a)::BIGINT AS start, section, substr(t, (a + 1)::BIGINT, (b - a)::BIGINT) AS text FROM q
"""

P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
t AS (SELECT item_id, regexp_replace(lower(nfc_normalize(passage)), '[^\p{L}\p{N}]', '', 'g') AS s FROM eval_items WHERE passage IS NOT NULL),
g AS (SELECT DISTINCT item_id, substr(s, i, 50) AS run FROM (SELECT item_id, s, unnest(generate_series(1, length(s) - 49)) AS i FROM t)),
x AS (SELECT doc_id, substr(s, i, 50) AS run FROM (SELECT doc_id, s, unnest(generate_series(1, length(s) - 49)) AS i FROM d))
SELECT DISTINCT doc_id, item_id FROM x JOIN g USING (run)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_chunks": P1_CHUNKS,
        "p8_found": P8_FOUND,
        "p3_found": f"WITH {P3_LINES} SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM hit WHERE chunk_id IS NOT NULL",
        "p3_blocks": P3_BLOCKS,
        "p3_clean": P3_CLEAN,
    }
