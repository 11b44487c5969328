"""Queries of the general data operators: attribute history (p2) and snapshot differences (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.operators.history import bitemporal_ledger, versions
from gyeol.operators.snapshots import snapshot_changes
from gyeol.sources.tables import table

STATE = ("effective_date", "compliance_no", "is_latest", "superseded_by")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "document_updates")
    u = u.withColumn("compliance_no", F.nullif(F.regexp_replace("compliance_no", r"(?U)\s+", ""), F.lit("")))
    u = u.withColumn("superseded_by", F.nullif(F.col("superseded_by"), F.lit("")))
    return bitemporal_ledger(u, "doc_id", "as_of", "received_at", STATE, tie="update_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    v = versions(_ledger(spark, d), "doc_id", STATE)
    return v.select("doc_id", "version_no", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions(_ledger(spark, d), "doc_id", STATE)


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "registry_snapshots")
    stripped = F.regexp_replace(F.col("content_hash"), r"(?U)^\s+|\s+$", "")
    return snapshot_changes(s, "snapshot_no", "doc_id", {"h": F.lower(stripped), "f": F.col("orig_filename")}, "delivered_at", tie=("parsed_at",))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_docs"))


P2_STATES = """
last AS (
  SELECT * FROM (
    SELECT doc_id, as_of, effective_date, nullif(regexp_replace(compliance_no, '[\\s\\p{Z}\\x0b\\x{85}]+', '', 'g'), '') AS compliance_no,
           is_latest, nullif(superseded_by, '') AS superseded_by,
           row_number() OVER (PARTITION BY doc_id, as_of ORDER BY received_at DESC NULLS LAST, update_id DESC) AS rn
    FROM document_updates WHERE doc_id IS NOT NULL AND as_of IS NOT NULL) WHERE rn = 1),
marked AS (
  SELECT *, row_number() OVER w AS i,
         coalesce(lag(effective_date) OVER w IS NOT DISTINCT FROM effective_date
         AND lag(compliance_no) OVER w IS NOT DISTINCT FROM compliance_no
         AND lag(is_latest) OVER w IS NOT DISTINCT FROM is_latest
         AND lag(superseded_by) OVER w IS NOT DISTINCT FROM superseded_by, false) AS same
  FROM last WINDOW w AS (PARTITION BY doc_id ORDER BY as_of)),
starts AS (SELECT * FROM marked WHERE i = 1 OR NOT same),
v AS (
  SELECT *, row_number() OVER w AS version_no, as_of AS valid_from,
         coalesce(lead(as_of) OVER w, DATE '9999-12-31') AS valid_to
  FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY as_of))
"""

P2_LEDGER = """
WITH u AS (
  SELECT * EXCLUDE rn FROM (
    SELECT doc_id, as_of::DATE AS d, coalesce(received_at::TIMESTAMP, TIMESTAMP '1970-01-01') AS r, effective_date, nullif(regexp_replace(compliance_no, '[\\s\\p{Z}\\x0b\\x{85}]+', '', 'g'), '') AS compliance_no,
           is_latest, nullif(superseded_by, '') AS superseded_by,
           row_number() OVER (PARTITION BY doc_id, as_of, coalesce(received_at::TIMESTAMP, TIMESTAMP '1970-01-01') ORDER BY update_id DESC) AS rn
    FROM document_updates WHERE doc_id IS NOT NULL AND as_of IS NOT NULL) WHERE rn = 1),
since AS (SELECT doc_id, d, min(r) AS known FROM u GROUP BY 1, 2),
seen AS (SELECT s.doc_id, s.d, p.r FROM since s JOIN (SELECT DISTINCT doc_id, r FROM u) p ON s.doc_id = p.doc_id AND p.r >= s.known),
state AS (
  SELECT seen.doc_id, seen.d, seen.r, arg_max({'e': u.effective_date, 'c': u.compliance_no, 'l': u.is_latest, 's': u.superseded_by}, u.r) AS st
  FROM seen JOIN u ON seen.doc_id = u.doc_id AND seen.d = u.d AND u.r <= seen.r GROUP BY 1, 2, 3),
bound AS (
  SELECT seen.doc_id, seen.d, seen.r, min(s.d) AS vto FROM seen LEFT JOIN since s ON seen.doc_id = s.doc_id AND s.d > seen.d AND s.known <= seen.r GROUP BY 1, 2, 3),
cells AS (SELECT doc_id, d, r, st, coalesce(vto, DATE '9999-12-31') AS vto FROM state JOIN bound USING (doc_id, d, r)),
starts AS (
  SELECT * FROM (
    SELECT *, lag(r) OVER w IS NULL OR lag(st) OVER w IS DISTINCT FROM st OR lag(vto) OVER w <> vto AS new FROM cells WINDOW w AS (PARTITION BY doc_id, d ORDER BY r)) WHERE new)
SELECT doc_id, st.e AS effective_date, st.c AS compliance_no, st.l AS is_latest, st.s AS superseded_by, d AS valid_from, vto AS valid_to, r AS recorded_from,
       lead(r) OVER (PARTITION BY doc_id, d ORDER BY r) AS recorded_to
FROM starts
"""

P4_CHANGES = """
last AS (
  SELECT * FROM (
    SELECT snapshot_no, doc_id, lower(regexp_replace(content_hash, '^[\\s\\p{Z}\\x0b\\x{85}]+|[\\s\\p{Z}\\x0b\\x{85}]+$', '', 'g')) AS h, orig_filename AS f,
           row_number() OVER (PARTITION BY snapshot_no, doc_id ORDER BY delivered_at DESC NULLS LAST, parsed_at DESC NULLS LAST) AS rn
    FROM registry_snapshots WHERE snapshot_no IS NOT NULL AND doc_id IS NOT NULL) WHERE rn = 1),
steps AS (SELECT snapshot_no AS cur, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM last)),
cur AS (SELECT s.cur AS snapshot_no, l.doc_id, l.h, l.f FROM steps s JOIN last l ON l.snapshot_no = s.cur WHERE s.prev IS NOT NULL),
prev AS (SELECT s.cur AS snapshot_no, l.doc_id, l.h, l.f FROM steps s JOIN last l ON l.snapshot_no = s.prev),
changes AS (
  SELECT coalesce(c.snapshot_no, p.snapshot_no) AS snapshot_no, coalesce(c.doc_id, p.doc_id) AS doc_id,
         CASE WHEN p.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'removed'
              WHEN c.h IS DISTINCT FROM p.h OR c.f IS DISTINCT FROM p.f THEN 'changed' END AS change_kind
  FROM cur c FULL OUTER JOIN prev p ON c.snapshot_no = p.snapshot_no AND c.doc_id = p.doc_id)
"""

QUERIES = {"p2_found": p2_found, "p2_versions": p2_versions, "p2_ledger": p2_ledger, "p4_found": p4_found, "p4_summary": p4_summary}

SQL = {
    "p2_ledger": P2_LEDGER,
    "p2_found": f"WITH {P2_STATES} SELECT doc_id, version_no::INT AS version_no, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to FROM v",
    "p2_versions": f"WITH {P2_STATES} SELECT doc_id, version_no::INT AS version_no, effective_date, compliance_no, is_latest, superseded_by, valid_from, valid_to FROM v",
    "p4_found": f"WITH {P4_CHANGES} SELECT snapshot_no, doc_id, change_kind FROM changes WHERE change_kind IS NOT NULL",
    "p4_summary": f"WITH {P4_CHANGES} SELECT snapshot_no, change_kind, count(*) AS n_docs FROM changes WHERE change_kind IS NOT NULL GROUP BY 1, 2",
}
