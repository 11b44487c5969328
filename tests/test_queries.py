"""Every query of the core against its SQL, and their plans."""

from __future__ import annotations

import contextlib
import io

import pytest

from gyeol.plans import registry
from gyeol.streaming import ingest
from tests.compare import connect, differences
from tests.conftest import SMALL

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    """Equal to its SQL, and no cartesian product in its plan; built once for both."""
    built = registry.queries()[name](spark, SMALL)
    assert name.startswith("stream") or "CartesianProduct" not in plan(built)
    n, why = differences(spark, con, lambda s, d: built, registry.oracle_sql().get(name), SMALL)
    assert not why, why


def test_sql_names_are_queries():
    assert set(registry.oracle_sql()) <= set(NAMES)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(registry.queries()["dq_duplicates"](spark, SMALL))
    assert "PushedFilters: [" in p and "EqualTo(is_parsable,true)" in p and "ReadSchema: struct<doc_id:string,doc_type:string,content_hash:string,is_parsable:boolean,orig_filename:string>" in p


def test_only_needed_columns_are_read(spark):
    p = plan(registry.queries()["chunk_stats"](spark, SMALL))
    assert "ReadSchema: struct<chunk_id:string,text:string,doc_type:string,loaded_at:timestamp_ntz>" in p


def test_top_k_is_limited_before_its_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.queries()["bm25_top10"](spark, SMALL))


def test_stream_sees_new_files_only_once(spark, tmp_path):
    rows = [("q1", "a1"), ("q2", "a2")]
    df = spark.createDataFrame(rows, "question string, answer string")
    df.write.parquet(str(tmp_path / "faq_records.parquet"))
    s = ingest.new_faq(ingest.file_stream(spark, str(tmp_path), "faq_records"))
    assert ingest.run_to_table(s, "t").count() == 2
