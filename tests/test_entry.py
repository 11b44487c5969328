"""The driver's contract, also without the subpackage llm."""

from __future__ import annotations

import importlib.util

import __spark_entry__ as e


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    llm = importlib.util.find_spec("gyeol.llm") is not None and importlib.util.find_spec("gyeol.llm.queries") is not None
    assert ("p5_found" in q) == llm and "p2_found" in q and "p4_found" in q


def test_llm_is_not_imported_elsewhere():
    import pathlib

    root = pathlib.Path(e.__file__).parent / "gyeol"
    assert not [p for p in root.rglob("*.py") if root / "llm" not in p.parents and "gyeol.llm" in p.read_text()]
