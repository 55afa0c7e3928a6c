"""The driver's contract, and that nothing else needs the optional subpackage."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_query_is_callable_and_sql_belongs_to_one():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "language", "ratio", "is_english"]


def test_core_does_not_import_the_subpackage():
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quire\.llm|from quire import .*llm", path.read_text()), path


def test_scans_read_only_what_is_needed(spark):
    for name in ("provider_counts", "state_counts", "unit_totals"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "source_text" not in plan and "PushedFilters: [IsNotNull(id)" in plan
