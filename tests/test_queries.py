"""Every registered query against DuckDB on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from chartweave import driver_queries
from tests.oracle import compare, duck

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
# Whole-export jobs; set ALL_QUERIES=1 to run them too.
HEAVY = ("fhir_round_trip", "fhir_export_counts", "ccda_clinical", "ccda_encounters", "ccda_observations", "ccda_leftover_sections", "ccda_patients", "sql_dump_rows", "chart_text", "archive_index", "script_lines", "vitals_flowsheet", "bundle_json_size")
# The text operators have tests of their own in tests/llm.
QUERIES = {n: q for n, q in entry.queries().items() if n in driver_queries.QUERIES}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}
NAMES = [n for n in QUERIES if os.environ.get("ALL_QUERIES") or n not in HEAVY]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, n, _, note = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, note


def test_names_and_columns():
    assert set(SQL) <= set(QUERIES)
    assert len(set(QUERIES) - set(SQL)) <= 5


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "name", "encounter_count", "latest_visit", "worst_verdict"] and df.count() > 0
