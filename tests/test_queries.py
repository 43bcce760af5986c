"""Each query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pagemill.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["numeric_conflicts", "references", "requirement_matrix", "ambiguities", "clean_pages", "chunk_documents", "retrieve", "dedupe_facts", "merge_entities", "entity_conflicts", "access_scope", "rate_limit", "stream_window_counts", "context_head", "payload_defaults", "stream_sessions", "explained_conflicts", "merged_contradictions", "parsed_blobs", "parsed_files", "semantic_conflicts", "contradiction_findings", "chunk_windows", "prompt_batches", "chunk_long_documents", "source_prompts", "listed_payloads", "stream_stages", "chunk_pair_candidates"]


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v != v:
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) else str(v)


def rows(frame):
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_registry():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


def test_review_report_reads_written_findings(spark):
    """References, disagreements and vague words are found once: deductions and lists read what was written."""
    files = QUERIES["review_report"](spark, SF).inputFiles()
    assert all(any(f"/{kind}-" in f for f in files) for kind in ("references", "entity-conflicts", "ambiguities"))
