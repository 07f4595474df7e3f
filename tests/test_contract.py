import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["kis_pipeline", "rrf_weighted", "evidence_windows", "manifest_issues", "p3_found"])
def test_queries_run_on_the_smallest_tables(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "index_row", "raw_rank", "final_rank"]
