"""Every query with SQL against DuckDB on the smallest tables, and those without for running at all."""

import pytest

import tessella.plans as plans
import verify

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    said = verify.compare(spark, SF, name)
    assert said.startswith("same" if name in plans.SQL else "rows"), said


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["request_id", "doc_id", "hits", "score", "rank"]
