"""Plans: building a query runs nothing, filters and columns reach the scan, no vector is exchanged for a search."""

import os

import pytest

from lodestrata.plans import catalogue
from lodestrata.session import input_bytes, spread

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: Queries that run something while they are built: the vector of their question, a bounded set of queries, or a job.
DRIVER = {"vector_topk": 1, "vector_topk_filtered": 1, "vector_topk_threshold": 1, "vector_topk_batch": 1, "retrieve_projection": 1, "render_results_markdown": 1}
JOBS = {"index_incremental", "index_full"}


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - JOBS))
def test_building_a_query_runs_nothing(spark, name, monkeypatch):
    schemas = {}

    def known(s, d, t):  # reading a table's schema is a job of its own
        if t not in schemas:
            schemas[t] = s.read.parquet(f"{d}/{t}.parquet").schema
        return s.read.schema(schemas[t]).parquet(f"{d}/{t}.parquet")

    for t in ("documents", "points", "manifest", "project_config", "search_query"):
        known(spark, DATA, t)
    monkeypatch.setattr(catalogue, "table", known)
    before = jobs(spark)
    catalogue.queries()[name](spark, DATA)
    assert jobs(spark) - before <= DRIVER.get(name, 0)


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.queries()["vector_topk_filtered"](spark, DATA))
    assert "EqualTo(project_id,orchid-core)" in text and text.count("content:string") <= 2
    text = plan(catalogue.queries()["vector_topk_batch"](spark, DATA))
    assert "NestedLoopJoin" not in text and "content" not in text


def test_changed_files_read_no_chunk_columns(spark):
    assert "chunk_ids" not in plan(catalogue.queries()["diff_changed_files"](spark, DATA))


def test_only_small_inputs_are_spread(spark):
    small = spark.read.parquet(f"{DATA}/points.parquet").select("content")
    assert "Exchange" in plan(spread(small)) and 0 < input_bytes(small) < 4 << 20
    assert "Exchange" not in plan(spread(spark.range(1 << 28)))
