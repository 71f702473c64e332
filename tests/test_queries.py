import os

import pytest

from terrace import catalogue_queries as Q
from terrace import lifecycle_queries  # noqa: F401
from tests.oracle import same


#: Runs of the whole service that others here cover; ``TERRACE_ALL=1`` adds them.
LONG = {
    "backfill_leaves", "backfill_batches", "backfill_metrics", "unpartition_all", "maintain_listing", "reattach_plan", "drop_after_two_days", "drop_never", "operation_order",
    "plan_create_only", "expire_measured", "pruning_names", "saved_plan", "stream_into_table", "closed_partitions",
}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - (set() if os.environ.get("TERRACE_ALL") else LONG)))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    same(Q.QUERIES[name](spark, sf_dir), duck, Q.SQL[name])


@pytest.mark.parametrize("name", ["uuidv7_decode", "uuidv7_encode", "epoch_codec"])
def test_codecs_on_more_instants(spark, sf_dir, name):
    import duckdb

    folder, con = sf_dir.replace("sf0.001", "sf0.1"), duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    same(Q.QUERIES[name](spark, folder), con, Q.SQL[name])


def test_entry_names():
    import __spark_entry__ as E

    assert set(Q.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert Q.FLAGSHIP in E.queries()
