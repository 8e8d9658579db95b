"""Every registered query against its SQL text in another engine, on the smallest tables."""

import glob
import os
import re

import pytest

import __spark_entry__ as contract
from tidelag.plans.oracle import sql_texts
from tidelag.plans.queries import registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def normal(records):
    return sorted(records, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_sql():
    assert set(registered()) == set(sql_texts())
    assert set(registered()) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = sql.sql(contract.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    want = relation.select(*[f'"{c}"' for c in columns]).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got, "the query should not be empty"
    assert normal(got) == normal(want)


def test_last_values_of_a_topic_fold_before_their_shuffle(spark, tmp_path):
    """Snapshots of a topic are brought together first, so the rows shuffled by label set are few."""
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 700 as int), 0, 0) as ts"
    spark.range(3000).selectExpr("id as event_id", at, "id % 7 as user_id", "element_at(array('click', 'view', 'signup'), cast(id % 3 as int) + 1) as event_type", "double(id % 5) as value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2000).selectExpr("id as l_orderkey", "id % 60 as l_partkey", "id % 4 as l_suppkey", "cast(id % 5 as int) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registered()["gauge_last_value"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    brought = r"Exchange hashpartitioning\(cluster#\d+, grp#\d+, topic#\d+, \d+\)"
    assert re.search(brought, plan) and re.search(brought, plan).start() > plan.index("Generate explode")
    lags = registered()["lag_replay"](spark, str(tmp_path)).collect()
    sums = {}
    for r in lags:
        if r.lag_off is not None:
            key = (r.cluster, r.grp, r.topic)
            sums.setdefault(key, {}).setdefault(r.snapshot_ms, []).append(r.lag_off)
    got = {r.labels: (r.value, r.at_ms) for r in df.where("name like '%sum_lag_in_offsets'").collect()}
    want = {f"clustername={c},group={g},topic={t}": (float(sum(by[max(by)])), max(by)) for (c, g, t), by in sums.items()}
    assert got == want and want


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["cluster", "grp", "max_off", "max_s", "sum_off", "sum_s"]
    assert df.count() > 0


def test_time_zone_of_the_session_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    names = ["latest_offsets", "health_by_hour"]
    want = {n: normal(tuple(r) for r in contract.queries()[n](spark, SF).collect()) for n in names}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for n in names:
            assert normal(tuple(r) for r in contract.queries()[n](spark, SF).collect()) == want[n]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", sorted(registered()))
def test_plan_has_no_nested_loop_and_no_python(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert slow not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = contract.queries()["time_lag"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan
    assert "l_extendedprice" not in plan and "props" not in plan
