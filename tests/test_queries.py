"""Registered queries against their SQL, and the shape of their plans."""

import duckdb
import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries
from catalog import QUERIES

# Predictions of learned trees: SQL cannot know them; the queries of the same name and `_agree` or `_check` compare them.
LEARNED = {"gbt_scores", "lad_leaf_values", "lr_scores"}
CHECKED = sorted(set(QUERIES) - LEARNED)


@pytest.fixture(scope="module")
def connection(tiny):
    db = duckdb.connect()
    for table in check_queries.TABLES:
        db.execute(f"create view {table} as select * from '{tiny}/{table}.parquet'")
    return db


def test_every_query_has_sql():
    assert all(QUERIES[name].sql() for name in CHECKED)
    assert set(QUERIES) <= set(queries()) and set(CHECKED) <= set(oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, tiny, connection, name):
    problem = check_queries.compare(queries()[name](spark, tiny), connection.sql(oracle_sql()[name]))
    assert problem == ""


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_learned_values(spark, tiny, name):
    rows = queries()[name](spark, tiny).collect()
    assert rows and not any(v is None for r in rows for v in r)
    for r in rows:
        if name == "gbt_scores":
            assert r.predicted > 0 and r.predicted == pytest.approx(r.expression, rel=1e-9) and r.predicted == r.loaded
        elif name == "lr_scores":
            assert 0 < r.prob < 1 and r.prob == pytest.approx(r.expression, abs=1e-9)
        else:
            assert r.value == pytest.approx(r.median, abs=1e-9) and r.n > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c_dwell", "a_first_ping", "ab_error_report", "threshold_sweep", "roc_points", "address_floor"])
def test_plans_have_no_cross_join_and_no_python(spark, tiny, name):
    plan = plan_of(queries()[name](spark, tiny))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan


def test_geofence_join_is_sort_merge_on_courier_block_and_cell(spark, tiny):
    plan = plan_of(entry(spark))
    keys = [line.split("SortMergeJoin")[1] for line in plan.splitlines() if "SortMergeJoin" in line]
    assert any(all(k in line for k in ("user_id", "_p_block", "_p_lat_cell", "_p_lng_cell")) for line in keys)


def test_positions_are_sorted_by_one_number(spark, tiny):
    plan = plan_of(queries()["c_dwell"](spark, tiny))
    assert "Sort [_p_place#" in plan and not [line for line in plan.splitlines() if "Sort [_p_place#" in line and "," in line.split("]")[0]]


def test_courier_ids_of_other_types_meet(spark):
    from doorclock.operators import geofence

    columns = "order_id, receiver_id, supplier_id, transporter_id, r_lng, r_lat, s_r_line_distance, finish_time, finish_time_unix, city_id, receiver_address, cargo_type_id, cargo_weight, fetch_time_unix"
    types = dict(zip(columns.split(", "), "long long long int double double double string long long string long double long".split()))
    orders = spark.createDataFrame([(1, 1, 1, 7, 120.008, 30.005, 1.0, "t", 1000, 1, "a", 1, 1.0, 500)], ", ".join(f"{k} {v}" for k, v in types.items()))
    pings = spark.createDataFrame([(7, 30.005, 120.008, 700), (8, 30.005, 120.008, 700), (7, 30.005, 120.008, 9000)], "user_id long, lat double, lng double, log_time long")
    assert [r.report_unixtime for r in geofence.pings_in_circle(orders, pings).collect()] == [700]


def test_durations_are_counted_by_hash_before_medians(spark, tiny):
    plan = plan_of(queries()["courier_peak"](spark, tiny))
    first = plan.index("percentile(")
    assert "HashAggregate(keys=[transporter_id" in plan[first:].replace("ObjectHashAggregate", "")
    assert "delivery_time2" in plan[first:].split("HashAggregate(keys=[transporter_id")[-1]
