import pytest
from helpers import SF, executed_plan

import __spark_entry__ as contract
from workload.catalog import CATALOG, spark_query
from workload.column_kinds import DATE_COLUMNS, FLOAT_COLUMNS
from workload.domain import domain_for
from workload.verify import compare, duck, rows_of

QUERIES, SQL = contract.queries(), contract.oracle_sql()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["mag_bin", "n_events", "n_cumulative", "log10_n_cumulative"] and df.count() > 0


def test_every_query_of_the_catalogue_has_sql():
    assert set(CATALOG) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    fields = CATALOG[name].run(domain_for(spark, SF)).schema.fields
    for kind, listed in (("double", FLOAT_COLUMNS), ("date", DATE_COLUMNS)):
        assert [f.name for f in fields if f.dataType.simpleString() == kind] == listed.get(name, "").split()
    found = duck(SF).execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    problem = compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, found.fetchall()))
    assert problem == "" or problem.startswith("CLOSE"), problem
    plan = executed_plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from workload.domain import Driver

    plan = executed_plan(Driver(spark, SF)["lineitem"].filter("l_quantity > 49").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_queries_share_staged_tables(spark):
    spark_query(CATALOG["g11_quakes_near_city"])(spark, SF)
    df = spark_query(CATALOG["g9_b_value"])(spark, SF)
    assert all("/silver_earthquakes/" in f for f in df.inputFiles())
    assert "GreaterThanOrEqual(magnitude,4.5)" in executed_plan(df)


@pytest.mark.parametrize("name", ["a3_count_distinct", "a11_value_at_extreme", "a12_any_value", "g14_bird_daily", "g20_cyclones", "g26_month_panel"])
def test_no_row_is_copied_or_sorted_for_an_aggregate(spark, name):
    plan = executed_plan(CATALOG[name].run(domain_for(spark, SF)))
    assert "Expand" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["a7_quantiles", "a8_median", "g7_heat_threshold_drift"])
def test_quantiles_hold_no_key_in_one_buffer(spark, name):
    assert " percentile(" not in executed_plan(CATALOG[name].run(domain_for(spark, SF)))
