import re

import pytest
from conftest import DATA, rows_of

from tallyhouse import catalog


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).columns == ["poll_id", "option_id", "votes"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_first_vote_aggregates_by_hash(spark):
    plan = catalog.QUERIES["tally_first_wins"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert "ReadSchema: struct<event_id" in plan.replace("\n", " ") or "event_id" in plan


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_ordered_in_parts(spark):
    """Rows are numbered inside a range of their key, or after each task has kept a few of them."""
    for name in ("batch_pack", "packed_messages"):
        numbered = [line for line in plan_of(spark, name).split("\n") if "row_number()" in line and " Window " in f" {line} "]
        assert numbered and all("_range" in line for line in numbered), name
    limited = plan_of(spark, "issue_limit_query")
    assert "WindowGroupLimit" in limited and "Partial" in limited
    ordered = [line for line in plan_of(spark, "latency_percentiles").split("\n") if re.search(r"windowspecdefinition\([^)]*_v#\d+ ASC", line)]
    assert ordered and all("_range" in line.split("_v#")[0] for line in ordered)


@pytest.mark.parametrize("rows,ranges", [([], 4), ([(1, None)] * 3, 4), ([(k % 3, v) for k in range(300) for v in [k * 7 % 11]], 5), ([(0, i) for i in range(500)], 16)])
def test_places_in_ranges_equal_places_in_order(spark, rows, ranges):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tallyhouse.operators.ordering import placed

    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k long, v long, i long")
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.asc_nulls_first("v"), "i")) - 1)
    assert rows_of(placed(df, ["k"], "v", "i", ranges=ranges).toPandas()) == rows_of(want.toPandas())


def test_percentiles_of_few_and_equal_values(spark):
    from tallyhouse.operators.report import percentiles

    df = spark.createDataFrame([("a", float(i % 4)) for i in range(40)] + [("b", None), ("c", 2.5)] + [(None, float(i)) for i in range(1000)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in percentiles(df, "k", "v", {"lo": 0.0, "mid": 0.5, "hi": 0.99}, ranges=8).collect()}
    assert got == {"a": (40, 0.0, 1.0, 3.0, 3.0), "c": (1, 2.5, 2.5, 2.5, 2.5), None: (1000, 0.0, 499.0, 989.0, 999.0)}
