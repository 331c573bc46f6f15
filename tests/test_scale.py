"""What must hold at any size: no order or layout in results, no Python in hot plans, filters and columns pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from pathloom.operators import encoding, mining, quality
from pathloom.plans.registry import QUERIES
from pathloom.sources import derived as D

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_expressions_stay_in_the_jvm(spark):
    trips = D.trips(spark, SF)
    for df in (quality.features(trips), encoding.segments(encoding.encode(trips, fill=True)), mining.support(mining.km_windows(encoding.segments(encoding.encode(trips))))):
        assert not re.search("Python|Arrow|Pandas", plan(df))


def test_scans_read_the_columns_they_need(spark):
    p = plan(D.supplier_sequences(spark, SF))
    assert "l_comment" not in p and "o_totalprice" not in p and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


def test_filters_reach_the_scan(spark):
    df = D.table(spark, SF, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.count("*"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan(df)


def test_no_cross_joins_of_tables(spark):
    for name in ("seq_window_bands", "closed_ngrams", "jaccard_pairs_exact", "supplier_ngrams", "traj_features"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("parts", ["1", "9"])
def test_results_do_not_depend_on_partitions(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, QUERIES["seq_window_bands"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, QUERIES["seq_window_bands"](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
