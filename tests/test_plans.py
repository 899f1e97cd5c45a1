"""What the planner makes of the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from observatory.operators import chains, ranking, rollups, segmented, spatial
from observatory.sources import readers, rules, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_predicates_and_columns_are_pushed(spark, out_dir):
    path = f"{out_dir}/s"
    spark.range(10).select(
        F.lit("open").alias("coordinate_status"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit("x" * 50).alias("raw_json")
    ).write.parquet(path)
    p = plan(readers.read_open_sightings(spark, path).select("lon"))
    assert "EqualTo(coordinate_status,open)" in p and "IsNotNull(lon)" in p
    assert "raw_json" not in p.split("ReadSchema")[1]


def test_top_k_is_limited_below_the_exchange(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    p = plan(ranking.top_k(df, ["k"], [F.desc("id")], 5, "rank"))
    assert p.count("WindowGroupLimit") == 2
    assert p.index("Final") < p.index("Exchange") < p.index("Partial")


def test_keyed_replacement_combines_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    p = plan(sinks.latest_by_key(df, ["k"], [F.col("id")]))
    assert p.count("Aggregate") == 2 and p.count("Exchange") == 1


def test_summary_of_a_park_is_one_exchange(spark):
    df = spark.createDataFrame([("p", "a", "b", "open", None, dt.date(2024, 1, 1))], "park string, source string, taxon_class string, coordinate_status string, duplicate_of string, observed_on date")
    assert plan(rollups.park_summary(df)).count("Exchange") == 1


def test_small_rules_broadcast_without_a_hint(spark):
    ddl = "park string, scientific_name string, raw_json string, source string"
    from observatory.operators import suppress

    df = spark.createDataFrame([("p", "Canis lupus", "{}", "gbif")], ddl)
    p = plan(suppress.name_lookup(df, rules.suppression_rules(spark), {}))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_distance_join_is_an_equi_join(spark):
    pts = spark.range(50).select("id", (F.col("id") * 0.001).alias("lon"), (F.col("id") * 0.001).alias("lat"))
    other = pts.select(F.col("id").alias("rid"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    p = plan(spatial.distance_join(pts, other, 500.0))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_one_key_with_most_rows_is_still_many_tasks(spark):
    """Chains of a single sequence: no exchange partitions by the key alone before the rows are reduced."""
    frames = spark.range(1000).select(
        F.lit("s").alias("k"), (F.col("id") * 1_000_000).alias("ts_us"), "id", F.lit(-110.0).alias("lon"), F.lit(44.9).alias("lat")
    )
    out = segmented.running_total(frames.withColumn("seg", F.floor(F.col("id") / 10)), ["k"], "seg", ["id"], F.lit(1))
    exchanges = [x for x in plan(out).splitlines() if "Exchange hashpartitioning" in x]
    rows_side = [x for x in exchanges if "seg" in x]
    assert len(rows_side) >= 2
    chained = chains.mark_chains(frames, ["k"], ["ts_us", "id"], segment_s=60.0)
    assert chained.agg(F.max("chain")).collect()[0][0] == 1
