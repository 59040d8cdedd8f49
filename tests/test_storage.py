"""Stored tables and how they are joined."""

import pytest
from pyspark.sql import functions as F

from quarrymill import storage
from quarrymill.operators import enrich, graph, matching, run_log
from quarrymill.plans import jobs, record_queries, registry
from quarrymill.storage import stored


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_table_that_is_large_unpacked_is_not_broadcast(spark):
    """A million rows of keys and nulls are a few megabytes of files, of which Spark would make a broadcast of 60 MB."""
    many = stored(spark.range(1_000_000, numPartitions=4).select("id", F.lit(None).cast("string").alias("known")), "many")
    few = stored(spark.range(1000), "few")
    own = spark.range(2_000_000)
    assert "Broadcast" not in plan(own.join(many.withColumnRenamed("id", "x"), F.col("id") == F.col("x"), "left"))
    assert "Broadcast" not in plan(own.join(many.where("known is null").groupBy("id").count(), "id"))
    assert all("BroadcastHashJoin" in plan(x) for x in (own.join(few, "id"), many.join(few, "id"), few.join(many, "id"), many.join(F.broadcast(few), "id")))
    assert "Broadcast" not in plan(many.alias("x").join(many.alias("y"), "id", "full"))
    assert many.join(few, "id").count() == own.join(many, "id", "left_semi").join(few, "id").count() == 1000


def test_an_empty_table_is_stored(spark):
    none = stored(spark.range(10).where("id < 0").join(spark.range(5), "id"), "none")
    assert none.columns == ["id"] and none.count() == 0 and stored(spark.createDataFrame([], "a long"), "none").count() == 0


@pytest.mark.parametrize("name", ["g11_u4_merge_fields", "x5_p10_audit_records", "x4_all_stages"])
def test_no_join_of_a_job_broadcasts_a_list(spark, tmp_path, monkeypatch, name):
    """Where every stored table counts as large, the only broadcast of a whole job is the one of a row per range (numbered). Files count 300-fold, so that only
    what Spark knows by its files, and not what it has joined already, is small to it."""
    spark.read.parquet("/root/testdata/sf0.1/customer.parquet").where("c_custkey < 40").write.parquet(f"{tmp_path}/customer.parquet")
    plans = []

    def kept(df, label):
        plans.append(plan(df))
        return stored(df, label)

    monkeypatch.setattr(storage, "UNPACKED_TO_BROADCAST", -1)
    for module in (enrich, graph, jobs, matching, record_queries, registry, run_log):
        if hasattr(module, "stored"):
            monkeypatch.setattr(module, "stored", kept)
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "300")
    try:
        plans.append(plan(registry.queries()[name](spark, str(tmp_path))))
    finally:
        spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    joins = [line for p in plans for line in p.split("\n") if "Broadcast" in line and "Join" in line]
    assert len(plans) > 10 and not [x for x in joins if "__part" not in x]
