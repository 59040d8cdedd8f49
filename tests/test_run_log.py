import pytest
from pyspark.sql import functions as F

from quarrymill.operators.run_log import RunLog


def test_stages_are_counted_as_they_are_stored(spark):
    counter = spark.sparkContext.accumulator(0)

    def seen(x):
        counter.add(1)
        return x

    log = RunLog()
    first = log.stage("load", spark.range(100).withColumn("x", F.udf(seen, "long")("id")), "from a list")
    second = log.stage("odd", first.where("x % 2 = 1"), warnings={"there are large ones": F.col("x") > 90, "there are negative ones": F.col("x") < 0})
    third = log.stage("more", second.unionByName(second), rows_in=7, warnings={"there are large ones": F.col("x") > 50})
    rows = [tuple(r) for r in log.table(spark).drop("seconds").orderBy("place").collect()]
    assert rows == [(0, "load", 100, 100, "from a list"), (1, "odd", 100, 50, ""), (2, "more", 7, 100, "")]
    assert log.warnings == ["there are large ones"] and third.count() == 100
    assert counter.value == 100  # the first stage ran once
    assert log.table(spark).where("seconds < 0").isEmpty()


def test_empty_run(spark):
    log = RunLog()
    assert log.table(spark).count() == 0
    assert log.stage("none", spark.range(0), warnings={"odd": F.lit(None).cast("boolean")}).count() == 0
    assert log.stages[0]["rows"] == 0 and log.warnings == []
    with pytest.raises(Exception, match="(?i)divide|zero"):  # a stage that fails is not in the log
        log.stage("bad", spark.range(3).select(F.expr("id / 0")))
    assert len(log.stages) == 1


def test_a_whole_run_is_dealt_to_all_cores_and_names_no_key_twice(spark, tmp_path, monkeypatch):
    from quarrymill.operators import enrich
    from quarrymill.operators.records import to_records
    from quarrymill.plans import jobs, record_queries
    from quarrymill.schema import COMPANIES

    spark.range(50).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(jobs, "run_pipeline", lambda records, *_, **more: {"records": records} | more)
    run = record_queries._whole_run(spark, str(tmp_path))
    for table in (run["records"], run["hits"], run["profiles"], run["register"], run["mail_domains"]):  # a short file is one partition
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    own = to_records(spark.createDataFrame([("R", "Firm één", "BE0403170701")], "record_id string, company_name string, vat_number string"), COMPANIES)
    register = spark.createDataFrame([("BE0403170701", True, "FIRM EEN NV", "", "")], "vat string, valid boolean, name string, address string, error string")
    out = enrich.apply_vat_register(own, register, COMPANIES)
    assert out.select("f_company_name.status", "f_legal_name.value").collect() == [("verified", "FIRM EEN NV")]
    assert "gmbh" not in out._jdf.queryExecution().optimizedPlan().toString()  # keys of names are stored, not repeated
