"""Runs, reviews and comparisons kept in Parquet tables under one folder.

``records`` (partitioned by run_id), ``runs`` and ``events`` are only appended to; the current decision of a record is its
event with the highest revision. One job at a time writes to a workspace.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import csv_cell
from quarrymill.operators.records import status, value
from quarrymill.operators.rules import approval_blockers
from quarrymill.schema import Schema
from quarrymill.storage import stored

EVENTS = "run_id string, record_id string, decision string, reviewer string, note string, revision int, created_at timestamp"
RUNS = "run_id string, project string, created_at timestamp, input_name string, input_sha256 string, schema_json string, report_json string"


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of the exact bytes of input files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the workspace, None where nothing was written yet."""
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def save_run(records: DataFrame, folder: str, run_id: str, project: str, schema: Schema, input_name: str = "", input_sha256: str = "", report: dict | None = None) -> None:
    """Append a run. Runs don't change: a known run id is refused, as are repeated record ids and blank or long project names. The run's row
    comes last: records that a crash left without it are no run, and saving again replaces them."""
    if not project.strip() or len(project) > 120:
        raise ValueError("a project name has 1 to 120 characters")
    if not records.groupBy("record_id").count().where("count > 1").isEmpty():
        raise ValueError("record ids must be unique within a run")
    spark = records.sparkSession
    known = _table(spark, folder, "runs")
    if known is not None and not known.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"there is a run {run_id!r} already")
    own = records.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    own.partitionBy("run_id").parquet(f"{folder}/records")
    row = [(run_id, project.strip(), input_name, input_sha256, json.dumps(schema.as_dict(), sort_keys=True), json.dumps(report or {}, sort_keys=True))]
    runs = spark.createDataFrame(row, "run_id string, project string, input_name string, input_sha256 string, schema_json string, report_json string")
    runs.withColumn("created_at", F.current_timestamp()).write.mode("append").partitionBy("run_id").parquet(f"{folder}/runs")


def save_events(events: DataFrame, folder: str) -> None:
    """Append accepted decisions."""
    events.write.mode("append").partitionBy("run_id").parquet(f"{folder}/events")


def delete_run(spark: SparkSession, folder: str, run_id: str) -> None:
    """Remove a run with its records and decisions; raises where the workspace has none of it."""
    runs = _table(spark, folder, "runs")
    if runs is None or runs.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError("no such run in this workspace")
    for name in ("events", "records", "runs"):  # the run itself goes last: until then the deletion can be done again
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/run_id={run_id}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The records of one run: only its partition is read. Raises where the workspace has no such run, even if it has records of one that was
    cut off."""
    runs = _table(spark, folder, "runs")
    if runs is None or runs.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError("no such run in this workspace")
    return spark.read.parquet(f"{folder}/records").where(F.col("run_id") == run_id)


def list_runs(runs: DataFrame, project: str | None = None) -> DataFrame:
    """Newest first."""
    own = runs if project is None else runs.where(F.col("project") == project)
    return own.orderBy(F.desc("created_at"), "run_id")


def current_reviews(events: DataFrame) -> DataFrame:
    """The latest decision on each record of each run."""
    last = F.max_by(F.struct("decision", "reviewer", "note", "revision", "created_at"), "revision").alias("r")
    return events.groupBy("run_id", "record_id").agg(last).select("run_id", "record_id", "r.*")


def event_history(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id).orderBy("created_at", "record_id", "revision")


def apply_decisions(proposals: DataFrame, records: DataFrame, events: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected proposals with a reason).

    Proposals: proposal_id, run_id, record_id, decision, reviewer, note, expected_revision, created_at. Of several sound
    proposals on one record the one with the smallest proposal_id wins; the others come too late.
    """
    own = proposals.withColumns({"reviewer": F.btrim(F.coalesce("reviewer", F.lit(""))), "note": F.btrim(F.coalesce("note", F.lit("")))})
    state = records.select("run_id", "record_id", F.size(approval_blockers(schema)).alias("blockers"), F.size("flags").alias("n_flags"), F.lit(True).alias("there"))
    now = current_reviews(events).select("run_id", "record_id", F.col("revision").alias("current"))
    both = own.join(state, ["run_id", "record_id"], "left").join(now, ["run_id", "record_id"], "left").withColumn("current", F.coalesce("current", F.lit(0)))
    reason = (
        F.when(~F.coalesce(F.col("decision").isin("pending", "approved", "rejected"), F.lit(False)), "decision must be pending, approved or rejected")
        .when((F.col("reviewer") == "") | (F.length("reviewer") > 120) | (F.length("note") > 4000), "reviewer of 1 to 120 and note of at most 4000 characters")
        .when(F.col("there").isNull(), "no such record in this run")
        .when((F.col("decision") == "approved") & (F.col("blockers") > 0), "blocked: correct and import again")
        .when((F.col("decision") == "approved") & (F.col("n_flags") > 0) & (F.col("note") == ""), "a note has to acknowledge the flags")
        .when((F.col("decision") == "rejected") & (F.col("note") == ""), "a rejection needs a reason")
        .when(F.coalesce("expected_revision", F.lit(0)) != F.col("current"), "changed meanwhile: reload")
    )
    judged = both.withColumn("reason", reason)
    turn = F.row_number().over(Window.partitionBy("run_id", "record_id", F.col("reason").isNull()).orderBy("proposal_id"))
    judged = judged.withColumn("turn", turn).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("turn") > 1), "changed meanwhile: reload").otherwise(F.col("reason")))
    accepted = judged.where("reason is null").select("run_id", "record_id", "decision", "reviewer", "note", (F.col("current") + 1).cast("int").alias("revision"), "created_at")
    return accepted, judged.where("reason is not null").select(*proposals.columns, "reason")


def approved(records: DataFrame, reviews: DataFrame, schema: Schema) -> DataFrame:
    """Approved records without blockers, with who approved them and when."""
    own = records.where(F.size(approval_blockers(schema)) == 0).join(reviews.where("decision = 'approved'"), ["run_id", "record_id"])
    return own.select("record_id", *[value(n).alias(n) for n in schema.names], F.col("status").alias("verification_status"), "reviewer", F.col("note").alias("review_note"), F.col("created_at").alias("reviewed_at"))


def write_approved_csv(rows: DataFrame, path: str) -> None:
    """A CSV folder of literal cells; an existing one isn't overwritten."""
    rows.select(*[csv_cell(F.col(c).cast("string")).alias(c) for c in rows.columns]).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def _keyed(records: DataFrame, schema: Schema, key: str) -> DataFrame:
    """One row per key with all values and statuses; raises where the key isn't there, sound and unique."""
    if key not in schema.names:
        raise ValueError("the key isn't in the schema")
    k = F.btrim(value(key))
    bad = records.agg(F.count_if(k.isNull() | status(key).isin("invalid", "conflict")), F.count("*") - F.count_distinct(k)).first()
    if bad[0]:
        raise ValueError(f"the key {key} must be present and valid on every record")
    if bad[1]:
        raise ValueError(f"the key {key} isn't unique")
    cells = F.struct(*[F.struct(value(n).alias("value"), status(n).alias("status")).alias(n) for n in schema.names])
    return records.select(k.alias("key"), cells.alias("cells"))


def compare_runs(before: DataFrame, after: DataFrame, schema: Schema, key: str = "account_id") -> DataFrame:
    """(key, change, field, before, after, status_before, status_after) of added, removed and changed records, and unchanged
    ones with a null field. A field has changed if its value or its status differs.

    Keys and 128-bit digests of all cells meet first; the cells themselves are fetched for the keys alone whose digests differ.
    """
    old, new = _keyed(before, schema, key), _keyed(after, schema, key)
    digest = lambda df, name: df.select("key", F.md5(F.to_json("cells")).alias(name))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    kinds = stored(digest(old, "a").join(digest(new, "b"), "key", "full_outer").select("key", kind.alias("change")), "changed-keys")
    changed = kinds.where("change = 'changed'").select("key")
    cells = lambda df, name: df.join(changed, "key", "left_semi").withColumnRenamed("cells", name)
    one = lambda n: F.struct(F.lit(n).alias("field"), F.col(f"old.{n}.value").alias("before"), F.col(f"new.{n}.value").alias("after"), F.col(f"old.{n}.status").alias("status_before"), F.col(f"new.{n}.status").alias("status_after"))
    changes = F.filter(F.array(*[one(n) for n in schema.names]), lambda x: ~x["before"].eqNullSafe(x["after"]) | ~x["status_before"].eqNullSafe(x["status_after"]))
    fields = cells(old, "old").join(cells(new, "new"), "key").select("key", F.lit("changed").alias("change"), F.explode(changes).alias("c")).select("key", "change", "c.*")
    rest = kinds.where("change <> 'changed'").select("key", "change", *[F.lit(None).cast("string").alias(c) for c in fields.columns[2:]])
    return rest.unionByName(fields)


def compare_saved(spark: SparkSession, folder: str, before: str, after: str, schema: Schema, key: str = "account_id") -> DataFrame:
    """compare_runs() of two runs of a workspace; they must be of one project and have one schema."""
    runs = spark.read.parquet(f"{folder}/runs").where(F.col("run_id").isin(before, after)).select("run_id", "project", "schema_json").collect()
    if {r.run_id for r in runs} != {before, after}:
        raise ValueError("no such run in this workspace")
    if len({r.project for r in runs}) > 1 or len({r.schema_json for r in runs}) > 1:
        raise ValueError("only runs of one project with one schema can be compared")
    return compare_runs(load_run(spark, folder, before), load_run(spark, folder, after), schema, key)


def key_differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side alone."""
    old, new = before.select(value(key).alias("key")), after.select(value(key).alias("key"))
    return new.exceptAll(old).select("key", F.lit("added").alias("side")).unionByName(old.exceptAll(new).select("key", F.lit("removed").alias("side")))


def key_intersection(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.select(value(key).alias("key")).intersect(after.select(value(key).alias("key")))


def without_run(df: DataFrame, run_id: str) -> DataFrame:
    """A workspace table without a run; raises where it has none."""
    if df.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError("no such run in this workspace")
    return df.where(F.col("run_id") != run_id)
