"""Counts, shares and tables that describe a run's records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.codes import format_phone_display
from quarrymill.functions.text import csv_cell, generalise_flag, spreadsheet_safe
from quarrymill.operators.records import RECORD_STATUSES, filled, status, value
from quarrymill.operators.rules import delivered, needs_review
from quarrymill.schema import Schema

#: Fields whose checks are shown, and those that are counted by status.
CHECKED = ("company_name", "name", "title", "website", "email", "phone", "vat_number")
COUNTED = ("company_name", "email", "website", "phone", "vat_number")


def status_counts(records: DataFrame) -> DataFrame:
    """status, n: every status once, 0 included."""
    spark = records.sparkSession
    domain = spark.createDataFrame([(s,) for s in RECORD_STATUSES], "status string")
    counts = records.groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def totals(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: total, delivered, merged, groups."""
    own = records.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "EXCLUDED").alias("delivered"), F.count_if(F.coalesce("duplicate_of", F.lit("")) != "").alias("merged"))
    return own.crossJoin(groups.agg(F.count("*").alias("groups")))  # one row each


def field_completeness(records: DataFrame, schema: Schema) -> DataFrame:
    """field, filled, share (percent of the delivered records, one decimal), in one pass over the records."""
    one = delivered(records).agg(F.count("*").alias("n"), *[F.count(value(f.name)).alias(f.name) for f in schema.fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("filled")) for f in schema.fields]))
    return one.select("n", pairs.alias("x")).select("x.field", "x.filled", F.when(F.col("n") == 0, 0.0).otherwise(F.bround(100.0 * F.col("x.filled") / F.col("n"), 1)).alias("share"))


def flag_counts(records: DataFrame, most: int = 25) -> DataFrame:
    """flag, n: the most frequent flags without what is particular to a record; of equal counts, those seen first."""
    told = records.select("ord", F.posexplode("flags").alias("pos", "flag")).select("ord", "pos", generalise_flag("flag").alias("flag"))
    counts = told.groupBy("flag").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(most).select("flag", "n")


def verification_counts(records: DataFrame, schema: Schema) -> DataFrame:
    """field, verified, unverified, conflict, invalid, missing over delivered records."""
    fields = [n for n in COUNTED if schema.field(n)]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), status(n).alias("s")) for n in fields]))
    kinds = ("verified", "unverified", "conflict", "invalid", "missing")
    return delivered(records).select(pairs.alias("x")).groupBy("x.field").agg(*[F.count_if(F.col("x.s") == k).alias(k) for k in kinds])


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("n"))


def problem_counts(records: DataFrame) -> DataFrame:
    """One row: problems (flags that aren't notes) and rows that have one."""
    own = F.size(F.filter("flags", lambda f: ~f.startswith("note:")))
    return records.agg(F.coalesce(F.sum(own), F.lit(0)).alias("problems"), F.count_if(own > 0).alias("rows_with_problems"))


def delivery_order() -> list[Column]:
    place = F.lit(9)
    for k, s in enumerate(RECORD_STATUSES):
        place = F.when(F.col("status") == s, k).otherwise(place)
    return [place, F.lower(F.col("__name"))]


def in_delivery_order(records: DataFrame, schema: Schema) -> DataFrame:
    """By status, then by name in lower case."""
    names = [value(n) for n in ("company_name", "name", "title") if schema.field(n)] or [value(schema.name_field)]
    return records.withColumn("__name", F.coalesce(*names, F.lit(""))).orderBy(*delivery_order(), "record_id").drop("__name")


def check_text(name: str) -> Column:
    """Status, note and up to three other values of a cell in words."""
    c = F.col(f"f_{name}")
    text = F.concat(c["status"], F.when(F.coalesce(c["note"], F.lit("")) != "", F.concat(F.lit(" - "), c["note"])).otherwise(F.lit("")))
    others = F.when(F.size(c["candidates"]) > 0, F.concat(F.lit(" | other values seen: "), F.array_join(F.slice(c["candidates"], 1, 3), ", "))).otherwise(F.lit(""))
    nothing = c.isNull() | (filled(c).isNull() & (F.size(c["candidates"]) == 0) & (F.coalesce(c["note"], F.lit("")) == ""))
    return F.when(nothing, F.lit("missing")).otherwise(F.concat(text, others))


def display_columns(schema: Schema, country: str = "BE") -> list[tuple[str, Column]]:
    """(header, column) of a delivery, in order."""
    nul = lambda c: F.nullif(F.col(c), F.lit(""))
    out = [("Record ID", F.col("record_id"))]
    out += [(f.display, format_phone_display(value(f.name), country) if f.type == "phone" else value(f.name)) for f in schema.fields]
    out += [("Verification status", F.col("status")), ("Review flags", F.nullif(F.array_join("flags", "\n"), F.lit(""))), ("Completeness %", F.col("completeness"))]
    out += [(f"{schema.field(n).display} check", check_text(n)) for n in CHECKED if schema.field(n)]
    out += [("Source", F.col("source")), ("Source URL", nul("source_url")), ("Duplicate group", nul("duplicate_group"))]
    return out + [("Reviewer decision", F.lit(None).cast("string")), ("Reviewer notes", F.lit(None).cast("string"))]


def display_table(records: DataFrame, schema: Schema, country: str = "BE") -> DataFrame:
    return records.select(*[spreadsheet_safe(c.cast("string")).alias(h) for h, c in display_columns(schema, country)])


def delivery_cells(records: DataFrame, schema: Schema, country: str = "BE") -> DataFrame:
    """The delivered records as cells that a spreadsheet takes literally."""
    shown = display_table(delivered(records), schema, country)
    return shown.select(*[csv_cell(f"`{c}`").alias(c) for c in shown.columns])


def write_delivery_csv(records: DataFrame, schema: Schema, path: str, country: str = "BE") -> None:
    """The delivered records as a folder of CSV files in UTF-8 with a byte order mark, names of columns as literal as cells."""
    cells = delivery_cells(records, schema, country)
    heads = cells.sparkSession.createDataFrame([(k, c) for k, c in enumerate(cells.columns)], "k int, c string").select("k", csv_cell("c").alias("c")).collect()
    names = [r.c for r in sorted(heads, key=lambda r: r.k)]
    names[0] = "\ufeff" + names[0]
    cells.toDF(*names).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_evidence(records: DataFrame, groups: DataFrame, schema: Schema, report: dict, path: str) -> None:
    """Everything about a run as JSON datasets below ``path``: records with the provenance of all cells, groups, schema, report."""
    spark = records.sparkSession
    fields = F.struct(*[F.col(f.column).alias(f.name) for f in schema.fields])
    others = [c for c in records.columns if not c.startswith("f_") and c != "ord"]
    records.select(*others, fields.alias("fields")).write.option("ignoreNullFields", False).json(f"{path}/records")
    groups.select("group_id", "master_id", "member_ids", "reason", "similarity", "merged").write.json(f"{path}/groups")
    for name, value_ in (("schema", schema.as_dict()), ("report", report)):
        spark.createDataFrame([(json.dumps(value_, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/{name}")


def review_queue(records: DataFrame, schema: Schema) -> DataFrame:
    """Records that a person has to decide on, with their key fields and checks."""
    name = schema.name_field
    keys = [name, *[f.name for f in schema.fields if f.type in ("email", "phone", "url", "vat") and f.name != name]]
    note = lambda n: F.when(F.coalesce(F.col(f"f_{n}.note"), F.lit("")) != "", F.concat(F.lit(" - "), F.col(f"f_{n}.note"))).otherwise(F.lit(""))
    checks = F.concat_ws("\n", *[F.when(value(n).isNotNull(), F.concat(F.lit(f"{n}: "), status(n), note(n))) for n in keys])
    return needs_review(records).select("record_id", "status", F.array_join("flags", "\n").alias("flags"), *[value(n).alias(n) for n in keys], checks.alias("checks"), "source", "source_url")


def summary_table(records: DataFrame, groups: DataFrame, schema: Schema) -> DataFrame:
    """(section, key, n, share): statuses, filled fields, checks and sources of the delivered records, and totals."""
    own = delivered(records)
    n = own.agg(F.count("*").alias("all_n"))
    share = lambda df: df.crossJoin(F.broadcast(n)).select("section", "key", F.col("n").cast("long").alias("n"), F.when(F.col("all_n") == 0, 0.0).otherwise(F.col("n") / F.col("all_n")).alias("share"))
    part = lambda df, section, key: df.select(F.lit(section).alias("section"), F.col(key).alias("key"), "n")
    checks = verification_counts(records, schema).select(
        "field", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("n")) for k, v in (("verified", F.col("verified")), ("unverified", F.col("unverified")), ("conflict / invalid", F.col("conflict") + F.col("invalid")))])).alias("x")
    ).select(F.lit("check").alias("section"), F.concat_ws(": ", "field", "x.k").alias("key"), F.col("x.n").alias("n"))
    counted = part(status_counts(own).where("status <> 'EXCLUDED'"), "status", "status").unionByName(part(field_completeness(records, schema).withColumnRenamed("filled", "n"), "field", "field")).unionByName(checks).unionByName(part(source_counts(own), "source", "source"))
    sums = totals(records, groups).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in ("total", "delivered", "merged", "groups")])).alias("x"))
    return share(counted).unionByName(sums.select(F.lit("total").alias("section"), "x.key", "x.n", F.lit(None).cast("double").alias("share")))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of named tables: the row accounting of a run."""
    out = None
    for k, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("place"), F.lit(name).alias("stage"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def review_metrics(records: DataFrame, reviews: DataFrame, schema: Schema) -> DataFrame:
    """One row: records, blocked, approved and awaiting a decision."""
    from quarrymill.operators.rules import approval_blockers

    own = records.join(reviews.select("record_id", "decision"), "record_id", "left").select((F.size(approval_blockers(schema)) > 0).alias("blocked"), F.coalesce("decision", F.lit("pending")).alias("decision"))
    return own.agg(F.count("*").alias("records"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "pending").alias("awaiting"))
