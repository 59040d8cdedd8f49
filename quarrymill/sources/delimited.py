"""Delimited lists: header checks, column mapping and row numbers."""

from __future__ import annotations

import csv
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.operators.records import to_records
from quarrymill.schema import Schema

#: Usual column names of exports, and the fields that they stand for.
ALIASES = {
    **dict.fromkeys(("company", "company name", "organisation", "organization", "account name", "name"), "company_name"),
    **dict.fromkeys(("website", "web", "url", "domain", "company website"), "website"),
    **dict.fromkeys(("email", "e-mail", "email address"), "email"),
    **dict.fromkeys(("phone", "telephone", "tel", "phone number", "company phone"), "phone"),
    **dict.fromkeys(("linkedin", "linkedin url", "company linkedin url", "linkedin_url"), "linkedin"),
    **dict.fromkeys(("facebook", "facebook url"), "facebook"), "instagram": "instagram", "industry": "industry",
    **dict.fromkeys(("category", "sector"), "category"), **dict.fromkeys(("city", "town"), "city"),
    **dict.fromkeys(("postcode", "postal code", "zip"), "postcode"), **dict.fromkeys(("street", "address", "street address"), "street"), "country": "country",
    **dict.fromkeys(("vat", "vat number", "btw", "kbo", "enterprise number"), "vat_number"),
    **dict.fromkeys(("employees", "# employees"), "employees"), **dict.fromkeys(("founded", "founded year"), "founded"), **dict.fromkeys(("description", "notes"), "description"),
}


def check_headers(values: list[str]) -> list[str]:
    headers = [(v or "").strip() for v in values]
    if not 1 <= len(headers) <= 200 or not all(headers):
        raise ValueError("a list has 1 to 200 columns, all with a name")
    if len({h.casefold() for h in headers}) < len(headers):
        raise ValueError("column names must differ, also in lower case")
    return headers


def read_table(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, without rows that are blank throughout. The separator is found from the first lines; the header is
    checked before Spark sees it, which would rename repeated names. A row with another number of cells fails the read."""
    first = spark.read.schema("line string").options(sep="\x01", quote="", encoding=encoding, mode="PERMISSIVE").csv(path)
    head = [r.line or "" for r in first.limit(20).collect()]
    if not head:
        raise ValueError("an empty file has no header")
    head[0] = head[0].removeprefix("﻿")
    if separator is None:
        try:
            separator = csv.Sniffer().sniff("\n".join(head), ",;\t|").delimiter
        except csv.Error:
            separator = ","
    headers = check_headers(next(csv.reader([head[0]], delimiter=separator)))
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    options = {"header": True, "sep": separator, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST", "enforceSchema": True}
    rows = spark.read.schema(schema).options(**options).csv(path)
    return rows.where(F.coalesce(*[F.nullif(F.col(f"`{h}`"), F.lit("")) for h in headers]).isNotNull())


def map_columns(headers: list[str], schema: Schema, mapping: Mapping[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """({header: field}, ignored headers): by explicit mapping, else label, name or usual name of a field."""
    low = lambda x: x.strip().lower()
    own = {low(k): v for k, v in (mapping or {}).items()}
    for header, field in own.items():
        if header not in map(low, headers) or not schema.field(field):
            raise ValueError(f"mapping of {header!r} to {field!r}: no such column or field")
    labels, names = {low(f.display): f.name for f in schema.fields}, {low(f.name): f.name for f in schema.fields}
    out: dict[str, str] = {}
    for header in headers:
        field = next((m[low(header)] for m in (own, labels, names, ALIASES) if m.get(low(header))), None)
        if field and schema.field(field):
            if field in out.values():
                raise ValueError(f"several columns stand for {field}")
            out[header] = field
    return out, [h for h in headers if h not in out]


def row_numbers(rows: DataFrame, first: int = 2) -> DataFrame:
    """``rows`` with ``line``: their place in the input from ``first`` on, by counts per input partition."""
    placed = rows.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    counts = {r[0]: r[1] for r in placed.groupBy("__p").count().collect()}  # one row per input split
    starts, at = {}, first
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    if not starts:
        return rows.withColumn("line", F.lit(first).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]), F.col("__p"))
    return placed.withColumn("line", (start + F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)).cast("long")).drop("__p", "__i")


def ingest_rows(rows: DataFrame, schema: Schema, source: str, country: str | None = None, mapping: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of a list: source_id ``row N`` by line, ids ``ROW-000N``, the country filled in, rows without a mapped value left out."""
    fields, _ = map_columns(rows.columns, schema, mapping)
    if not fields:
        raise ValueError("no column stands for a field of the schema")
    numbered = row_numbers(rows)
    own = numbered.select("line", *[F.nullif(F.col(f"`{h}`"), F.lit("")).alias(f) for h, f in fields.items()]).where(F.coalesce(*[F.col(f) for f in fields.values()]).isNotNull())
    if limit:
        own = own.orderBy("line").limit(limit)
    if country and schema.field("country"):
        own = own.withColumn("country", F.coalesce("country", F.lit(country)) if "country" in own.columns else F.lit(country))
    line = F.col("line").cast("string")
    padded = F.lpad(line, F.greatest(F.lit(4), F.length(line)), F.lit("0"))
    own = own.select(F.concat(F.lit("ROW-"), padded).alias("record_id"), F.lit(source).alias("source"), F.concat(F.lit("row "), line).alias("source_id"), F.col("line").alias("ord"), *fields.values(), *(["country"] if country and schema.field("country") and "country" not in fields.values() else []))
    return to_records(own, schema)
