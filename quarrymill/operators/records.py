"""Record tables: one row per record, one struct ("cell") per schema field, and flags.

Columns: record_id, source, source_id, source_url, ord (position), ``f_<field>`` cells, flags array<string>.
A cell holds value, source, status, note and candidates (other values seen). A null or blank value is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from quarrymill.schema import Schema

CELL = "struct<value:string,source:string,status:string,note:string,candidates:array<string>>"
#: Statuses of cells with their ranks, and of records in delivery order.
FIELD_RANK = {"verified": 3, "unverified": 2, "conflict": 1, "invalid": 0, "missing": -1}
RECORD_STATUSES = ("VERIFIED", "PARTIALLY_VERIFIED", "UNVERIFIED", "NEEDS_REVIEW", "EXCLUDED")


def strings(*items: Column) -> Column:
    """The items that aren't null."""
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def cell(value: Column, source: Column | str = "", status: Column | str = "unverified", note: Column | str = "", candidates: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    empty = value.isNull() | (F.btrim(value) == "")
    return F.struct(
        value.cast("string").alias("value"), lit(source).alias("source"), F.when(empty, "missing").otherwise(lit(status)).alias("status"), F.coalesce(lit(note), F.lit("")).alias("note"),
        (F.array().cast("array<string>") if candidates is None else candidates).alias("candidates"),
    ).cast(CELL)


def filled(c: Column) -> Column:
    """The value of a cell, null if blank."""
    return F.when(F.btrim(c["value"]) != "", c["value"])


def value(name: str) -> Column:
    return filled(F.col(f"f_{name}"))


def status(name: str) -> Column:
    return F.coalesce(F.col(f"f_{name}.status"), F.lit("missing"))


def changed(c: Column, **parts: Column | str) -> Column:
    """The cell with some parts replaced."""
    old = {k: c[k] for k in ("value", "source", "status", "note", "candidates")}
    old |= {k: F.lit(v) if isinstance(v, str) else v for k, v in parts.items()}
    return F.struct(*[v.alias(k) for k, v in old.items()]).cast(CELL)


def noted(c: Column, text: Column | str, append: bool = True) -> Column:
    """The note of a cell with ``text`` added after a semicolon (or put in its place)."""
    text = F.lit(text) if isinstance(text, str) else text
    if not append:
        return text
    return F.when(F.coalesce(c["note"], F.lit("")) == "", text).otherwise(F.concat(c["note"], F.lit("; "), text))


def marked(c: Column, to: Column | str, note: Column | str | None = None, append: bool = True) -> Column:
    to = F.lit(to) if isinstance(to, str) else to
    own = F.coalesce(c, F.lit(None).cast(CELL))
    return changed(own, status=to, **({} if note is None else {"note": noted(own, note, append)}))


def with_candidates(c: Column, values: Column) -> Column:
    """The cell with the values (an array) added that it has neither as value nor as candidate."""
    old = F.coalesce(c["candidates"], F.array().cast("array<string>"))
    new = F.filter(values, lambda v: v.isNotNull() & ~F.coalesce(v == c["value"], F.lit(False)))
    return changed(c, candidates=F.array_distinct(F.concat(old, new)))


def set_value(c: Column, new: Column, source: Column | str, to: Column | str, note: Column | str = "") -> Column:
    """A new value; a former different one is kept as a candidate."""
    old = F.coalesce(c["candidates"], F.array().cast("array<string>"))
    gone = F.when(filled(c).isNotNull() & (c["value"] != new), F.array_append(old, c["value"])).otherwise(old)
    return cell(new, source, to, note, gone)


def flag(df: DataFrame, *flags: Column) -> DataFrame:
    """Flags that aren't null are added, each once, in order."""
    return df.withColumn("flags", F.array_distinct(F.concat(F.coalesce("flags", strings()), strings(*flags))))


def to_records(raw: DataFrame, schema: Schema, source: Column | str = "") -> DataFrame:
    """Record rows from plain columns: those named like schema fields become cells (blank ones null), all unverified.

    record_id, source, source_id, source_url, ord and flags are kept where they exist; other columns are left out.
    """
    has = set(raw.columns)
    src = F.col("source") if "source" in has else (F.lit(source) if isinstance(source, str) else source)
    base = [
        (F.col("record_id") if "record_id" in has else F.lit(None)).cast("string").alias("record_id"), src.cast("string").alias("source"),
        *[(F.col(c) if c in has else F.lit("")).cast("string").alias(c) for c in ("source_id", "source_url")],
        (F.col("ord") if "ord" in has else F.monotonically_increasing_id()).cast("long").alias("ord"),
    ]
    cells = []
    for f in schema.fields:
        v = F.col(f"`{f.name}`").cast("string") if f.name in has else F.lit(None).cast("string")
        cells.append(F.when(F.btrim(v) != "", cell(v, src)).alias(f.column))
    return raw.select(*base, *cells, (F.coalesce("flags", strings()) if "flags" in has else strings()).alias("flags"))


def plain(df: DataFrame, schema: Schema, *others: str) -> DataFrame:
    """Values and statuses side by side, for reports and tests."""
    cols = [x for f in schema.fields for x in (value(f.name).alias(f.name), status(f.name).alias(f"{f.name}_status"))]
    return df.select("record_id", *others, *cols)


def each(schema: Schema, make: Callable) -> dict[str, Column]:
    return {f.column: make(f) for f in schema.fields}


