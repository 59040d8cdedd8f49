"""Named sources and their union."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.storage import stored

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Register a source: a function of (spark, **options) that returns rows of schema fields."""

    def add(function):
        SOURCES[name] = function
        return function

    return add


def source(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"no source {name!r}; there are {', '.join(sorted(SOURCES)) or 'none'}")
    return SOURCES[name](spark, **options)


def union_sources(parts: Iterable[tuple[Callable[[], DataFrame], int | None]], limit: int | None = None, order: str = "source_id") -> tuple[DataFrame, list[str]]:
    """(rows of all sources in order, with source_place; warnings). Each source is stored, so that one that fails while it is
    read is a warning too; no rows at all is an error. Limits keep the first rows by ``order``, and of all rows by source."""
    out, warnings = None, []
    for place, (make, most) in enumerate(parts):
        try:
            df = make()
            df = df.orderBy(order).limit(most) if most else df
            df = stored(df.withColumn("source_place", F.lit(place)), "source")
        except Exception as e:  # the others go on
            warnings.append(f"a source failed: {e}")
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None or out.isEmpty():
        raise ValueError("no records: " + ("; ".join(warnings) or "all sources are empty"))
    return (out.orderBy("source_place", order).limit(limit) if limit else out), warnings
