"""Numbers, years, dates and coordinates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import blank_to_null, col, let


def normalize_number(x: Column | str) -> Column:
    """A double from text with either decimal mark and thousands marks; null where there is none or it isn't finite."""
    t = F.btrim(F.translate(col(x).cast("string"), " ", " "))
    t = F.regexp_replace(t, r"(?<=\d) (?=\d{3}\b)", "")

    def plain(t: Column) -> Column:
        comma, dot = F.instr(t, ","), F.instr(t, ".")
        last = lambda c: F.length(t) - F.locate(c, F.reverse(t))
        comma_decimal = F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")
        no_commas = F.replace(t, F.lit(","), F.lit(""))
        thousands = t.rlike(r"\d,\d{3}(?!\d)") & ~t.rlike(r",\d{1,2}$")
        both = F.when(last(",") > last("."), comma_decimal).otherwise(no_commas)
        return F.when((comma > 0) & (dot > 0), both).when(comma > 0, F.when(thousands, no_commas).otherwise(F.translate(t, ",", "."))).otherwise(t)

    number = blank_to_null(F.regexp_extract(let(t, plain), r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?", 0)).try_cast("double")
    return let(number, lambda v: F.when(F.abs(v) <= F.lit(1.7976931348623157e308), v))


def normalize_integer(x: Column | str) -> Column:
    return let(normalize_number(x), lambda v: F.when(v == F.floor(v), v.try_cast("long")))


def normalize_year(x: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(x).cast("string"), r"1[5-9]\d{2}|20\d{2}|21\d{2}", 0)).cast("int")


#: The forms of dates that are read, in order.
DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z?$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)


def normalize_date(x: Column | str) -> Column:
    """``YYYY-MM-DD``; a text that starts like one but is no calendar date gives that start."""
    t = F.btrim(col(x).cast("string"))
    out = [F.date_format(F.when(t.rlike(form), F.try_to_timestamp(F.substring_index(t, "T", 1), F.lit(pattern))), "yyyy-MM-dd") for form, pattern in DATE_FORMS]
    return F.coalesce(*out, blank_to_null(F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}", 0)))


def normalize_coordinate(x: Column | str, kind: str) -> Column:
    limit = 90 if kind == "latitude" else 180
    return let(normalize_number(x), lambda v: F.when(F.abs(v) <= limit, F.bround(v, 6)))
