"""Normalising, validating and rating whole record tables by a schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import codes, numbers, text, web
from quarrymill.functions.text import let, once_a_session
from quarrymill.operators.records import FIELD_RANK, changed, filled, flag, noted, status, strings, value
from quarrymill.schema import FieldDef, Schema

NAMES = ("company_name", "name", "title", "legal_name")


def normalize_value(x: Column, field: FieldDef, country: str = "BE") -> Column:
    """``x`` in the form of the field's type, as a string; null if it can't be read."""

    def social(v: Column) -> Column:
        if field.name in web.SOCIAL_HOSTS:
            return let(F.coalesce(web.social_network(v), F.lit(field.name)), lambda n: web.normalize_social(v, n))
        return let(web.social_network(v), lambda n: F.when(n.isNull(), web.normalize_url(v)).otherwise(web.normalize_social(v, n)))

    by_type = {
        "email": lambda: web.normalize_email(x), "url": lambda: web.normalize_url(x), "phone": lambda: codes.normalize_phone(x, country), "postcode": lambda: codes.normalize_postcode(x, country),
        "vat": lambda: codes.normalize_vat(x, country), "number": lambda: numbers.normalize_number(x), "integer": lambda: numbers.normalize_integer(x), "year": lambda: numbers.normalize_year(x),
        "date": lambda: numbers.normalize_date(x), "latitude": lambda: numbers.normalize_coordinate(x, "latitude"), "longitude": lambda: numbers.normalize_coordinate(x, "longitude"),
        "social": lambda: let(x, social), "string": lambda: text.normalize_name(x) if field.name in NAMES else text.clean_text(x),
    }
    return by_type.get(field.type, lambda: text.clean_text(x))().cast("string")


def quoted(v: Column, most: int = 60) -> Column:
    """The start of a text in quotes."""
    start = F.substring(v, 1, most)
    return F.when(start.contains("'") & ~start.contains('"'), F.concat(F.lit('"'), start, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(start, F.lit("'"), F.lit("\\'")), F.lit("'")))


@once_a_session
def _normal_cells(schema: Schema, country: str) -> tuple[dict[str, Column], list[Column]]:
    """New cells by column, and what is said of those that can't be read (of columns with __new)."""
    cells, messages = {}, []
    for f in schema.fields:
        c = F.col(f.column)
        label = f.display.lower()

        def normal(c: Column, f: FieldDef = f, label: str = label) -> Column:
            bad = changed(c, value=F.lit(None).cast("string"), status="invalid", note=noted(c, F.concat(F.lit(f"could not interpret {label} value "), quoted(c["value"]))), candidates=F.array_append(c["candidates"], c["value"]))
            return let(normalize_value(c["value"], f, country), lambda v: F.when(v.isNull(), bad).otherwise(changed(c, value=v)))

        cells[f.column] = F.when(filled(c).isNull(), c).otherwise(let(c, normal))
        failed = filled(F.col(f.column)).isNotNull() & F.col(f"{f.column}__new.value").isNull()
        messages.append(F.when(failed, F.concat(F.lit(f"{label} value could not be interpreted: "), quoted(F.col(f"{f.column}.value")))))
    return cells, messages


def normalize_table(records: DataFrame, schema: Schema, country: str = "BE") -> DataFrame:
    """Every filled cell in its type's form. What can't be read becomes an empty invalid cell with the original among
    its candidates, a note and a flag."""
    cells, messages = _normal_cells(schema, country)
    out = flag(records.withColumns({k + "__new": v for k, v in cells.items()}), *messages)
    return out.select(*[F.col(f"{c}__new").alias(c) if c in cells else F.col(c) for c in records.columns])


def validate_field(field: FieldDef, v: Column, country: str = "BE") -> Column:
    """The first problem of a value, or null. Rules whose answer isn't known raise none."""
    out: list[tuple[Column, str]] = []
    if field.max_length:
        out.append((F.length(v) > field.max_length, f"longer than {field.max_length} characters"))
    if field.pattern:
        out.append((~v.rlike(field.pattern), f"does not match pattern {field.pattern}"))
    if field.enum:
        out.append((~v.isin(*field.enum), f"not one of {', '.join(field.enum)}"))
    if field.type == "email":
        out.append((~web.is_valid_email(v), "invalid e-mail address"))
    if field.type == "url":
        out.append((web.url_domain(v).isNull(), "invalid URL"))
    if field.type == "social":
        out.append((web.social_network(v).isNull(), "not a recognised social-network profile URL"))
    if field.type == "phone":
        out.append((~codes.phone_info(v, country)["valid"], "invalid phone number"))
    if field.type == "postcode":
        out.append((codes.is_valid_postcode(v, country) == F.lit(False), f"invalid postcode for {country}"))
    if field.type == "vat":
        out.append((codes.is_valid_vat(v) == F.lit(False), "invalid VAT number (format or checksum)"))
    if field.type in ("number", "integer", "year", "latitude", "longitude"):
        number = v.try_cast("double")
        out.append((number.isNull(), "not a number"))
        if field.min is not None:
            out.append((number < field.min, f"below minimum {field.min:g}"))
        if field.max is not None:
            out.append((number > field.max, f"above maximum {field.max:g}"))
    problem = F.lit(None).cast("string")
    for rule, message in reversed(out):
        problem = F.when(rule, F.lit(message)).otherwise(problem)
    return F.when(v.isNotNull(), problem)


def cross_field_checks(records: DataFrame, schema: Schema) -> DataFrame:
    """Flags for values that don't fit together; adds them to flags and, but for notes, to problems."""
    out, has = records, set(schema.names)
    if {"email", "website"} <= has:
        mail, site = web.email_domain(value("email")), web.url_domain(value("website"))

        def apart(s: Column) -> Column:
            e, w = s["e"], s["w"]
            return (e != w) & ~e.endswith(F.concat(F.lit("."), w)) & ~w.endswith(F.concat(F.lit("."), e)) & ~e.isin(*web.FREE_MAIL_DOMAINS)

        out = out.withColumn("__d", F.struct(mail.alias("e"), site.alias("w"))).withColumn("__apart", F.coalesce(let(F.col("__d"), apart), F.lit(False)))
        sure = status("email") == "verified"
        message = F.when(F.col("__apart") & ~sure, F.concat(F.lit("e-mail domain ("), F.col("__d.e"), F.lit(") differs from website domain ("), F.col("__d.w"), F.lit(") - review")))
        out = flag(out, message).withColumn("problems", F.concat("problems", strings(message)))
        note = F.concat(F.lit("note: e-mail domain differs from website domain ("), F.col("__d.w"), F.lit(")"))
        out = out.withColumn("f_email", F.when(F.col("__apart") & sure, changed(F.col("f_email"), note=noted(F.col("f_email"), note))).otherwise(F.col("f_email"))).drop("__d", "__apart")
    if {"postcode", "city"} <= has:
        out = flag(out, F.when(value("postcode").isNotNull() & value("city").isNull(), F.lit("note: postcode present but city missing")))
    if "opening_hours" in has:
        hours = value("opening_hours")
        closed = hours.rlike(r"(?iu)\bclosed\b|gesloten|fermé") & ~F.substring(hours, 1, 8).rlike(r"\d")
        message = F.when(closed, F.lit("source marks the business as closed (opening hours) - review"))
        out = flag(out, message).withColumn("problems", F.concat("problems", strings(message)))
    return out


@once_a_session
def _checks(schema: Schema, country: str, ignored: frozenset[str]) -> tuple[dict[str, Column], list[Column], list[Column], dict[str, Column]]:
    """Problems of values as columns __p_<field>; then, of those, problems, flags and new cells."""
    problems, flags, cells = [], [], {}
    for f in schema.fields:
        label, v = f.display.lower(), value(f.name)
        problem = F.col(f"__p_{f.name}")
        missing = F.when(v.isNull(), F.lit(f"missing required field: {label}")) if f.required and f.name not in ignored else F.lit(None).cast("string")
        problems.append(F.coalesce(missing, F.concat(F.lit(f"{label}: "), problem)))
        flags.append(F.coalesce(missing, F.concat(F.lit(f"{label} "), problem)))
        c = F.col(f.column)
        cells[f.column] = F.when(problem.isNotNull(), changed(c, status="invalid", note=noted(c, problem))).otherwise(c)
    return {f"__p_{f.name}": let(value(f.name), lambda v, f=f: validate_field(f, v, country)) for f in schema.fields}, problems, flags, cells


def validate_table(records: DataFrame, schema: Schema, country: str = "BE", ignore_missing: Iterable[str] = ()) -> DataFrame:
    """Adds ``problems`` (array), marks invalid cells and flags missing required fields and problems."""
    found, problems, flags, cells = _checks(schema, country, frozenset(ignore_missing))
    out = flag(records.withColumns(found).withColumn("problems", strings(*problems)), *flags).withColumns(cells)
    return cross_field_checks(out.drop(*found), schema)


def verify_phones(records: DataFrame, region: str = "BE") -> DataFrame:
    """Notes type and region of valid telephone numbers; others become invalid and are flagged."""
    out = records.withColumn("__i", F.when(value("phone").isNotNull(), codes.phone_info(value("phone"), region)))
    c, i = F.col("f_phone"), F.col("__i")
    good = changed(c, note=noted(c, F.concat(i["type"], F.lit(" number ("), i["region"], F.lit(")"))))
    bad = changed(c, status="invalid", note=noted(c, i["reason"]))
    out = flag(out, F.when(~i["valid"], F.lit("phone number is not valid for its region")))
    return out.withColumn("f_phone", F.when(i.isNull(), c).when(i["valid"], good).otherwise(bad)).drop("__i")


def completeness(schema: Schema) -> Column:
    """Share of fields with a value, required ones counted twice, in percent."""
    weight = {f.name: 2 if f.required else 1 for f in schema.fields}
    have = sum((F.when(value(n).isNotNull(), w).otherwise(0) for n, w in weight.items()), F.lit(0))
    return F.bround(100.0 * have / sum(weight.values()), 1)


def quality(schema: Schema) -> Column:
    """(verified cells, completeness, filled cells): the larger, the better the record."""
    count = lambda test: sum((F.when(test(n), 1).otherwise(0) for n in schema.names), F.lit(0))
    return F.struct(count(lambda n: status(n) == "verified").alias("verified"), completeness(schema).alias("completeness"), count(lambda n: value(n).isNotNull()).alias("filled"))


@once_a_session
def _status(schema: Schema, ignored: frozenset[str], audit: bool, merging: bool) -> tuple[Column, Column]:
    """The status, and the flag of records without a name."""
    name = schema.name_field
    merged = (F.coalesce("duplicate_of", F.lit("")) != "") if merging else F.lit(False)
    nameless = value(name).isNull()
    some = lambda test, names=schema.names: F.exists(F.array(*[test(n) for n in names]), lambda x: x) if names else F.lit(False)
    has = lambda n, s: value(n).isNotNull() & (status(n) == s)
    missing = some(lambda n: value(n).isNull(), [f.name for f in schema.required if f.name not in ignored])
    told = F.exists("flags", lambda x: ~x.startswith("note:") & F.lower(x).rlike("review|duplicate"))
    review = some(lambda n: has(n, "invalid") | has(n, "conflict")) | missing | told
    contacts = sum((F.when(has(f.name, "verified"), 1).otherwise(0) for f in schema.fields if f.type in ("email", "url", "phone", "vat")), F.lit(0))
    out = (
        F.when(merged | nameless, "NEEDS_REVIEW" if audit else "EXCLUDED").when(review, "NEEDS_REVIEW")
        .when((contacts >= 2) | ((contacts >= 1) & has(name, "verified")), "VERIFIED").when(some(lambda n: has(n, "verified")), "PARTIALLY_VERIFIED").otherwise("UNVERIFIED")
    )
    label = schema.field(name).display.lower()
    return out, F.when(~merged & nameless, F.lit(f"missing {label} - record unusable"))


def assign_status(records: DataFrame, schema: Schema, ignore_missing: Iterable[str] = (), audit: bool = False) -> DataFrame:
    """Adds ``status``; records without a name are flagged. In an audit nothing is excluded, only sent to review."""
    out, unusable = _status(schema, frozenset(ignore_missing), audit, "duplicate_of" in records.columns)
    return flag(records.withColumn("status", out), unusable)


def approval_blockers(schema: Schema) -> Column:
    """Why a record can't be approved: an array, empty if it can."""
    out = [F.when(value(f.name).isNull(), F.lit(f"Missing required field: {f.display}")) for f in schema.required]
    out += [F.when(status(n).isin("invalid", "conflict"), F.concat(F.lit(f"{n}: "), status(n))) for n in schema.names]
    out.append(F.when((F.coalesce("duplicate_of", F.lit("")) != "") | (F.col("status") == "EXCLUDED"), F.lit("Record is excluded or merged")))
    return strings(*out)


def delivered(records: DataFrame) -> DataFrame:
    return records.where("status <> 'EXCLUDED'")


def needs_review(records: DataFrame) -> DataFrame:
    """Records to review, and excluded ones that weren't merged away."""
    return records.where("status = 'NEEDS_REVIEW' or (status = 'EXCLUDED' and coalesce(duplicate_of, '') = '')")


def search(records: DataFrame, query: str, columns: Iterable[Column | str], statuses: Iterable[str] = ()) -> DataFrame:
    """Records in which some of the columns hold the text, in any case, optionally of some statuses."""
    hit = F.lower(F.concat_ws(" ", *columns)).contains(query.lower())
    return records.where(hit & F.col("status").isin(*statuses)) if statuses else records.where(hit)


def enrichment_target(kind: str, schema: Schema, wanted: Iterable[str] = ()) -> Column:
    """Which records an enrichment may touch: website, search, profile or vat."""
    site, name = value("website"), value(schema.name_field)
    lacking = F.exists(F.array(*[value(n).isNull() for n in wanted if schema.field(n)] or [F.lit(False)]), lambda x: x)
    return {
        "website": lambda: site.isNotNull() & name.isNotNull(), "search": lambda: site.isNull() & name.isNotNull(),
        "profile": lambda: site.isNotNull() & lacking, "vat": lambda: value("vat_number").isNotNull(),
    }[kind]()


def rank(c: Column) -> Column:
    """The rank of a cell status."""
    out = F.lit(-1)
    for name, r in FIELD_RANK.items():
        out = F.when(c == name, r).otherwise(out)
    return out


