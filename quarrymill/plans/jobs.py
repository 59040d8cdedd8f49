"""Whole jobs over record tables: the audit of a list and a project run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import enrich, matching, reports, rules
from quarrymill.operators.records import value
from quarrymill.operators.run_log import RunLog
from quarrymill.schema import Schema
from quarrymill.storage import stored


def audit(records: DataFrame, schema: Schema, country: str = "BE", threshold: int = 90, optional: Iterable[str] = (), pair_budget: int | None = None) -> dict:
    """Normalise, validate, find duplicates (flags only) and rate a list; nothing is left out. Gives records, groups, reports, and the log of the run."""
    own = schema.optional(optional) if optional else schema
    log = RunLog()
    normal = log.stage("load & normalise", rules.normalize_table(records, own, country))
    checked = log.stage("validate", rules.validate_table(normal, own, country), warnings={"there are values that are not in their form": F.size("problems") > 0})
    found, groups = matching.dedupe(checked, own, threshold, merge=False, pair_budget=pair_budget)
    found = log.stage("duplicates", found, "flagged, not merged")
    out = log.stage("status", rules.assign_status(found, own, audit=True))
    return {
        "records": out, "groups": groups, "status_counts": reports.status_counts(out), "problem_counts": reports.problem_counts(out), "field_completeness": reports.field_completeness(out, own),
        "flag_counts": reports.flag_counts(out), "stages": log.table(records.sparkSession), "log": log,
    }


def record_ids(records: DataFrame, schema: Schema, project: str, prefix: str | None = None) -> DataFrame:
    """Ids ``PRE-0001`` by lower name (missing ones last) and source id."""
    letters = "".join(c for c in project.upper() if c.isalpha())[:3]
    start = prefix or (letters or "REC").ljust(3, "X")
    keyed = records.withColumn("__by", F.lower(F.coalesce(value(schema.name_field), F.lit("~"))))
    out = matching.numbered(keyed, ["__by", "source_id", "ord"])
    number = F.col("number").cast("string")
    return out.withColumns({"record_id": F.concat(F.lit(f"{start}-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))), "ord": F.col("number")}).drop("number", "__by")


def run_pipeline(records: DataFrame, schema: Schema, project: str, country: str = "BE", sites: DataFrame | None = None, hits: DataFrame | None = None, profiles: DataFrame | None = None, register: DataFrame | None = None, mail_domains: DataFrame | None = None, threshold: int = 90, merge: bool = True, max_queries: int | None = None) -> dict:
    """A project run over extracted records; enrichment stages without a landed table are left out (all of them: an offline run).

    ``sites`` is a function of records to site rows, as it depends on the websites found so far; it is asked again for the websites that the search
    finds. ``max_queries`` limits the records that are searched for, the others are told of in a warning.
    """
    log = RunLog()
    # side tables are stored, as their rows decide on a broadcast, which the size of the files they come from says little of
    side = {k: v if v is None else stored(v, k) for k, v in (("hits", hits), ("profiles", profiles), ("register", register), ("mail-domains", mail_domains))}
    hits, profiles, register, mail_domains = side.values()
    out = log.stage("extract & normalise", rules.normalize_table(records, schema, country))
    out = log.stage("number", record_ids(out, schema, project))
    if sites is not None:
        out = log.stage("sites", enrich.apply_site(out, sites(out), schema))
    if hits is not None:
        wanted = out.where(rules.enrichment_target("search", schema)).count() if max_queries is not None else 0
        if wanted > (max_queries or 0):
            log.warn(f"{wanted} records have no website; searching for the first {max_queries} only")
        before = out.select("record_id", value("website").isNull().alias("__lacked"))
        out = log.stage("search", enrich.find_missing_websites(out, hits, schema, max_queries))
        if sites is not None:
            found = out.join(before, "record_id").where(F.col("__lacked") & value("website").isNotNull()).drop("__lacked")
            out = log.stage("sites of hits", enrich.apply_site(out, sites(found), schema))
    if profiles is not None:
        out = log.stage("profiles", enrich.apply_org_profiles(out, profiles, schema))
    if register is not None:
        out = log.stage("vat", enrich.apply_vat_register(out, register, schema, country))
    if mail_domains is not None:
        out = log.stage("mail domains", enrich.apply_mail_domains(out, mail_domains))
    out = log.stage("verify", rules.verify_phones(out, country)) if schema.field("phone") else out
    out = log.stage("validate", rules.validate_table(out, schema, country), warnings={"there are values that are not in their form": F.size("problems") > 0})
    out, groups = matching.dedupe(out, schema, threshold, merge)
    out = log.stage("status", rules.assign_status(out, schema))
    return {"records": reports.in_delivery_order(out, schema), "groups": groups, "summary": reports.summary_table(out, groups, schema), "stages": log.table(records.sparkSession), "log": log, "review_queue": reports.review_queue(out, schema), "delivery": reports.delivery_cells(out, schema, country)}
