"""Joins of records with landed side tables: registers, mail domains, profiles, search hits and site contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import codes, web
from quarrymill.functions.similarity import set_ratio, word_sets
from quarrymill.functions.text import let, name_key
from quarrymill.operators.pages import GENERIC_MAILBOXES
from quarrymill.operators.records import flag, marked, set_value, status, strings, value, with_candidates
from quarrymill.operators.rules import enrichment_target
from quarrymill.schema import Schema
from quarrymill.storage import stored


def apply_mail_domains(records: DataFrame, domains: DataFrame) -> DataFrame:
    """Mail-domain facts (domain, deliverable, detail): a domain that takes no mail makes the address invalid."""
    own = domains.select(F.col("domain").alias("__domain"), "deliverable", F.coalesce("detail", F.lit("")).alias("detail")) if "detail" in domains.columns else domains.select(F.col("domain").alias("__domain"), "deliverable", F.lit("").alias("detail"))
    out = records.withColumn("__domain", web.email_domain(value("email"))).join(own, "__domain", "left")
    c, mail, open_ = F.col("f_email"), value("email"), status("email") == "unverified"
    bad = mail.isNotNull() & ~web.is_valid_email(mail)
    dead = mail.isNotNull() & ~bad & (F.col("deliverable") == F.lit(False))
    out = flag(out, F.when(bad, F.lit("e-mail has an invalid format")), F.when(dead, F.concat(F.lit("e-mail domain cannot receive mail ("), F.col("detail"), F.lit(")"))))
    cell = (
        F.when(bad, marked(c, "invalid", "invalid e-mail syntax")).when(dead, marked(c, "invalid", F.concat(F.lit("mail domain check failed: "), F.col("detail"))))
        .when(mail.isNotNull() & open_ & F.coalesce(F.col("deliverable"), F.lit(False)), marked(c, "unverified", "domain accepts mail; address itself not confirmed by a second source"))
        .when(mail.isNotNull() & open_, marked(c, "unverified", "mail-domain check unavailable")).otherwise(c)
    )
    return out.withColumn("f_email", cell).drop("__domain", "deliverable", "detail")


def apply_vat_register(records: DataFrame, register: DataFrame, schema: Schema, country: str = "BE") -> DataFrame:
    """A VAT register's answers (vat, valid, name, address, error): confirmed, refused or unknown numbers, legal names and postcodes."""
    name = schema.name_field
    own = register.select(F.col("vat").alias("__vat"), *[F.col(c).alias(f"__{c}") for c in ("valid", "name", "address", "error")])
    out = records.withColumn("__vat", codes.normalize_vat(value("vat_number"), country)).join(own, "__vat", "left")
    local = (F.length("__vat") < 4) | (codes.is_valid_vat("__vat") == F.lit(False))
    valid = F.when(local, False).otherwise(F.col("__valid"))
    why = F.when(F.length("__vat") < 4, "malformed").when(local, "format/checksum invalid").otherwise(F.nullif(F.col("__error"), F.lit("")))
    out = out.withColumns({"__ok": valid, "__why": F.coalesce(why, F.lit("not registered")), "__there": value("vat_number").isNotNull(), "__legal": F.when(valid, F.nullif(F.col("__name"), F.lit(""))), "__unknown": F.coalesce(why, F.lit("no answer"))})
    ok, there = F.col("__ok"), F.col("__there")
    # what is named in many places is stored, as each place would repeat its expression: the keys, their words, and what comes of them
    out = out.withColumns({"__key": F.when(F.col("__legal").isNotNull(), name_key(value(name))), "__legal_key": name_key("__legal")})
    out = out.withColumns({"__pc": codes.vat_address_part("__address", "postcode"), "__town": codes.vat_address_part("__address", "city"), "__words": word_sets(F.col("__key"), F.col("__legal_key"))})
    out = stored(out.drop("__key", "__legal_key"), "register-answers")
    alike = set_ratio(F.col("__words"), 70.0) >= 70
    out = out.withColumn("__alike", F.coalesce(F.when(value(name).isNotNull() & F.col("__legal").isNotNull(), alike), F.lit(False)))
    out = stored(out.drop("__words"), "register-names")
    c = F.when(F.col("__vat") != value("vat_number"), set_value(F.col("f_vat_number"), F.col("__vat"), F.col("f_vat_number.source"), F.col("f_vat_number.status"))).otherwise(F.col("f_vat_number"))
    cell = let(c, lambda c: F.when(~there, c).when(ok, marked(c, "verified", F.concat(F.lit("valid in VIES"), F.coalesce(F.concat(F.lit(" - registered to "), F.col("__legal")), F.lit(""))), False)).when(~ok, marked(c, "invalid", F.concat(F.lit("rejected by VIES ("), F.col("__why"), F.lit(")")))).otherwise(marked(c, "unverified", F.concat(F.lit("could not be checked ("), F.col("__unknown"), F.lit(")")))))
    new = {"f_vat_number": F.when(there, cell).otherwise(F.col("f_vat_number"))}
    if schema.field("legal_name"):
        new["f_legal_name"] = F.when(there & ok & F.col("__legal").isNotNull() & value("legal_name").isNull(), set_value(F.col("f_legal_name"), F.col("__legal"), "vies", "verified", "registered name in the VAT register")).otherwise(F.col("f_legal_name"))
    new[f"f_{name}"] = F.when(there & ok & F.col("__alike"), marked(F.col(f"f_{name}"), "verified", "matches the registered name in the VAT register")).otherwise(F.col(f"f_{name}"))
    out = flag(
        out, F.when(there & ok & ~F.col("__alike") & F.col("__legal").isNotNull(), F.concat(F.lit("note: legal entity name ("), F.col("__legal"), F.lit(") differs from trade name"))),
        F.when(there & ok & (F.col("__pc") != "") & (value("postcode") != F.col("__pc")), F.concat(F.lit("note: VAT registered address is "), F.col("__pc"), F.lit(" "), F.col("__town"), F.lit(" (different postcode)"))) if schema.field("postcode") else F.lit(None).cast("string"),
        F.when(there & ~ok, F.lit("VAT number is not valid according to the EU VIES register")), F.when(there & ok.isNull(), F.concat(F.lit("VAT number could not be verified ("), F.col("__unknown"), F.lit(") - unverified"))),
    )
    return out.withColumns(new).select(*records.columns)


def apply_org_profiles(records: DataFrame, profiles: DataFrame, schema: Schema, limit: int | None = None) -> DataFrame:
    """Organisation profiles by website domain: fill gaps, confirm equal LinkedIn pages, keep other values as candidates."""
    wanted = [n for n in ("linkedin", "industry", "employees", "founded", "description", "phone", "facebook", "subcategory") if schema.field(n)]
    side = profiles.select(web.url_domain("website").alias("__domain"), *[F.col("industry" if n == "subcategory" else n).cast("string").alias(f"__{n}") for n in wanted]).where("__domain is not null")
    side = side.groupBy("__domain").agg(F.min(F.struct(*[F.coalesce(f"__{n}", F.lit("")).alias(f"__{n}") for n in wanted])).alias("p")).select("__domain", "p.*")
    target = enrichment_target("profile", schema, wanted)
    out = records.withColumn("__domain", F.when(target, web.url_domain(value("website"))))
    if limit:
        chosen = out.where("__domain is not null").orderBy("ord").limit(limit).select("record_id", F.lit(True).alias("__chosen"))
        out = out.join(chosen, "record_id", "left").withColumn("__domain", F.when(F.col("__chosen"), F.col("__domain"))).drop("__chosen")
    out = out.join(side, "__domain", "left")
    new = {}
    for n in wanted:
        c, v = F.col(f"f_{n}"), F.nullif(F.col(f"__{n}"), F.lit(""))
        plain = lambda x: F.lower(F.rtrim(x, F.lit("/")))
        other = with_candidates(c, F.array(v))
        have = F.when(plain(value(n)) == plain(v), marked(c, "verified", "confirmed by organisation profile")).otherwise(other) if n == "linkedin" else other
        new[f"f_{n}"] = F.when(v.isNull(), c).when(value(n).isNull(), set_value(c, v, "profile", "unverified", "from organisation profile")).otherwise(have)
    return out.withColumns(new).select(*records.columns)


def search_targets(records: DataFrame, schema: Schema, max_queries: int | None = None) -> DataFrame:
    """The records that a search may look up: those without a website, at most the first ``max_queries`` of them."""
    own = records.where(enrichment_target("search", schema))
    return own if max_queries is None else own.orderBy("ord", "record_id").limit(max_queries)


def best_websites(records: DataFrame, hits: DataFrame, schema: Schema, max_queries: int | None = None) -> DataFrame:
    """(record_id, url, title, score): the best search hit of each record without a website (see search_targets()). Hits: record_id, place, url, title, snippet."""
    key = name_key("__name")
    rows = search_targets(records, schema, max_queries).select("record_id", value(schema.name_field).alias("__name")).join(hits, "record_id")
    # stored: the filters would repeat the forms of the URL, and the score those of the names
    rows = stored(rows.withColumns({"url": web.normalize_url("url"), "__key": key}), "hit-urls").where(F.col("url").isNotNull())
    rows = stored(rows.withColumn("__domain", web.url_domain("url")).withColumn("__directory", web.is_directory("url")).withColumn("__hay", name_key(F.concat_ws(" ", "title", "snippet", "__domain"))), "hit-texts").where("not __directory")
    words = F.filter(F.split("__key", " "), lambda t: F.length(t) > 2)
    compact = F.replace(F.col("__key"), F.lit(" "), F.lit(""))
    host = F.translate(F.col("__domain"), "-.", "")
    score = F.when((F.col("__key") != "") & F.col("__hay").contains(F.col("__key")), 3).otherwise(0) + F.size(F.filter(words, lambda t: F.col("__hay").contains(t))) + F.when((compact != "") & host.contains(compact), 4).otherwise(0)
    order = Window.partitionBy("record_id").orderBy(F.desc("score"), "place")
    return rows.withColumn("score", score).where("score > 0").withColumn("n", F.row_number().over(order)).where("n = 1").select("record_id", "url", "title", "score")


def find_missing_websites(records: DataFrame, hits: DataFrame, schema: Schema, max_queries: int | None = None) -> DataFrame:
    """Records with the website that a search found, unverified and flagged."""
    best = best_websites(records, hits, schema, max_queries).select("record_id", F.col("url").alias("__url"), F.substring("title", 1, 80).alias("__title"))
    out = records.join(best, "record_id", "left")
    found = F.col("__url").isNotNull()
    cell = set_value(F.col("f_website"), F.col("__url"), "search", "unverified", F.concat(F.lit("found via web search: "), F.col("__title")))
    out = flag(out, F.when(found, F.lit("website found via web search - verify")))
    return out.withColumn("f_website", F.when(found, cell).otherwise(F.col("f_website"))).select(*records.columns)


def apply_site(records: DataFrame, sites: DataFrame, schema: Schema) -> DataFrame:
    """Site evidence by website domain (site, outcome, http_status, final_url, error, name_score by record, emails, phones, vat_numbers, socials
    map<string,string>, description); contacts count only where the name was found on the site.

    ``sites`` has one row per record_id: the site as it was read for that record.
    """
    name = schema.name_field
    side = sites.select("record_id", *[F.col(c).alias(f"__{c}") for c in sites.columns if c != "record_id"])
    out = records.join(side, "record_id", "left")
    there = F.col("__outcome").isNotNull()
    up = F.col("__outcome").isin("live", "redirected")
    usable = up & (F.coalesce("__error", F.lit("")) == "")
    match = usable & (F.coalesce("__name_score", F.lit(0.0)) >= 90)
    other = usable & ~match
    site = F.col("f_website")
    unread = there & F.col("__outcome").isin("blocked", "unchecked")
    down = there & ~up & ~unread
    detail = F.coalesce(F.nullif(F.col("__error"), F.lit("")), F.concat(F.lit("HTTP "), F.col("__http_status").cast("string")))
    note = F.concat(F.lit("live (HTTP "), F.col("__http_status").cast("string"), F.lit(")"), F.when(F.col("__outcome") == "redirected", F.concat(F.lit("; redirects to "), F.col("__final_url"))).otherwise(F.lit("")))
    percent = F.coalesce(F.col("__name_score"), F.lit(0.0)).cast("int").cast("string")
    moved = F.when(F.col("__outcome") == "redirected", with_candidates(site, F.array("__final_url"))).otherwise(site)
    by_search = F.coalesce(site["source"], F.lit("")).startswith("search")
    found = F.when(by_search, F.lit(" (found via web search, confirmed)")).otherwise(F.lit(""))
    new = {
        "f_website": F.when(unread, marked(site, "unverified", F.concat(F.lit("could not be checked automatically ("), detail, F.lit(")"))))
        .when(down, marked(site, "invalid", F.concat(F.col("__outcome"), F.lit(": "), detail)))
        .when(up & ~usable, marked(site, "unverified", F.concat(F.lit("live but "), F.col("__error"))))
        .when(match, marked(moved, "verified", F.concat(note, F.lit("; company name found on page"), found), False))
        .when(other, marked(moved, "unverified", F.concat(note, F.lit("; company name not found on page (similarity "), percent, F.lit("%)")), False)).otherwise(site),
        f"f_{name}": F.when(match, marked(F.col(f"f_{name}"), "verified", "confirmed on company website")).otherwise(F.col(f"f_{name}")),
    }
    flags: list[Column] = [
        F.when(unread, F.concat(F.lit("note: website could not be checked automatically ("), detail, F.lit(") - open it manually"))), F.when(down, F.concat(F.lit("website unreachable ("), detail, F.lit(")"))),
        F.when(other & (by_search | (F.coalesce(F.col("__name_score"), F.lit(0.0)) < 60) | (F.col("__outcome") == "redirected")), F.lit("website could not be linked to the company name - review")),
        F.when(other, F.lit("website identity not confirmed; extracted contacts were not applied - review")),
    ]
    if schema.field("email"):
        domain, c, mails = web.url_domain("__final_url"), F.col("f_email"), F.coalesce("__emails", strings())
        own = F.filter(mails, lambda e: (web.email_domain(e) == domain) | web.email_domain(e).endswith(F.concat(F.lit("."), domain)))
        best = F.get(mails, F.lit(0))
        sure = F.array_contains(own, best) | F.lower(F.substring_index(best, "@", 1)).isin(*GENERIC_MAILBOXES)
        clash = match & value("email").isNotNull() & ~F.array_contains(mails, F.lower(value("email"))) & (F.size(own) > 0)
        taken = with_candidates(F.when(sure, set_value(c, best, "website", "verified", "found on company website")).otherwise(set_value(c, best, "website", "unverified", "found on company website (third-party mail domain; may be a personal or agency address)")), F.slice(mails, 2, 3))
        new["f_email"] = (
            F.when(~match, c).when(value("email").isNull(), F.when(best.isNotNull(), taken).otherwise(c)).when(F.array_contains(mails, F.lower(value("email"))), marked(c, "verified", "confirmed on company website", False))
            .when(clash, marked(with_candidates(c, F.slice(own, 1, 3)), "conflict", F.concat(F.lit("website lists "), F.array_join(F.slice(own, 1, 2), ", "), F.lit(" instead")))).otherwise(marked(c, "unverified", "not found on company website"))
        )
        flags.append(F.when(clash, F.concat(F.lit("e-mail differs from the company website ("), F.get(own, F.lit(0)), F.lit(") - review"))))
    if schema.field("phone"):
        c, numbers = F.col("f_phone"), F.coalesce("__phones", strings())
        first = F.get(numbers, F.lit(0))
        new["f_phone"] = (
            F.when(~match | first.isNull(), c).when(value("phone").isNull(), with_candidates(set_value(c, first, "website", "verified", "found on company website"), F.slice(numbers, 2, 2)))
            .when(F.array_contains(numbers, value("phone")), marked(c, "verified", "confirmed on company website", False))
            .otherwise(marked(with_candidates(c, F.slice(numbers, 1, 3)), "unverified", F.concat(F.lit("website lists other number(s): "), F.array_join(F.slice(numbers, 1, 2), ", "))))
        )
    for n in [n for n in web.SOCIAL_HOSTS if schema.field(n)]:
        c, link = F.col(f"f_{n}"), F.col("__socials")[n]
        plain = lambda x: F.lower(F.rtrim(x, F.lit("/")))
        new[f"f_{n}"] = (
            F.when(~match | link.isNull(), c).when(value(n).isNull(), set_value(c, link, "website", "verified", "linked from company website")).when(plain(value(n)) == plain(link), marked(c, "verified", "confirmed on company website", False))
            .otherwise(marked(with_candidates(c, F.array(link)), "unverified", F.concat(F.lit("website links to "), link)))
        )
    if schema.field("vat_number"):
        c, numbers = F.col("f_vat_number"), F.coalesce("__vat_numbers", strings())
        first = F.get(numbers, F.lit(0))
        clash = match & first.isNotNull() & value("vat_number").isNotNull() & ~F.array_contains(numbers, value("vat_number"))
        new["f_vat_number"] = (
            F.when(~match | first.isNull(), c).when(value("vat_number").isNull(), set_value(c, first, "website", "unverified", "found on company website"))
            .when(clash, marked(with_candidates(c, F.array(first)), "conflict", F.concat(F.lit("website shows "), first))).otherwise(marked(c, "verified", "confirmed on company website", False))
        )
        flags.append(F.when(clash, F.concat(F.lit("VAT number differs from the company website ("), first, F.lit(") - review"))))
    if schema.field("description"):
        new["f_description"] = F.when(match & value("description").isNull() & (F.coalesce("__description", F.lit("")) != ""), set_value(F.col("f_description"), F.col("__description"), "website", "unverified", "meta description of the website")).otherwise(F.col("f_description"))
    out = out.withColumn("flags", F.when(match & by_search, F.filter("flags", lambda f: ~f.contains("found via web search"))).otherwise(F.col("flags")))
    return flag(out, *flags).withColumns(new).select(*records.columns)


