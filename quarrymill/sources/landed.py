"""Landed JSON answers of map, knowledge-graph, places and organisation services as rows of schema fields.

Each function takes a DataFrame of one answer item per row and gives plain columns for records.to_records(), with source_id,
source_url and flags.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.records import strings

#: Tags that hold a field, the best first.
TAGS = {
    "phone": ("contact:phone", "phone", "contact:mobile", "mobile"), "email": ("contact:email", "email"), "website": ("contact:website", "website", "url"), "facebook": ("contact:facebook",),
    "instagram": ("contact:instagram",), "linkedin": ("contact:linkedin",), "vat_number": ("ref:vatin", "ref:BE:KBO", "ref:vat"), "opening_hours": ("opening_hours",), "description": ("description",),
    "street": ("addr:street",), "house_number": ("addr:housenumber",), "postcode": ("addr:postcode",), "city": ("addr:city",), "district": ("addr:suburb", "addr:district"), "country": ("addr:country",),
}
NAME_TAGS = ("name", "name:nl", "name:en", "name:fr", "brand")
CATEGORY_TAGS = ("amenity", "shop", "office", "craft", "tourism", "leisure", "healthcare", "industrial")
SUBCATEGORY_TAGS = ("cuisine", "office", "craft", "healthcare:speciality", "shop", "brand")
#: Kinds of places that an area may be, the best first.
AREA_TYPES = ("city", "town", "municipality", "village", "administrative", "county", "state")


def _some(*cols: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _tag(name: str) -> Column:
    return F.nullif(F.col("tags")[name], F.lit(""))


def tag_filter(expr: str) -> Column:
    """``k`` or ``k=*``: there; ``k=v``: equal; ``k=a|b``: one of them."""
    key, _, wanted = (p.strip() for p in expr.partition("="))
    have = F.col("tags")[key]
    if wanted in ("", "*"):
        return have.isNotNull()
    return have.rlike(f"^({wanted})$") if "|" in wanted else have == wanted


def select_elements(elements: DataFrame, filters: Iterable[str], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Map elements that fit one of the tag filters, and lie in (south, west, north, east)."""
    fits = F.lit(False)
    for f in filters:
        fits = fits | F.coalesce(tag_filter(f), F.lit(False))
    out = elements.where(fits)
    if bbox:
        lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
        out = out.where(lat.between(bbox[0], bbox[2]) & lon.between(bbox[1], bbox[3]))
    return out


def map_elements(elements: DataFrame) -> DataFrame:
    """Elements (type, id, lat, lon, center, tags map) with tags as rows: named by the first name tag, with category and subcategory."""
    name = _some(*[F.col("tags")[t] for t in NAME_TAGS])
    category = sub = F.lit(None).cast("string")
    for t in reversed(CATEGORY_TAGS):
        below = _some(*[F.col("tags")[s] for s in SUBCATEGORY_TAGS if s != t])
        sub = F.when(_tag(t).isNotNull(), below).otherwise(sub)
        category = F.coalesce(_tag(t), category)
    official = _tag("official_name")
    return elements.where(F.size("tags") > 0).select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_id"), F.concat(F.lit("https://www.openstreetmap.org/"), F.col("type"), F.lit("/"), F.col("id").cast("string")).alias("source_url"),
        name.alias("company_name"), F.when(~official.eqNullSafe(name), official).alias("legal_name"), F.replace(category, F.lit("_"), F.lit(" ")).alias("category"),
        F.replace(F.replace(sub, F.lit("_"), F.lit(" ")), F.lit(";"), F.lit(", ")).alias("subcategory"), *[_some(*[F.col("tags")[t] for t in tags]).alias(f) for f, tags in TAGS.items()],
        F.coalesce("lat", "center.lat").cast("string").alias("latitude"), F.coalesce("lon", "center.lon").cast("string").alias("longitude"),
    )


def resolve_areas(candidates: DataFrame) -> DataFrame:
    """The best boundary for each ``query`` of landed geocoder results, with its area id."""
    place = F.lit(len(AREA_TYPES))
    for k, t in enumerate(AREA_TYPES):
        place = F.when(F.col("addresstype") == t, k).otherwise(place)
    exact = F.when(F.lower("name") == F.lower("query"), 1).otherwise(0)
    boundary = F.when((F.col("category") == "boundary") & (F.col("type") == "administrative"), 0).otherwise(1)
    best = Window.partitionBy("query").orderBy(boundary, place - exact, F.desc(F.coalesce("importance", F.lit(0.0))), "osm_id")
    own = candidates.where(F.col("osm_type").isin("relation", "way")).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    base = F.when(F.col("osm_type") == "relation", 3_600_000_000).otherwise(2_400_000_000)
    return own.withColumn("area_id", (base + F.col("osm_id")).cast("long"))


def area_defaults(rows: DataFrame, area: DataFrame, country: str) -> DataFrame:
    """Missing countries, and missing cities where the area (one row: name, addresstype) is one."""
    city = area.select(F.when(F.col("addresstype").isin("city", "town", "village", "municipality"), F.col("name")).alias("__city")).limit(1)
    out = rows.join(F.broadcast(city), F.lit(True), "left")
    return out.withColumns({"country": F.coalesce("country", F.lit(country)), "city": F.coalesce("city", "__city")}).drop("__city")


def graph_bindings(bindings: DataFrame, country: str) -> DataFrame:
    """Knowledge-graph answers (structs with ``value``) as company rows."""
    v = lambda n: F.nullif(F.col(f"{n}.value"), F.lit("")) if n in bindings.columns else F.lit(None).cast("string")
    node = F.substring_index(F.coalesce(v("company"), F.lit("")), "/", -1)
    name = F.when(v("companyLabel") != node, v("companyLabel"))
    gone = F.substring(v("dissolved"), 1, 10)
    link = F.when(v("linkedin").contains("/"), v("linkedin")).otherwise(F.concat(F.lit("https://www.linkedin.com/company/"), v("linkedin")))
    flags = strings(F.when(name.isNull(), F.lit("no readable name in source (label missing)")), F.concat(F.lit("source marks the company as dissolved ("), gone, F.lit(")")))
    return bindings.select(
        node.alias("source_id"), F.concat(F.lit("https://www.wikidata.org/wiki/"), node).alias("source_url"), name.alias("company_name"), v("legal_name").alias("legal_name"),
        F.nullif(F.btrim(v("industries"), F.lit("; ")), F.lit("")).alias("industry"), v("description").alias("description"), F.substring(v("inception"), 1, 4).alias("founded"), v("employees").alias("employees"),
        v("hq").alias("city"), v("website").alias("website"), v("vat").alias("vat_number"), link.alias("linkedin"), v("phone").alias("phone"), F.regexp_replace(v("email"), "(?i)^mailto:", "").alias("email"),
        F.concat(F.lit("dissolved "), gone).alias("status_note"), F.lit(country).alias("country"), flags.alias("flags"),
    )


def company_rollup(claims: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per company of claims (company, label, property, value): one value per property, industries joined."""
    one = ("legal_name", "website", "inception", "dissolved", "hq", "employees", "vat", "linkedin", "phone", "email", "description")
    pick = [F.min(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in one]
    many = F.array_join(F.array_sort(F.collect_set(F.when(F.col("property") == "industry", F.col("value")))), "; ").alias("industries")
    out = claims.groupBy("company", "label").agg(*pick, many)
    return out.orderBy("company", "label").limit(limit) if limit else out


def places(items: DataFrame) -> DataFrame:
    """Places answers as rows; those that don't operate are flagged."""
    components = F.coalesce("addressComponents", F.array().cast(items.schema["addressComponents"].dataType))
    first = lambda t, short=False: F.try_element_at(F.transform(F.filter(components, lambda c: F.array_contains(c["types"], t)), lambda c: c["shortText"] if short else F.coalesce(c["longText"], c["shortText"])), F.lit(1))
    kinds = F.transform(F.filter(F.slice(F.coalesce("types", strings()), 1, 3), lambda t: ~t.eqNullSafe(F.col("primaryType"))), lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    state = F.col("businessStatus")
    closed = F.when(state != "OPERATIONAL", F.concat(F.lit("source lists the business as "), F.lower(F.replace(state, F.lit("_"), F.lit(" ")))))
    return items.select(
        F.col("id").alias("source_id"), F.col("googleMapsUri").alias("source_url"), F.col("displayName.text").alias("company_name"), F.nullif(F.replace(F.col("primaryType"), F.lit("_"), F.lit(" ")), F.lit("")).alias("category"),
        F.nullif(F.array_join(kinds, ", "), F.lit("")).alias("subcategory"), first("route").alias("street"), first("street_number").alias("house_number"), first("postal_code").alias("postcode"),
        _some(first("locality"), first("postal_town")).alias("city"), _some(first("sublocality"), first("sublocality_level_1")).alias("district"), first("country", True).alias("country"),
        _some(F.col("internationalPhoneNumber"), F.col("nationalPhoneNumber")).alias("phone"), F.col("websiteUri").alias("website"), F.nullif(F.array_join("regularOpeningHours.weekdayDescriptions", "; "), F.lit("")).alias("opening_hours"),
        F.col("editorialSummary.text").alias("description"), F.col("location.latitude").cast("string").alias("latitude"), F.col("location.longitude").cast("string").alias("longitude"), strings(closed).alias("flags"),
    )


def organisations(items: DataFrame) -> DataFrame:
    """Organisation profiles as rows."""
    site = _some(F.col("website_url"), F.concat(F.lit("https://"), F.nullif(F.col("primary_domain"), F.lit(""))))
    phone = F.col("primary_phone.number") if "struct" in dict(items.dtypes)["primary_phone"] else F.col("primary_phone")
    return items.select(
        F.col("id").alias("source_id"), F.coalesce(_some(F.col("linkedin_url"), F.col("website_url")), F.lit("")).alias("source_url"), F.col("name").alias("company_name"), "industry", F.col("industry").alias("category"),
        F.col("short_description").alias("description"), F.col("founded_year").cast("string").alias("founded"), F.col("estimated_num_employees").cast("string").alias("employees"), _some(F.col("street_address"), F.col("raw_address")).alias("street"),
        F.col("postal_code").alias("postcode"), "city", "country", phone.alias("phone"), site.alias("website"), F.col("linkedin_url").alias("linkedin"), F.col("facebook_url").alias("facebook"),
    )


#: Parts of the URLs of a map's and a register's answers, and what a register says that has an answer.
MAP_URL, REGISTER_URL, ANSWERED = "/api/interpreter", "vies/rest-api", ("", "VALID", "INVALID")


def judged_answers(raw: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """``raw`` with answer (the body as VARIANT, null where it is no JSON), usable, and why not: the one place that tells answers from transient
    errors, which services give with status 200 too.

    A map's answer with a remark is none if the remark tells of a runtime error or no elements came; a register's is none with errors or a user error but
    those of an answer; either is none if it can't be read. Other services' answers are usable as they are. A null URL is another service's.
    Unusable rows stay, with their reason: a caller that asks for ``usable`` alone knows what it leaves out.
    """
    url, answer = F.coalesce(url_col, F.lit("")), F.try_parse_json(body_col)
    of = lambda path, kind="string": F.try_variant_get("answer", path, kind)
    is_map, is_register = url.contains(MAP_URL), url.contains(REGISTER_URL)
    remark = F.coalesce(of("$.remark"), F.lit(""))
    empty = F.size(F.coalesce(of("$.elements", "array<variant>"), F.expr("cast(array() as array<variant>)"))) == 0
    errors = F.size(F.coalesce(of("$.errorWrappers", "array<variant>"), F.expr("cast(array() as array<variant>)"))) > 0
    user = F.upper(F.coalesce(of("$.userError"), F.lit("")))
    first = F.coalesce(of("$.errorWrappers[0].error"), F.lit("error"))
    why = (
        F.when((is_map | is_register) & F.col("answer").isNull(), F.lit("unreadable"))
        .when(is_map & (F.lower(remark).contains("runtime error") | (empty & (remark != ""))), remark)
        .when(is_register & errors, first).when(is_register & ~user.isin(*ANSWERED), user).otherwise(F.lit(""))
    )
    return raw.withColumn("answer", answer).withColumn("why", why).withColumn("usable", F.col("why") == "")


def elements_of(judged: DataFrame) -> DataFrame:
    """The elements of usable map answers, as map_elements() takes them. Parts of another type than they should have are null: an element without
    a type, an id or tags is left out by what reads it."""
    own = judged.where("usable").select(F.explode(F.try_variant_get("answer", "$.elements", "array<variant>")).alias("e"))
    of = lambda path, kind: F.try_variant_get("e", path, kind)
    center = F.struct(of("$.center.lat", "double").alias("lat"), of("$.center.lon", "double").alias("lon"))
    rows = own.select(of("$.type", "string").alias("type"), of("$.id", "long").alias("id"), of("$.lat", "double").alias("lat"), of("$.lon", "double").alias("lon"), center.alias("center"), of("$.tags", "map<string,string>").alias("tags"))
    return rows.where("type is not null and id is not null")


def register_rows(judged: DataFrame) -> DataFrame:
    """Register answers as register_answers() takes them; unusable ones too, as their error is shown."""
    of = lambda path, kind="string": F.try_variant_get("answer", path, kind)
    errors = F.transform(of("$.errorWrappers", "array<variant>"), lambda e: F.struct(F.try_variant_get(e, "$.error", "string").alias("error")))
    rows = judged.where(F.col("answer").isNotNull())
    return rows.select(of("$.vatNumber").alias("vatNumber"), of("$.isValid", "boolean").alias("isValid"), of("$.name").alias("name"), of("$.address").alias("address"), of("$.userError").alias("userError"), errors.alias("errorWrappers"))


#: Codes of a register that is busy, not of an answer.
BUSY = ("MS_MAX_CONCURRENT_REQ", "MS_UNAVAILABLE", "SERVICE_UNAVAILABLE", "TIMEOUT", "GLOBAL_MAX_CONCURRENT_REQ", "MS_MAX_CONCURRENT_REQ_TIME")


def register_answers(answers: DataFrame) -> DataFrame:
    """VAT register answers: vat, valid (null where it couldn't be told), name, address, error, usable."""
    user = F.upper(F.coalesce("userError", F.lit("")))
    code = F.coalesce(F.nullif(F.try_element_at(F.transform("errorWrappers", lambda e: e["error"]), F.lit(1)), F.lit("")), F.when(~user.isin("VALID", "INVALID", ""), user))
    shown = lambda c: F.coalesce(F.nullif(F.btrim(c), F.lit("---")), F.lit(""))
    return answers.select(F.col("vatNumber").alias("vat"), F.when(code.isNull(), F.col("isValid")).alias("valid"), shown("name").alias("name"), shown("address").alias("address"), F.coalesce(code, F.lit("")).alias("error"), (~F.coalesce(F.upper(code).isin(*BUSY), F.lit(False))).alias("usable"))


def mail_domains(answers: DataFrame) -> DataFrame:
    """Landed DNS answers (domain, mx and a as Status and Answer) as deliverable (null where unknown)."""
    have = lambda kind, *types: F.exists(F.coalesce(F.col(f"{kind}.Answer"), F.expr("cast(array() as array<struct<type:int,data:string>>)")), lambda x: x["type"].isin(*types))
    null_mx = F.exists(F.coalesce(F.col("mx.Answer"), F.expr("cast(array() as array<struct<type:int,data:string>>)")), lambda x: (x["type"] == 15) & (F.btrim(x["data"]) == "0 ."))
    known = F.col("mx.Status") == 0
    out = (
        F.when(F.col("mx.Status") == 3, False).when(~F.coalesce(known, F.lit(False)), F.lit(None).cast("boolean")).when(null_mx, False).when(have("mx", 15), True)
        .when(~F.coalesce(F.col("a.Status").isin(0, 3), F.lit(False)), F.lit(None).cast("boolean")).otherwise(have("a", 1, 28))
    )
    return answers.select("domain", out.alias("deliverable"))
