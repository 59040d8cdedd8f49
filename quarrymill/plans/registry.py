"""All registered queries of the library's own operators, with their SQL. Names start with the operators' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import codes, numbers, text, web
from quarrymill.operators import matching, pages, reports, rules, workspace
from quarrymill.operators.records import to_records, value
from quarrymill.plans import jobs
from quarrymill.schema import ACCOUNTS
from quarrymill.sources import landed
from quarrymill.storage import spread, stored

#: A list of accounts from the customer table, with the blemishes of real ones; the expressions are SQL of both engines.
K = "CAST(c_custkey AS STRING)"
BASE = "lpad(CAST(4000000 + c_custkey AS STRING), 8, '0')"
CHECK = "lpad(CAST(97 - (4000000 + c_custkey) % 97 AS STRING), 2, '0')"
ACCOUNT_COLUMNS = {
    "ord": "c_custkey",
    "record_id": f"'C' || lpad({K}, 9, '0')",
    "source": "'list' || CAST(c_nationkey % 3 AS STRING)",
    "account_id": f"'AC-' || {K}",
    "company_name": f"CASE WHEN c_custkey % 13 = 5 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' || CAST(c_custkey * 7919 % 1000003 AS STRING) || ' ' || lower(c_mktsegment) || ' NV, ' ELSE CAST(c_custkey * 7919 % 1000003 AS STRING) || ' Été ' || lower(c_mktsegment) END",
    "website": f"CASE c_custkey % 4 WHEN 0 THEN 'Firm{{0}}.be/' WHEN 1 THEN 'https://www.firm{{0}}.be/x/?utm_source=a&b=1#t' WHEN 2 THEN NULL ELSE 'nowhere' END".replace("{0}", f"' || {K} || '"),
    "email": f"CASE c_custkey % 6 WHEN 0 THEN ' MAILTO:Info@Firm{{0}}.be?x=1' WHEN 1 THEN 'info [at] firm{{0}} [dot] be' WHEN 2 THEN NULL WHEN 3 THEN 'broken' WHEN 4 THEN 'a..b@firm{{0}}.be' ELSE 'owner' || CAST(c_custkey - c_custkey % 24 AS STRING) || '@gmail.com' END".replace("{0}", f"' || {K} || '"),
    "phone": "CASE c_custkey % 5 WHEN 0 THEN '04' || CAST(70000000 + c_custkey % 9999999 AS STRING) WHEN 1 THEN '+32 470 ' || CAST(100000 + c_custkey % 899999 AS STRING) WHEN 2 THEN NULL WHEN 3 THEN '12' ELSE 'tel:0470/' || CAST(100000 + c_custkey % 899999 AS STRING) END",
    "vat_number": f"CASE c_custkey % 3 WHEN 0 THEN 'BE' || {BASE} || {CHECK} WHEN 1 THEN 'btw be ' || {BASE} || '.' || lpad(CAST((98 - (4000000 + c_custkey) % 97) % 97 AS STRING), 2, '0') ELSE NULL END",
    "street": "CASE WHEN c_custkey % 2 = 0 THEN 'Street ' || CAST(c_custkey % 97 AS STRING) ELSE NULL END",
    "house_number": "CAST(c_custkey % 50 + 1 AS STRING)",
    "postcode": "CASE WHEN c_custkey % 11 = 5 THEN 'AB' || CAST(c_custkey % 997 AS STRING) WHEN c_custkey % 11 = 6 THEN NULL ELSE 'b-' || CAST(1000 + c_custkey % 8999 AS STRING) END",
    "city": "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'City ' || CAST(c_nationkey AS STRING) END",
    "country": "'BE'",
    "category": "c_mktsegment",
}
ACCOUNTS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ACCOUNT_COLUMNS.items()) + " FROM customer"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "customer")).selectExpr(*[f"{e} AS {n}" for n, e in ACCOUNT_COLUMNS.items()])


def account_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_records(account_rows(spark, sf_dir), ACCOUNTS)


def checked_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is stored: a filter that were pushed through them would repeat their expressions over and over."""
    return stored(rules.validate_table(stored(rules.normalize_table(account_records(spark, sf_dir), ACCOUNTS), "normal"), ACCOUNTS), "checked")


def rated_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(rules.assign_status(checked_accounts(spark, sf_dir).withColumn("duplicate_of", F.lit("")), ACCOUNTS), "rated")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- what the SQL side says about one account: values in their form, and whether they are sound

_NORMAL = f"""
WITH a AS ({ACCOUNTS_SQL}),
n AS (SELECT ord, record_id, source, account_id, category,
    nullif(trim(regexp_replace(company_name, '\\s+', ' ', 'g'), ' -–|,;:'), '') AS company_name,
    CASE ord % 4 WHEN 0 THEN 'https://firm' || ord || '.be/' WHEN 1 THEN 'https://www.firm' || ord || '.be/x?b=1' ELSE NULL END AS website, website AS raw_website,
    CASE WHEN ord % 6 IN (0, 1) THEN 'info@firm' || ord || '.be' WHEN ord % 6 = 4 THEN 'a..b@firm' || ord || '.be' WHEN ord % 6 = 5 THEN 'owner' || (ord - ord % 24) || '@gmail.com' ELSE NULL END AS email, email AS raw_email,
    CASE WHEN phone IS NULL OR phone = '12' THEN NULL ELSE regexp_replace(regexp_replace(regexp_replace(phone, 'tel:', ''), '[^0-9+]', '', 'g'), '^0', '+32') END AS phone, phone AS raw_phone,
    regexp_replace(regexp_replace(upper(vat_number), '[ .]', '', 'g'), '^BTW', '') AS vat_number,
    trim(street) AS street, house_number, regexp_replace(upper(postcode), 'B-', '') AS postcode, nullif(trim(city), '') AS city, country FROM a),
v AS (SELECT *, ord % 6 = 4 AS bad_email, phone IS NOT NULL AND NOT regexp_matches(phone, '^[+]324[5-9][0-9]{{7}}$') AS bad_phone,
    starts_with(postcode, 'AB') AS bad_postcode, ord % 3 = 1 AS bad_vat, raw_website IS NOT NULL AND website IS NULL AS odd_website, raw_email IS NOT NULL AND email IS NULL AS odd_email, raw_phone IS NOT NULL AND phone IS NULL AS odd_phone,
    email IS NOT NULL AND website IS NOT NULL AND NOT ends_with(email, '@gmail.com') AND split_part(email, '@', 2) <> 'firm' || ord || '.be' AS apart FROM n),
s AS (SELECT *, CASE WHEN company_name IS NULL THEN 'EXCLUDED' WHEN bad_email OR bad_phone OR coalesce(bad_postcode, false) OR bad_vat OR apart THEN 'NEEDS_REVIEW' ELSE 'UNVERIFIED' END AS status FROM v)
"""


@query(_NORMAL + "SELECT d.status, count(s.ord)::BIGINT AS n FROM (SELECT unnest(['VERIFIED','PARTIALLY_VERIFIED','UNVERIFIED','NEEDS_REVIEW','EXCLUDED']) AS status) d LEFT JOIN s ON s.status = d.status GROUP BY 1")
def slice0_status_counts(spark, sf_dir):
    """A6, P1, P4, P5, P9, G1 over the account list."""
    return reports.status_counts(rated_accounts(spark, sf_dir))


@query(_NORMAL + "SELECT record_id, account_id, company_name, website, email, phone, vat_number, street, postcode, city FROM s")
def p1_p2_normalize_table(spark, sf_dir):
    out = rules.normalize_table(account_records(spark, sf_dir), ACCOUNTS)
    return out.select("record_id", *[value(n).alias(n) for n in ("account_id", "company_name", "website", "email", "phone", "vat_number", "street", "postcode", "city")])


@query(_NORMAL + """SELECT record_id, (CASE WHEN company_name IS NULL THEN 1 ELSE 0 END + CASE WHEN bad_email THEN 1 ELSE 0 END + CASE WHEN bad_phone THEN 1 ELSE 0 END
  + CASE WHEN bad_postcode THEN 1 ELSE 0 END + CASE WHEN bad_vat THEN 1 ELSE 0 END + CASE WHEN apart THEN 1 ELSE 0 END)::BIGINT AS n_problems,
  bad_email AS email_invalid, coalesce(bad_postcode, false) AS postcode_invalid FROM s""")
def p3_p4_p5_validate_table(spark, sf_dir):
    out = checked_accounts(spark, sf_dir)
    bad = lambda n: (F.col(f"f_{n}.status") == "invalid") & value(n).isNotNull()
    return out.select("record_id", F.size("problems").cast("long").alias("n_problems"), F.coalesce(bad("email"), F.lit(False)).alias("email_invalid"), F.coalesce(bad("postcode"), F.lit(False)).alias("postcode_invalid"))


@query(_NORMAL + """SELECT record_id, round_even(100.0 * (2 + CASE WHEN company_name IS NULL THEN 0 ELSE 2 END + (website IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (vat_number IS NOT NULL)::INT
  + (street IS NOT NULL)::INT + 1 + (postcode IS NOT NULL)::INT + (city IS NOT NULL)::INT + 1 + 1) / 14, 1)::DOUBLE AS completeness FROM s""")
def g7_record_completeness(spark, sf_dir):
    return rules.normalize_table(account_records(spark, sf_dir), ACCOUNTS).select("record_id", rules.completeness(ACCOUNTS).alias("completeness"))


@query(_NORMAL + ", d AS (SELECT * FROM s WHERE status <> 'EXCLUDED'), c AS (SELECT count(*) AS n, " + ", ".join(f"count({c}) AS {c}" for c in ACCOUNTS.names) + " FROM d) " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::BIGINT AS filled, round_even(100.0 * {c} / n, 1)::DOUBLE AS share FROM c" for c in ACCOUNTS.names))
def g3_field_completeness(spark, sf_dir):
    return reports.field_completeness(rated_accounts(spark, sf_dir), ACCOUNTS)


@query(f"WITH a AS ({ACCOUNTS_SQL}) SELECT source, count(*)::BIGINT AS n FROM a GROUP BY source")
def g6_source_counts(spark, sf_dir):
    return reports.source_counts(account_records(spark, sf_dir))


@query(_NORMAL + "SELECT 'email' AS field, count_if(email IS NOT NULL AND NOT bad_email)::BIGINT AS unverified, count_if(bad_email OR odd_email)::BIGINT AS invalid, count_if(raw_email IS NULL)::BIGINT AS missing FROM s WHERE status <> 'EXCLUDED'")
def g5_verification_counts(spark, sf_dir):
    return reports.verification_counts(rated_accounts(spark, sf_dir), ACCOUNTS).where("field = 'email'").select("field", "unverified", "invalid", "missing")


@query()
def g4_flag_counts(spark, sf_dir):
    return reports.flag_counts(rated_accounts(spark, sf_dir))


@query()
def g8_problem_counts(spark, sf_dir):
    return reports.problem_counts(rated_accounts(spark, sf_dir))


@query(_NORMAL + "SELECT record_id FROM s WHERE status <> 'EXCLUDED' AND contains(lower(company_name || ' ' || coalesce(email, '')), '7') AND status = 'NEEDS_REVIEW'")
def p6_p7_search(spark, sf_dir):
    return rules.search(rules.delivered(rated_accounts(spark, sf_dir)), "7", [value("company_name"), value("email")], ["NEEDS_REVIEW"]).select("record_id")


@query(_NORMAL + "SELECT record_id, website IS NOT NULL AND company_name IS NOT NULL AS website, website IS NULL AND company_name IS NOT NULL AS search, vat_number IS NOT NULL AS vat FROM s")
def p16_enrichment_targets(spark, sf_dir):
    return rules.normalize_table(account_records(spark, sf_dir), ACCOUNTS).select("record_id", *[rules.enrichment_target(k, ACCOUNTS).alias(k) for k in ("website", "search", "vat")])


@query(_NORMAL + """, o AS (SELECT record_id, status, row_number() OVER (ORDER BY CASE status WHEN 'VERIFIED' THEN 0 WHEN 'UNVERIFIED' THEN 2 WHEN 'NEEDS_REVIEW' THEN 3 ELSE 4 END,
  lower(coalesce(company_name, '')) COLLATE C, record_id) AS place FROM s) SELECT record_id, status, place::BIGINT AS place FROM o""")
def t1_delivery_order(spark, sf_dir):
    own = rated_accounts(spark, sf_dir)
    keyed = own.withColumns({"__name": F.coalesce(value("company_name"), F.lit(""))})
    place = [c.alias(f"__k{i}") for i, c in enumerate(reports.delivery_order())]
    return matching.numbered(keyed.select("record_id", "status", *place), ["__k0", "__k1", "record_id"]).select("record_id", "status", F.col("number").cast("long").alias("place"))


@query(f"WITH a AS ({ACCOUNTS_SQL}) SELECT account_id, 'CUS-' || lpad(CAST(row_number() OVER (ORDER BY lower(coalesce(nullif(trim(company_name), ''), '~')) COLLATE C, ord) AS VARCHAR), greatest(4, length(CAST(row_number() OVER (ORDER BY lower(coalesce(nullif(trim(company_name), ''), '~')) COLLATE C, ord) AS VARCHAR))::INT), '0') AS record_id FROM (SELECT * REPLACE (trim(company_name) AS company_name) FROM a)")
def w1_record_ids(spark, sf_dir):
    own = account_rows(spark, sf_dir).withColumn("company_name", F.btrim("company_name"))
    return jobs.record_ids(to_records(own, ACCOUNTS), ACCOUNTS, "Customers").select(value("account_id").alias("account_id"), "record_id")


# --- scalars over whole tables


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages)
SELECT page_id, scheme || '://' || lower(host) || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END
  || CASE WHEN len(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) > 0
     THEN '?' || array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')), '&') ELSE '' END AS url,
  regexp_replace(lower(host), '^www[.]', '') AS domain, true AS public, regexp_matches(regexp_replace(lower(host), '^www[.]', ''), 'x[.]com|menu[.]|google[.]|indeed[.]') AS directory FROM p""")
def s12_s13_p11_p12_urls(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", web.normalize_url(url).alias("url"), web.url_domain(url).alias("domain"), web.is_public_url(url).alias("public"), web.is_directory(url).alias("directory"))


@query(_NORMAL + "SELECT record_id, email, coalesce(email IS NOT NULL AND NOT bad_email, false) AS valid, split_part(email, '@', 2) AS domain FROM s")
def s9_s10_s11_emails(spark, sf_dir):
    rows = account_rows(spark, sf_dir).select("record_id", web.normalize_email("email").alias("email"))
    return rows.select("record_id", "email", web.is_valid_email("email").alias("valid"), web.email_domain("email").alias("domain"))


@query(_NORMAL + "SELECT record_id, vat_number, CASE WHEN vat_number IS NULL THEN false ELSE NOT bad_vat END AS vat_valid, postcode, CASE WHEN postcode IS NULL THEN false ELSE NOT bad_postcode END AS postcode_valid FROM s")
def s20_s21_s22_s23_codes(spark, sf_dir):
    rows = account_rows(spark, sf_dir).select("record_id", codes.normalize_vat("vat_number").alias("vat_number"), codes.normalize_postcode("postcode").alias("postcode"))
    return rows.select("record_id", "vat_number", codes.is_valid_vat("vat_number").alias("vat_valid"), "postcode", codes.is_valid_postcode("postcode").alias("postcode_valid"))


@query(_NORMAL + "SELECT record_id, phone, phone IS NOT NULL AND NOT bad_phone AS valid, CASE WHEN phone IS NOT NULL AND NOT bad_phone THEN '+32 ' || substr(phone, 4, 3) || ' ' || substr(phone, 7, 2) || ' ' || substr(phone, 9, 2) || ' ' || substr(phone, 11, 2) ELSE phone END AS shown FROM s")
def s17_s18_s19_phones(spark, sf_dir):
    rows = account_rows(spark, sf_dir).select("record_id", codes.normalize_phone("phone").alias("phone"))
    return rows.select("record_id", "phone", codes.phone_info("phone")["valid"].alias("valid"), codes.format_phone_display("phone").alias("shown"))


_CENTS = "CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS STRING)"
_WHOLE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)"


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) + 0.25 WHEN 1 THEN floor(o_totalprice) + 0.5 ELSE NULL END::DOUBLE AS number,
  strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE (o_orderkey % 90)::DOUBLE + 0.5 END AS latitude FROM orders""")
def s24_s26_s27_s28_numbers(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"CASE o_orderkey % 3 WHEN 0 THEN 'EUR ' || {_WHOLE} || ',25' WHEN 1 THEN '1'||'e999' ELSE 'none' END AS a", f"CASE WHEN o_orderkey % 3 = 1 THEN {_WHOLE} || '.50' END AS b",
        f"CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} ELSE date_format(o_orderdate, 'yyyy-MM-dd') || 'T00:00:00Z' END AS d", "CASE WHEN o_orderkey % 3 = 2 THEN '95.5' ELSE CAST(o_orderkey % 90 AS STRING) || ',5' END AS l",
    )
    return raw.select("o_orderkey", F.coalesce(numbers.normalize_number("a"), numbers.normalize_number("b")).alias("number"), numbers.normalize_date("d").alias("date"), numbers.normalize_year("d").alias("year"), numbers.normalize_coordinate("l", "latitude").alias("latitude"))


@query(_NORMAL + "SELECT record_id, coalesce(trim(regexp_replace(regexp_replace(lower(strip_accents(company_name)), '\\b(nv)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '') AS key FROM s")
def s1_s2_s3_s4_name_key(spark, sf_dir):
    return account_rows(spark, sf_dir).select("record_id", text.name_key(text.normalize_name("company_name")).alias("key"))


@query(r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, 'example.com', 'firm.be'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+[.][A-Za-z]{2,24}')) AS e FROM documents)
SELECT doc_id, string_agg(DISTINCT e, ',' ORDER BY e) AS emails FROM (SELECT doc_id, trim(lower(e), '.,;:') AS e FROM f) WHERE NOT contains(e, '..') AND NOT starts_with(e, '.') AND NOT regexp_matches(e, 'example[.]|noreply|no-reply|[.](png|jpe?g|gif|svg|webp|css|js|pdf)$') GROUP BY doc_id""")
def e2_emails(spark, sf_dir):
    """Addresses in texts; those of example domains count as junk, so their domain is replaced first."""
    found = pages.emails(F.replace(F.col("text"), F.lit("example.com"), F.lit("firm.be")), F.array().cast("array<string>"))
    rows = spread(read(spark, sf_dir, "documents").where(pages.may_hold_email("text"))).select("doc_id", F.array_join(F.array_sort(found), ",").alias("emails"))
    return stored(rows, "emails").where("emails <> ''")


@query()
def e3_e5_contacts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", pages.phones(F.col("text"), F.array().cast("array<string>")).alias("phones"), pages.vat_numbers(F.col("text")).alias("vat_numbers"))
    return rows.where("size(phones) + size(vat_numbers) > 0")


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS heading FROM pages WHERE regexp_matches(html, '<h1')""")
def a15_html_items(spark, sf_dir):
    own = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return pages.html_items(own, "h1", {"heading": {}}).select(F.col("page_url").cast("long").alias("page_id"), "heading")


@query()
def e1_e4_e7_page_content(spark, sf_dir):
    content = pages.page_content(read(spark, sf_dir, "pages"), "page_id")
    return content.select("page_id", F.length("text").alias("text_length"), "title", F.size("links").alias("n_links"), pages.socials(F.col("hrefs")).alias("socials"))


@query()
def a18_e7_contact_links(spark, sf_dir):
    return pages.contact_links(pages.page_content(read(spark, sf_dir, "pages")))


@query()
def g13_w4_site_contacts(spark, sf_dir):
    own = read(spark, sf_dir, "pages").select("url", "html", web.url_domain("url").alias("site"), F.col("page_id").alias("page_ord"))
    return pages.site_contacts(pages.page_content(own, "site", "page_ord")).select("site", "title", "emails", "phones", "vat_numbers", "text_length")


# --- matching


def account_copies(spark, sf_dir):
    """The list, and copies of every twentieth account with another postcode or spelling."""
    own = account_rows(spark, sf_dir)
    copies = own.where("ord % 20 = 0").withColumns({"ord": F.col("ord") + 1_000_000_000, "record_id": F.concat(F.lit("D"), F.col("record_id")), "company_name": F.upper("company_name"), "postcode": F.when(F.col("ord") % 40 == 0, F.col("postcode"))})
    return stored(rules.normalize_table(to_records(own.unionByName(copies), ACCOUNTS), ACCOUNTS), "copies")


_BLOCKS = _NORMAL + """, u AS (SELECT ord, phone, email, CASE WHEN website IS NULL THEN NULL ELSE 'firm' || ord || '.be' END AS site, vat_number, postcode, company_name FROM s
  UNION ALL SELECT ord + 1000000000, phone, email, CASE WHEN website IS NULL THEN NULL ELSE 'firm' || ord || '.be' END, vat_number, CASE WHEN ord % 40 = 0 THEN postcode END, upper(company_name) FROM s WHERE ord % 20 = 0),
k AS (SELECT ord, 'p' || phone AS key FROM u UNION ALL SELECT ord, 'e' || email FROM u UNION ALL SELECT ord, 'w' || site FROM u UNION ALL SELECT ord, 'v' || vat_number FROM u UNION ALL SELECT ord, 'c' || postcode FROM u
  UNION ALL SELECT ord, 'n' || substr(trim(regexp_replace(regexp_replace(lower(strip_accents(company_name)), '\\b(nv)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), 1, 6) FROM u WHERE company_name IS NOT NULL)
"""


@query(_BLOCKS + "SELECT DISTINCT a.ord::BIGINT AS a_ord, b.ord::BIGINT AS b_ord FROM k a JOIN k b ON a.key = b.key AND a.ord < b.ord")
def d1_s31_block_pairs(spark, sf_dir):
    rows = matching.features(account_copies(spark, sf_dir), ACCOUNTS)
    return matching.block_pairs(rows).select("a_ord", "b_ord")


@query()
def d2_s29_s32_s33_score_pairs(spark, sf_dir):
    rows = stored(matching.features(account_copies(spark, sf_dir), ACCOUNTS), "features")
    return matching.score_pairs(rows, matching.block_pairs(rows, threshold=90)).select("a", "b", "similarity", "reason", "confident")


@query()
def x6_g9_g10_g11_dedupe(spark, sf_dir):
    records, _ = matching.dedupe(account_copies(spark, sf_dir), ACCOUNTS)
    return records.select("record_id", "duplicate_group", "duplicate_of", "completeness", F.array_join("flags", " | ").alias("flags"))


@query()
def x5_audit(spark, sf_dir):
    return jobs.audit(account_records(spark, sf_dir), ACCOUNTS)["status_counts"]


# --- workspace


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = account_rows(spark, sf_dir)
    before = rows.where("ord % 11 <> 3")
    after = rows.where("ord % 17 <> 4").withColumn("city", F.when(F.col("ord") % 13 == 0, F.lit("Elsewhere")).otherwise(F.col("city")))
    return to_records(before, ACCOUNTS), to_records(after, ACCOUNTS)


_SNAP = f"WITH a AS ({ACCOUNTS_SQL}), b AS (SELECT account_id, nullif(trim(city), '') AS city FROM a WHERE ord % 11 <> 3), c AS (SELECT account_id, CASE WHEN ord % 13 = 0 THEN 'Elsewhere' ELSE city END AS city FROM a WHERE ord % 17 <> 4), d AS (SELECT account_id, nullif(trim(city), '') AS city FROM c) "


@query(_SNAP + "SELECT coalesce(b.account_id, d.account_id) AS key, CASE WHEN b.account_id IS NULL THEN 'added' WHEN d.account_id IS NULL THEN 'removed' WHEN b.city IS DISTINCT FROM d.city THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN b.account_id IS NOT NULL AND d.account_id IS NOT NULL AND b.city IS DISTINCT FROM d.city THEN 'city' END AS field, CASE WHEN d.account_id IS NOT NULL AND b.city IS DISTINCT FROM d.city THEN b.city END AS before, CASE WHEN b.account_id IS NOT NULL AND b.city IS DISTINCT FROM d.city THEN d.city END AS after FROM b FULL OUTER JOIN d USING (account_id)")
def d8_compare_runs(spark, sf_dir):
    before, after = snapshots(spark, sf_dir)
    return workspace.compare_runs(before, after, ACCOUNTS).select("key", "change", "field", "before", "after")


@query(_SNAP + "SELECT account_id AS key, 'added' AS side FROM d WHERE account_id NOT IN (SELECT account_id FROM b) UNION ALL SELECT account_id, 'removed' FROM b WHERE account_id NOT IN (SELECT account_id FROM d)")
def u2_key_differences(spark, sf_dir):
    return workspace.key_differences(*snapshots(spark, sf_dir), "account_id")


@query(_SNAP + "SELECT account_id AS key FROM b INTERSECT SELECT account_id FROM d")
def u3_key_intersection(spark, sf_dir):
    return workspace.key_intersection(*snapshots(spark, sf_dir), "account_id")


_EVENTS = "SELECT 'r' || CAST(user_id % 3 AS STRING) AS run_id, CAST(user_id AS STRING) AS record_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS decision, 'u' || CAST(user_id % 5 AS STRING) AS reviewer, '' AS note, CAST(event_id AS INT) AS revision, ts AS created_at FROM events"


def review_events(spark, sf_dir):
    return spark.sql(_EVENTS.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))


@query(f"WITH e AS ({_EVENTS}) SELECT run_id, record_id, arg_max(decision, revision) AS decision, max(revision) AS revision FROM e GROUP BY run_id, record_id")
def w8_current_reviews(spark, sf_dir):
    return workspace.current_reviews(review_events(spark, sf_dir)).select("run_id", "record_id", "decision", "revision")


_PROPOSALS = "SELECT event_id AS proposal_id, 'r1' AS run_id, 'C' || lpad(CAST(user_id AS STRING), 9, '0') AS record_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'odd' ELSE 'pending' END AS decision, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'u' || CAST(user_id % 5 AS STRING) END AS reviewer, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'note' END AS note, CAST(event_id % 2 AS INT) AS expected_revision, ts AS created_at FROM events"


@query(_NORMAL + f""", p AS ({_PROPOSALS}), j AS (SELECT p.*, s.status, s.company_name, bad_email OR odd_email OR bad_phone OR odd_phone OR coalesce(bad_postcode, false) OR bad_vat OR odd_website AS bad,
   s.ord IS NOT NULL AS there, (bad_email OR odd_email OR bad_phone OR odd_phone OR coalesce(bad_postcode, false) OR bad_vat OR odd_website OR company_name IS NULL OR (postcode IS NOT NULL AND city IS NULL) OR apart) AS flagged FROM p LEFT JOIN s USING (record_id)),
 ok AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY proposal_id) AS turn FROM j WHERE decision <> 'odd' AND trim(reviewer) <> '' AND there AND NOT (decision = 'approved' AND (bad OR company_name IS NULL OR (flagged AND note = '')))
   AND NOT (decision = 'rejected' AND note = '') AND expected_revision = 0)
 SELECT record_id, decision, trim(reviewer) AS reviewer, note, 1 AS revision FROM ok WHERE turn = 1""")
def r1_p8_apply_decisions(spark, sf_dir):
    records = rated_accounts(spark, sf_dir).withColumn("run_id", F.lit("r1"))
    proposals = spark.sql(_PROPOSALS.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))
    none = spark.createDataFrame([], workspace.EVENTS)
    accepted, _ = workspace.apply_decisions(proposals, records, none, ACCOUNTS)
    return accepted.select("record_id", "decision", "reviewer", "note", "revision")


@query("WITH c AS (SELECT user_id AS company, 'u' || CAST(user_id AS VARCHAR) AS label, event_type, event_type || CAST(event_id % 7 AS VARCHAR) AS value FROM events) SELECT company, label, min(CASE WHEN event_type = 'purchase' THEN value END) AS website, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN event_type = 'error' THEN value END) FILTER (event_type = 'error'))), '; '), '') AS industries FROM c GROUP BY company, label")
def a12_company_rollup(spark, sf_dir):
    claims = read(spark, sf_dir, "events").selectExpr("user_id AS company", "'u' || CAST(user_id AS STRING) AS label", "CASE event_type WHEN 'purchase' THEN 'website' WHEN 'error' THEN 'industry' ELSE event_type END AS property", "event_type || CAST(event_id % 7 AS STRING) AS value")
    return landed.company_rollup(claims).select("company", "label", "website", "industries")


@query(f"WITH a AS ({ACCOUNTS_SQL}) SELECT record_id, '''=' || coalesce(city, '') AS cell FROM a")
def s6_csv_cells(spark, sf_dir):
    return account_rows(spark, sf_dir).select("record_id", text.csv_cell(F.concat(F.lit("="), F.coalesce("city", F.lit("")))).alias("cell"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice0_status_counts(spark, sf_dir)


def queries() -> dict:
    from quarrymill.plans import landed_queries, record_queries  # noqa: F401  they add their own
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from quarrymill.plans import landed_queries, record_queries  # noqa: F401
    return dict(SQL)
