"""Queries over the rated account list: reports, deliveries, duplicates, runs and reviews; see registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import matching, reports, rules, workspace
from quarrymill.operators.records import strings, to_records, value
from quarrymill.plans import jobs
from quarrymill.plans.registry import _NORMAL, SQL, account_copies, account_records, account_rows, query, rated_accounts, read
from quarrymill.schema import ACCOUNTS, COMPANIES
from quarrymill.storage import fresh_path, spread, stored

# --- reports

_STATUSES = "['VERIFIED','PARTIALLY_VERIFIED','UNVERIFIED','NEEDS_REVIEW']"
_INVALID = {"company_name": "false", "email": "bad_email OR odd_email", "website": "odd_website", "phone": "bad_phone OR odd_phone", "vat_number": "bad_vat"}


def _checks(where: str) -> str:
    """SQL rows (field, verified, unverified, conflict, invalid, missing) of the counted fields."""
    one = "SELECT '{c}' AS field, 0::BIGINT AS verified, count_if(coalesce(NOT ({bad}) AND {c} IS NOT NULL, false))::BIGINT AS unverified, 0::BIGINT AS conflict, count_if(coalesce({bad}, false))::BIGINT AS invalid, count_if({c} IS NULL AND NOT coalesce({bad}, false))::BIGINT AS missing FROM " + where
    return " UNION ALL ".join(one.format(c=c, bad=bad) for c, bad in _INVALID.items())


@query(_NORMAL + f", d AS (SELECT * FROM s WHERE status <> 'EXCLUDED') {_checks('d')}")
def g5_all_verification_counts(spark, sf_dir):
    return reports.verification_counts(rated_accounts(spark, sf_dir), ACCOUNTS)


@query(_NORMAL + f""", d AS (SELECT * FROM s WHERE status <> 'EXCLUDED'), k AS ({_checks('d')}),
c AS (SELECT 'status' AS section, x.status AS key, count(d.ord) AS n FROM (SELECT unnest({_STATUSES}) AS status) x LEFT JOIN d USING (status) GROUP BY 2
  UNION ALL {" UNION ALL ".join(f"SELECT 'field', '{c}', count({c}) FROM d" for c in ACCOUNTS.names)}
  UNION ALL SELECT 'check', field || ': verified', verified FROM k UNION ALL SELECT 'check', field || ': unverified', unverified FROM k UNION ALL SELECT 'check', field || ': conflict / invalid', conflict + invalid FROM k
  UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY source)
SELECT section, key, n::BIGINT AS n, n::DOUBLE / (SELECT count(*) FROM d) AS share FROM c
UNION ALL SELECT 'total', 'total', (SELECT count(*) FROM s), NULL UNION ALL SELECT 'total', 'delivered', (SELECT count(*) FROM d), NULL UNION ALL SELECT 'total', 'merged', 0, NULL UNION ALL SELECT 'total', 'groups', 0, NULL""")
def a25_g2_summary_table(spark, sf_dir):
    none = spark.createDataFrame([], "group_id string")
    return reports.summary_table(rated_accounts(spark, sf_dir), none, ACCOUNTS)


_FLAGS = """, f AS (SELECT ord, unnest([CASE WHEN odd_website THEN 'website value could not be interpreted' END, CASE WHEN odd_email THEN 'email value could not be interpreted' END, CASE WHEN odd_phone THEN 'phone value could not be interpreted' END,
  CASE WHEN company_name IS NULL THEN 'missing required field' END, CASE WHEN bad_email THEN 'email invalid e-mail address' END, CASE WHEN bad_phone THEN 'phone invalid phone number' END, CASE WHEN bad_vat THEN 'vat number invalid VAT number' END, CASE WHEN bad_postcode THEN 'postcode invalid postcode for BE' END,
  CASE WHEN apart THEN 'e-mail domain  differs from website domain  - review' END, CASE WHEN postcode IS NOT NULL AND city IS NULL THEN 'note' END, CASE WHEN status = 'EXCLUDED' THEN 'missing company name - record unusable' END]) AS flag FROM s)"""


@query(_NORMAL + _FLAGS + "SELECT flag, count(*)::BIGINT AS n FROM f WHERE flag IS NOT NULL GROUP BY flag")
def g4_s7_flag_counts(spark, sf_dir):
    return reports.flag_counts(rated_accounts(spark, sf_dir))


@query(_NORMAL + _FLAGS + "SELECT count(*)::BIGINT AS problems, count(DISTINCT ord)::BIGINT AS rows_with_problems FROM f WHERE flag IS NOT NULL AND flag <> 'note'")
def g8_problem_totals(spark, sf_dir):
    return reports.problem_counts(rated_accounts(spark, sf_dir))


@query(_NORMAL + """SELECT record_id, 0 AS verified, round_even(100.0 * (2 + CASE WHEN company_name IS NULL THEN 0 ELSE 2 END + (website IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (vat_number IS NOT NULL)::INT + (street IS NOT NULL)::INT + 1 + (postcode IS NOT NULL)::INT + (city IS NOT NULL)::INT + 1 + 1) / 14, 1)::DOUBLE AS completeness,
  (4 + (company_name IS NOT NULL)::INT + (website IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (vat_number IS NOT NULL)::INT + (street IS NOT NULL)::INT + (postcode IS NOT NULL)::INT + (city IS NOT NULL)::INT) AS filled FROM s""")
def g12_quality(spark, sf_dir):
    out = rules.normalize_table(account_records(spark, sf_dir), ACCOUNTS)
    return out.select("record_id", rules.quality(ACCOUNTS).alias("q")).select("record_id", "q.*")


@query(_NORMAL + "SELECT 0 AS place, 'load' AS stage, count(*)::BIGINT AS rows FROM s UNION ALL SELECT 1, 'delivered', count(*) FROM s WHERE status <> 'EXCLUDED' UNION ALL SELECT 2, 'review', count(*) FROM s WHERE status IN ('NEEDS_REVIEW', 'EXCLUDED')")
def g15_p6_stage_counts(spark, sf_dir):
    out = rated_accounts(spark, sf_dir)
    return reports.stage_counts({"load": out, "delivered": rules.delivered(out), "review": rules.needs_review(out)})


# --- deliveries

_SHOWN = "CASE WHEN phone IS NOT NULL AND NOT bad_phone THEN '+32 ' || substr(phone, 4, 3) || ' ' || substr(phone, 7, 2) || ' ' || substr(phone, 9, 2) || ' ' || substr(phone, 11, 2) ELSE phone END"
_MAIL_CHECK = "CASE WHEN odd_email THEN 'invalid - could not interpret email value ''broken'' | other values seen: broken' WHEN bad_email THEN 'invalid - invalid e-mail address' WHEN email IS NULL THEN 'missing' ELSE 'unverified' END"


def _rated(spark, sf_dir):
    return rated_accounts(spark, sf_dir).withColumns({"completeness": rules.completeness(ACCOUNTS), "duplicate_group": F.lit("")})


@query(_NORMAL + f"SELECT record_id, {_SHOWN} AS phone, status, {_MAIL_CHECK} AS mail_check, source FROM s")
def a22_s19_s37_display(spark, sf_dir):
    out = reports.display_table(_rated(spark, sf_dir), ACCOUNTS)
    return out.select(F.col("Record ID").alias("record_id"), F.col("Phone").alias("phone"), F.col("Verification status").alias("status"), F.col("Email check").alias("mail_check"), F.col("Source").alias("source"))


@query(_NORMAL + f"SELECT record_id, CASE WHEN phone IS NULL THEN NULL ELSE '''' || {_SHOWN} END AS phone, status, {_MAIL_CHECK} AS mail_check FROM s WHERE status <> 'EXCLUDED'")
def a20_s6_delivery_csv(spark, sf_dir):
    """The delivery is written and read back; the first name holds the byte order mark, numbers with a plus an apostrophe."""
    path = fresh_path(spark, "delivery")
    reports.write_delivery_csv(_rated(spark, sf_dir), ACCOUNTS, path)
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return back.select(F.col(f"`{back.columns[0]}`").alias("record_id"), F.col("Phone").alias("phone"), F.col("Verification status").alias("status"), F.col("Email check").alias("mail_check"))


@query(_NORMAL + "SELECT record_id, status, company_name, coalesce(email, '') AS email, CASE WHEN odd_email OR bad_email THEN 'invalid' WHEN email IS NULL THEN 'missing' ELSE 'unverified' END AS email_state, odd_email AS other_seen FROM s")
def a21_evidence_json(spark, sf_dir):
    """The evidence is written as JSON and read back: values, states and other values seen of every record."""
    path = fresh_path(spark, "evidence")
    out = rated_accounts(spark, sf_dir)
    none = spark.createDataFrame([], "group_id string, master_id string, member_ids array<string>, reason string, similarity double, merged boolean")
    reports.write_evidence(out, none, ACCOUNTS, {"records": 1}, path)
    cell = "struct<value:string,source:string,status:string,note:string,candidates:array<string>>"
    back = spark.read.schema(f"record_id string, status string, fields struct<company_name:{cell},email:{cell}>").json(f"{path}/records")
    return back.select("record_id", "status", F.col("fields.company_name.value").alias("company_name"), F.coalesce("fields.email.value", F.lit("")).alias("email"), F.coalesce("fields.email.status", F.lit("missing")).alias("email_state"), F.coalesce(F.array_contains("fields.email.candidates", "broken"), F.lit(False)).alias("other_seen"))


@query(_NORMAL + "SELECT record_id, status, company_name, website, email, phone, vat_number, coalesce('email: ' || CASE WHEN bad_email THEN 'invalid - invalid e-mail address' ELSE 'unverified' END, '') AS mail_line FROM s WHERE status IN ('NEEDS_REVIEW', 'EXCLUDED')".replace("coalesce('email: ' || CASE WHEN bad_email THEN 'invalid - invalid e-mail address' ELSE 'unverified' END, '')", "CASE WHEN email IS NULL THEN '' WHEN bad_email THEN 'email: invalid - invalid e-mail address' ELSE 'email: unverified' END"))
def a23_review_queue(spark, sf_dir):
    out = reports.review_queue(rated_accounts(spark, sf_dir), ACCOUNTS)
    line = F.coalesce(F.try_element_at(F.filter(F.split("checks", "\n"), lambda x: x.startswith("email: ")), F.lit(1)), F.lit(""))
    return out.select("record_id", "status", "company_name", "website", "email", "phone", "vat_number", line.alias("mail_line"))


# --- duplicates


def _matches(records: str) -> str:
    """SQL rows ``mt`` (a, b, a_ord, b_ord, reason, confident) of the matches of ``records``, by the rules of matching.compare(): who shares an identifier, a
    postcode or six letters of the name; conflict first, then identifiers with names of 60 % and more, then a site, then names of 90 % and more. The
    similarity is the token set ratio: the best of the common words and of either side's, by longest common subsequences (names up to 60 letters)."""
    key = "coalesce(trim(regexp_replace(regexp_replace(lower(strip_accents(company_name)), '\\b(nv)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
    ratio = "100.0::DOUBLE * (1.0::DOUBLE - ({0})::DOUBLE / nullif({1}, 0))"
    within = "(length({0}) - length(translate({0}, {1}, '')))"
    return f"""
, fe AS (SELECT ord, record_id, phone, email, CASE WHEN website IS NOT NULL THEN 'firm' || ord % 1000000000 || '.be' END AS site, vat_number, postcode, lower(street) AS street, house_number, {key} AS name,
    trim(concat_ws('|', coalesce(postcode, ''), coalesce(lower(street), ''), house_number), '|') AS address, list_sort(list_distinct(list_filter(string_split({key}, ' '), lambda w: w <> ''))) AS words FROM {records}),
bk AS (SELECT ord, 'p' || phone AS key FROM fe UNION ALL SELECT ord, 'e' || email FROM fe UNION ALL SELECT ord, 'w' || site FROM fe UNION ALL SELECT ord, 'v' || vat_number FROM fe UNION ALL SELECT ord, 'c' || postcode FROM fe
  UNION ALL SELECT ord, 'n' || substr(name, 1, 6) FROM fe WHERE name <> ''),
bp AS (SELECT DISTINCT a.ord AS a_ord, b.ord AS b_ord FROM bk a JOIN bk b ON a.key = b.key AND a.ord < b.ord),
b0 AS (SELECT a_ord, b_ord, a.record_id AS a, b.record_id AS b, a.name <> '' AND b.name <> '' AS named, concat_ws(', ', CASE WHEN a.phone = b.phone THEN 'phone' END, CASE WHEN a.email = b.email THEN 'email' END, CASE WHEN a.vat_number = b.vat_number THEN 'vat_number' END) AS hard,
    coalesce(a.site = b.site, false) AS site, coalesce(a.postcode <> b.postcode, false) OR coalesce(a.street <> b.street, false) OR coalesce(a.house_number <> b.house_number, false) OR coalesce(a.vat_number <> b.vat_number, false) AS conflict,
    a.address = b.address AND contains(a.address, '|') AS address, coalesce(a.postcode = b.postcode, false) AS near, a.postcode IS NULL AND b.postcode IS NULL AS nowhere, array_to_string(list_filter(a.words, lambda w: list_contains(b.words, w)), ' ') AS common,
    array_to_string(list_filter(a.words, lambda w: NOT list_contains(b.words, w)), ' ') AS l, array_to_string(list_filter(b.words, lambda w: NOT list_contains(a.words, w)), ' ') AS r FROM bp JOIN fe a ON a.ord = a_ord JOIN fe b ON b.ord = b_ord),
b1 AS (SELECT *, length(common) AS i, CASE WHEN common = '' THEN 0 ELSE 1 END AS gap FROM b0),
b2 AS (SELECT *, 2 * (i + gap) + length(l) + length(r) AS total, CASE WHEN NOT named THEN 0.0 WHEN i > 0 AND (l = '' OR r = '') THEN 100.0 WHEN i > 0 THEN greatest({ratio.format("gap + length(l)", "2 * i + gap + length(l)")}, {ratio.format("gap + length(r)", "2 * i + gap + length(r)")}) ELSE 0.0 END::DOUBLE AS known FROM b1),
b3 AS (SELECT *, named AND known < 100 AND {ratio.format(f"length(l) + length(r) - 2 * least({within.format('l', 'r')}, {within.format('r', 'l')})", "total")} >= CASE WHEN hard <> '' OR site THEN 0 ELSE 90 END AS open FROM b2),
b4 AS (SELECT *, CASE WHEN open THEN length(l) - bit_count(list_reduce(list_transform(string_split(r, ''), lambda c: coalesce(list_sum(list_transform(range(length(l)), lambda k: CASE WHEN l[k + 1] = c THEN (1::BIGINT << k::INT) ELSE 0 END)), 0)::BIGINT),
    lambda v, h: ((v + (v & h)) | (v - (v & h))) & ((1::BIGINT << length(l)::INT) - 1), (1::BIGINT << length(l)::INT) - 1)) END AS lcs FROM b3),
b5 AS (SELECT *, CASE WHEN open THEN greatest(known, {ratio.format("length(l) + length(r) - 2 * lcs", "total")}) ELSE known END AS sim FROM b4),
b6 AS (SELECT *, round_even(sim, 0)::INT || '% similar' AS percent, sim >= 90 AS alike, CASE WHEN address THEN 'same address' WHEN near THEN 'same postcode' ELSE 'no address on either record' END AS place FROM b5),
b7 AS (SELECT *, CASE WHEN conflict AND (hard <> '' OR site OR alike) THEN 1 WHEN hard <> '' AND sim >= 60 THEN 2 WHEN site AND alike AND address THEN 3 WHEN alike AND (address OR near OR nowhere) THEN 4 WHEN site THEN 5 WHEN hard <> '' THEN 6 END AS rule FROM b6),
mt AS (SELECT a, b, a_ord, b_ord, CASE rule WHEN 1 THEN 'conflicting location or legal identifier (branch or chain?) - review' WHEN 2 THEN 'same ' || hard || '; names ' || percent WHEN 3 THEN 'same website domain and address; names ' || percent
    WHEN 4 THEN 'names ' || percent || '; ' || place WHEN 5 THEN 'same website domain but different name/address (branch or chain?) - names ' || percent ELSE 'same ' || hard || ' but different names - review' END AS reason, rule IN (2, 3) OR rule = 4 AND address AS confident FROM b7 WHERE rule IS NOT NULL)
"""


_COPIES = _NORMAL + """, u AS (SELECT ord, record_id, company_name, phone, email, website, vat_number, street, house_number, postcode FROM s
  UNION ALL SELECT ord + 1000000000, 'D' || record_id, upper(company_name), phone, email, website, vat_number, street, house_number, CASE WHEN ord % 40 = 0 THEN postcode END FROM s WHERE ord % 20 = 0)
""" + _matches("u")


@query(_COPIES + "SELECT a, b, reason, confident FROM mt")
def d2_s29_s32_s33_matches(spark, sf_dir):
    """Copies with an account's identifiers, and accounts that share a mailbox but neither house nor postcode; in a larger list also accounts
    of a postcode whose names are alike."""
    rows = stored(matching.features(account_copies(spark, sf_dir), ACCOUNTS), "features")
    return matching.score_pairs(rows, matching.block_pairs(rows, threshold=90)).select("a", "b", "reason", "confident")


@query(_COPIES + """SELECT record_id, CASE WHEN record_id IN (SELECT a FROM mt UNION ALL SELECT b FROM mt) THEN 1 ELSE 0 END AS grouped, coalesce(m.a, '') AS duplicate_of FROM u LEFT JOIN mt m ON m.confident AND m.b = u.record_id""")
def x6_d10_w3_w7_merged(spark, sf_dir):
    """Copies with the account's name are merged into it, as it is seen first and no less complete; others are only possible duplicates."""
    records, _ = matching.dedupe(account_copies(spark, sf_dir), ACCOUNTS)
    return records.select("record_id", (F.col("duplicate_group") != "").cast("int").alias("grouped"), "duplicate_of")


@query(_COPIES + "SELECT CASE WHEN confident THEN 'merged automatically' ELSE 'POSSIBLE duplicate - decide' END AS action, a AS kept_id, b AS other_ids, reason FROM mt")
def a24_g9_g10_duplicates_table(spark, sf_dir):
    records = account_copies(spark, sf_dir)
    _, groups = matching.dedupe(records, ACCOUNTS)
    return matching.duplicates_table(groups, records, ACCOUNTS).select("action", "kept_id", "other_ids", "reason")


_AUDITED = _matches("s") + """, x AS (SELECT record_id, CASE WHEN status = 'EXCLUDED' OR record_id IN (SELECT a FROM mt UNION ALL SELECT b FROM mt) THEN 'NEEDS_REVIEW' ELSE status END AS status FROM s)
"""


@query(_NORMAL + _AUDITED + "SELECT record_id, status FROM x")
def x5_p10_audit_records(spark, sf_dir):
    """In an audit nothing is excluded; who shares a mailbox, or a postcode and much of the name, is a possible duplicate and goes to review."""
    return jobs.audit(account_records(spark, sf_dir), ACCOUNTS)["records"].select("record_id", "status")


@query(_NORMAL + _matches("s") + "SELECT account_id, CASE WHEN status <> 'EXCLUDED' AND record_id IN (SELECT a FROM mt UNION ALL SELECT b FROM mt) THEN 'NEEDS_REVIEW' ELSE status END AS status FROM s")
def x4_w1_run_pipeline(spark, sf_dir):
    """An offline project run over the list: ids, phones, rules, duplicates and status."""
    return jobs.run_pipeline(account_records(spark, sf_dir), ACCOUNTS, "Customers")["records"].select(value("account_id").alias("account_id"), "status")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 3 < 2 THEN 'verified' ELSE 'missing' END AS website_state, CASE WHEN c_custkey % 3 = 1 THEN 'https://' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || 'firm.be/' WHEN c_custkey % 3 = 0 THEN 'https://firm' || c_custkey || '.be/' END AS website,
  CASE WHEN c_custkey % 5 = 0 THEN 'invalid' WHEN c_custkey % 3 < 2 THEN 'verified' ELSE 'unverified' END AS email_state, CASE WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'unverified' END AS vat_state,
  CASE WHEN c_custkey % 2 = 0 THEN 'Legal ' || c_custkey END AS legal_name, CASE WHEN c_custkey % 3 = 0 THEN '5' END AS employees FROM customer""")
def x4_all_stages(spark, sf_dir):
    """A project run with all five side tables: sites of every third record, hits for every third without a website, profiles, a register that
    knows every second number, and mail domains of which every fifth is dead."""
    return _whole_run(spark, sf_dir)["records"].select(
        F.regexp_extract("f_company_name.value", "^0*([0-9]+)", 1).alias("k"), F.coalesce("f_website.status", F.lit("missing")).alias("website_state"), value("website").alias("website"), F.col("f_email.status").alias("email_state"),
        F.col("f_vat_number.status").alias("vat_state"), value("legal_name").alias("legal_name"), value("employees").alias("employees"),
    )


def _whole_run(spark, sf_dir):
    own = spread(read(spark, sf_dir, "customer"))
    vat = "'BE' || lpad(CAST(4000000 + c_custkey AS STRING), 8, '0') || lpad(CAST(97 - (4000000 + c_custkey) % 97 AS STRING), 2, '0')"
    name, site = "lpad(CAST(c_custkey AS STRING), 6, '0') || ' firm'", "'firm' || CAST(c_custkey AS STRING) || '.be'"
    raw = own.selectExpr("c_custkey AS ord", "'list' AS source", "CAST(c_custkey AS STRING) AS source_id", f"{name} AS company_name", f"CASE WHEN c_custkey % 3 = 0 THEN 'https://' || {site} || '/' END AS website", f"'info@' || {site} AS email", f"{vat} AS vat_number")

    def sites(records):
        there = records.where(value("website").isNotNull())
        return there.select(
            "record_id", F.lit("live").alias("outcome"), F.lit(200).alias("http_status"), value("website").alias("final_url"), F.lit("").alias("error"), F.lit(100.0).alias("name_score"), F.array(value("email")).alias("emails"), strings().alias("phones"), strings().alias("vat_numbers"),
            F.expr("cast(map() as map<string,string>)").alias("socials"), F.lit("").alias("description"),
        )

    # keys count from 0, and ids, by name, from 1
    hits = own.where("c_custkey % 3 = 1").selectExpr("'LEA-' || lpad(CAST(c_custkey + 1 AS STRING), greatest(4, length(CAST(c_custkey + 1 AS STRING))), '0') AS record_id", "0 AS place", "'https://' || lpad(CAST(c_custkey AS STRING), 6, '0') || 'firm.be/' AS url", f"{name} AS title", "'' AS snippet")
    profiles = own.where("c_custkey % 3 = 0").selectExpr(f"'https://' || {site} AS website", "5 AS employees", *[f"CAST(NULL AS STRING) AS {n}" for n in ("linkedin", "industry", "founded", "description", "phone", "facebook")])
    register = own.where("c_custkey % 2 = 0").selectExpr(f"{vat} AS vat", "true AS valid", "'Legal ' || CAST(c_custkey AS STRING) AS name", "'' AS address", "'' AS error")
    domains = own.selectExpr(f"{site} AS domain", "c_custkey % 5 <> 0 AS deliverable")
    return jobs.run_pipeline(to_records(raw, COMPANIES), COMPANIES, "Leads", sites=sites, hits=hits, profiles=profiles, register=register, mail_domains=domains)


@query("SELECT u.place::INT AS place, u.stage, (SELECT count(*) FROM customer)::BIGINT AS rows_in, (SELECT count(*) FROM customer)::BIGINT AS rows, '' AS note FROM (SELECT unnest(range(0, 11)) AS place, unnest(['extract & normalise', 'number', 'sites', 'search', 'sites of hits', 'profiles', 'vat', 'mail domains', 'verify', 'validate', 'status']) AS stage) u")
def g15_run_log(spark, sf_dir):
    """The log of a run with all stages: none of them loses or doubles a record, and each is counted as it is stored."""
    return _whole_run(spark, sf_dir)["stages"].select("place", "stage", "rows_in", "rows", "note")


# --- runs and reviews


def _workspace(spark, sf_dir):
    """A workspace with two runs of the list, and a decision on each record of the first with an even key; every third is changed later."""
    folder = fresh_path(spark, "workspace")
    records = rated_accounts(spark, sf_dir).withColumn("duplicate_of", F.lit(""))
    for run in ("r1", "r2"):
        workspace.save_run(records, folder, run, "Accounts", ACCOUNTS, report={"run": run})
    first = records.where("ord % 2 = 0").selectExpr("'r1' AS run_id", "record_id", "'approved' AS decision", "'me' AS reviewer", "'seen' AS note", "1 AS revision", "timestamp'2024-01-01' AS created_at")
    second = records.where("ord % 6 = 0").selectExpr("'r1' AS run_id", "record_id", "'rejected' AS decision", "'you' AS reviewer", "'no' AS note", "2 AS revision", "timestamp'2024-01-02' AS created_at")
    workspace.save_events(first.union(second), folder)
    return folder, spark.read.parquet(f"{folder}/events")


_BLOCKED = "company_name IS NULL OR bad_email OR odd_email OR bad_phone OR odd_phone OR coalesce(bad_postcode, false) OR bad_vat OR odd_website"


@query(_NORMAL + f"SELECT record_id, company_name, 'me' AS reviewer, 'seen' AS review_note FROM s WHERE ord % 2 = 0 AND ord % 6 <> 0 AND NOT ({_BLOCKED})")
def a28_a30_d9_w8_approved(spark, sf_dir):
    folder, events = _workspace(spark, sf_dir)
    rows = workspace.approved(workspace.load_run(spark, folder, "r1"), workspace.current_reviews(events).where("run_id = 'r1'"), ACCOUNTS)
    path = fresh_path(spark, "approved")
    workspace.write_approved_csv(rows, path)
    return spark.read.options(header=True, escape='"').csv(path).select("record_id", "company_name", "reviewer", "review_note")


@query(_NORMAL + f"SELECT count(*)::BIGINT AS records, count_if({_BLOCKED})::BIGINT AS blocked, count_if(ord % 2 = 0 AND ord % 6 <> 0)::BIGINT AS approved, count_if(ord % 2 = 1)::BIGINT AS awaiting FROM s")
def g14_review_metrics(spark, sf_dir):
    folder, events = _workspace(spark, sf_dir)
    return reports.review_metrics(workspace.load_run(spark, folder, "r1"), workspace.current_reviews(events), ACCOUNTS)


@query(_NORMAL + "SELECT record_id, 1 AS revision, 'approved' AS decision FROM s WHERE ord % 2 = 0 UNION ALL SELECT record_id, 2, 'rejected' FROM s WHERE ord % 6 = 0")
def t5_event_history(spark, sf_dir):
    return workspace.event_history(_workspace(spark, sf_dir)[1], "r1").select("record_id", "revision", "decision")


@query(_NORMAL + "SELECT 'r2' AS run_id, 'Accounts' AS project, (SELECT count(*) FROM s)::BIGINT AS records, 0::BIGINT AS events")
def r2_t4_delete_run(spark, sf_dir):
    """After the first run was deleted the list of runs, their records and decisions."""
    folder, _ = _workspace(spark, sf_dir)
    workspace.delete_run(spark, folder, "r1")
    runs = workspace.list_runs(spark.read.parquet(f"{folder}/runs"), "Accounts").select("run_id", "project")
    records = spark.read.parquet(f"{folder}/records").groupBy("run_id").agg(F.count("*").alias("records"))
    events = spark.read.schema("run_id string, record_id string").parquet(f"{folder}/events").groupBy("run_id").agg(F.count("*").alias("events"))
    return runs.join(records, "run_id").join(events, "run_id", "left").select("run_id", "project", "records", F.coalesce("events", F.lit(0).cast("long")).alias("events"))


@query(_NORMAL + "SELECT record_id, 'changed meanwhile: reload' AS reason FROM s WHERE ord % 6 = 0 UNION ALL SELECT record_id, 'no such record in this run' FROM s WHERE ord % 10 = 9".replace("record_id, 'no such", "'Z' || record_id, 'no such"))
def r1_stale_decisions(spark, sf_dir):
    """Decisions on records that were decided twice meanwhile, with the first revision in mind, are refused; new ones on others are taken."""
    folder, events = _workspace(spark, sf_dir)
    records = workspace.load_run(spark, folder, "r1")
    proposals = records.where("ord % 2 = 0 or ord % 10 = 9").selectExpr("ord AS proposal_id", "'r1' AS run_id", "CASE WHEN ord % 2 = 1 THEN 'Z' ELSE '' END || record_id AS record_id", "'pending' AS decision", "'me' AS reviewer", "'again' AS note", "1 AS expected_revision", "timestamp'2024-02-01' AS created_at")
    _, refused = workspace.apply_decisions(proposals, records, events, ACCOUNTS)
    return refused.select("record_id", "reason")


@query("""SELECT 'A' || c_custkey AS record_id, 'verified' AS phone_state, 'same value in a and b' AS phone_note, 'b' AS email_source, 'b@firm' || c_custkey || '.be' AS email, 'conflict' AS city_state, 'differs between sources: City A vs City B' AS city_note, 'City B' AS city_other,
  'note: merged 1 duplicate record(s) - same phone; names 100% similar|merged duplicates disagree on: city: City A vs City B - review' AS flags FROM customer""")
def g11_u4_merge_fields(spark, sf_dir):
    """Two sources' records of each customer: an equal value is confirmed, a gap is filled, a difference is a conflict that keeps both."""
    both = account_rows(spark, sf_dir).selectExpr("ord", "explode(array('a', 'b')) AS source").selectExpr(
        "2 * ord + CASE source WHEN 'a' THEN 0 ELSE 1 END AS ord", "upper(source) || CAST(ord AS STRING) AS record_id", "source", "lpad(CAST(ord AS STRING), 6, '0') || ' firm' AS company_name", "'+324' || lpad(CAST(70000000 + ord AS STRING), 8, '0') AS phone",
        "CASE source WHEN 'a' THEN 'https://firm' || CAST(ord AS STRING) || '.be/' END AS website", "CASE source WHEN 'b' THEN 'b@firm' || CAST(ord AS STRING) || '.be' END AS email", "'City ' || upper(source) AS city",
    )
    merged, _ = matching.dedupe(to_records(both, ACCOUNTS), ACCOUNTS)
    out = merged.where("duplicate_of = ''")
    return out.select(
        "record_id", F.col("f_phone.status").alias("phone_state"), F.col("f_phone.note").alias("phone_note"), F.col("f_email.source").alias("email_source"), value("email").alias("email"), F.col("f_city.status").alias("city_state"), F.col("f_city.note").alias("city_note"),
        F.array_join("f_city.candidates", ",").alias("city_other"), F.array_join("flags", "|").alias("flags"),
    )


# --- hot blocks, refusals and large clusters


#: A list in which a sixth of the rows share a mailbox and an eleventh a dummy postcode; names are of seven families without a letter in common.
_FAMILY = "CASE c_custkey % 7 WHEN 0 THEN 'aaaa bbbb' WHEN 1 THEN 'cccc dddd' WHEN 2 THEN 'eeee ffff' WHEN 3 THEN 'gggg hhhh' WHEN 4 THEN 'iiii jjjj' WHEN 5 THEN 'kkkk llll' ELSE 'mmmm nnnn' END"
_HOT = {
    "ord": "c_custkey", "record_id": "'H' || CAST(c_custkey AS STRING)", "source": "'list'", "company_name": _FAMILY, "email": "CASE WHEN c_custkey % 6 = 5 THEN 'me@gmail.com' END",
    "postcode": "CASE WHEN c_custkey % 11 = 5 THEN 'AB1' WHEN c_custkey % 11 <> 6 THEN CAST(1000 + c_custkey % 30 AS STRING) END", "country": "'BE'",
}
_HOT_SQL = "WITH h AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _HOT.items()) + """ FROM customer),
g AS (SELECT company_name, email, postcode, min(ord) AS class_ord, count(*) AS size FROM h GROUP BY ALL),
k AS (SELECT class_ord, 'e' || email AS key FROM g UNION ALL SELECT class_ord, 'p' || postcode FROM g UNION ALL SELECT class_ord, 'n' || company_name FROM g),
pairs AS (SELECT DISTINCT a.class_ord AS a_ord, b.class_ord AS b_ord FROM k a JOIN k b ON a.key = b.key AND a.class_ord < b.class_ord)
"""


def hot_features(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "customer")).selectExpr(*[f"{e} AS {n}" for n, e in _HOT.items()])
    return stored(matching.features(to_records(rows, ACCOUNTS), ACCOUNTS), "features")


@query(_HOT_SQL + "SELECT a_ord::BIGINT AS a_ord, b_ord::BIGINT AS b_ord FROM pairs")
def d1_hot_class_pairs(spark, sf_dir):
    """Pairs of classes of like records, in blocks of which one holds a sixth of the list."""
    return matching.class_pairs(hot_features(spark, sf_dir))[0].select("a_ord", "b_ord")


@query(_HOT_SQL + "SELECT ord::BIGINT AS ord, class_ord::BIGINT AS class_ord, size::BIGINT AS size FROM h JOIN g ON h.company_name = g.company_name AND h.email IS NOT DISTINCT FROM g.email AND h.postcode IS NOT DISTINCT FROM g.postcode")
def d1_hot_class_members(spark, sf_dir):
    return matching.record_classes(hot_features(spark, sf_dir))


@query(_HOT_SQL + """, met AS (SELECT a_ord, b_ord FROM pairs UNION ALL SELECT class_ord, class_ord FROM g WHERE size > 1),
m AS (SELECT a_ord, b_ord, a.company_name = b.company_name AS alike, coalesce(a.email = b.email, false) AS mail, coalesce(a.postcode <> b.postcode, false) AS apart, coalesce(a.postcode = b.postcode, false) AS near, a.postcode IS NULL AND b.postcode IS NULL AS nowhere,
  CASE WHEN a_ord = b_ord THEN a.size * (a.size - 1) // 2 ELSE a.size * b.size END AS record_pairs FROM met JOIN g a ON a.class_ord = a_ord JOIN g b ON b.class_ord = b_ord)
SELECT a_ord::BIGINT AS a_ord, b_ord::BIGINT AS b_ord, CASE WHEN apart THEN 'conflicting location or legal identifier (branch or chain?) - review' WHEN mail AND alike THEN 'same email; names 100% similar'
  WHEN alike AND near THEN 'names 100% similar; same postcode' WHEN alike THEN 'names 100% similar; no address on either record' ELSE 'same email but different names - review' END AS reason,
  mail AND alike AND NOT apart AS confident, record_pairs::BIGINT AS record_pairs FROM m WHERE mail OR alike AND (apart OR near OR nowhere)""")
def d2_hot_class_matches(spark, sf_dir):
    """Each pair of classes is compared once; a match stands for all pairs of their members."""
    rows = hot_features(spark, sf_dir)
    pairs, membership = matching.class_pairs(rows)
    return matching.class_matches(rows, pairs, membership).select("a_ord", "b_ord", "reason", "confident", "record_pairs")


@query("""WITH k AS (SELECT c_custkey AS k FROM customer) SELECT 'X' || k || 'a' AS a, 'X' || k || 'b' AS b, true AS accepted, 'same phone; names 100% similar' AS reason FROM k
UNION ALL SELECT 'X' || k || 'b', 'X' || k || 'c', false, 'transitive duplicate group contains conflicting locations or legal identifiers - review' FROM k
UNION ALL SELECT 'X' || k || 'a', 'X' || k || 'c', false, 'conflicting location or legal identifier (branch or chain?) - review' FROM k""")
def g9_refused_bridges(spark, sf_dir):
    """Three records of each customer with one telephone: one in a town, one without a place, one in another town. The second joins the first and can't
    bring the third in. Decided in rounds, as the limit for tasks is set to 100 matches. Only records that share the telephone are compared: a town holds
    a third of all records, and its postcode alone would pair each with each."""
    raw = spread(read(spark, sf_dir, "customer")).selectExpr("c_custkey", "explode(array('a', 'b', 'c')) AS part").selectExpr(
        "3 * c_custkey + ascii(part) - 97 AS ord", "'X' || CAST(c_custkey AS STRING) || part AS record_id", "'list' AS source", "lpad(CAST(c_custkey AS STRING), 6, '0') || ' firm' AS company_name",
        "'+324' || lpad(CAST(70000000 + c_custkey AS STRING), 8, '0') AS phone", "CASE part WHEN 'a' THEN '8500' WHEN 'c' THEN '3000' END AS postcode",
    )
    rows = stored(matching.features(to_records(raw, ACCOUNTS), ACCOUNTS), "features")
    matches = stored(matching.score_pairs(rows, matching.block_pairs(rows, identifiers_only=True)), "matches").where("reason like 'same phone%' or reason like 'conflicting%'")
    return matching.cluster(rows, matches, at_once=100).select("a", "b", "accepted", "reason")


@query("""WITH m AS (SELECT c_mktsegment AS segment, 'M' || c_custkey AS record_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place FROM customer),
g AS (SELECT segment, max(CASE WHEN place = 0 THEN record_id END) AS record_id, count(*) AS n FROM m GROUP BY segment)
SELECT record_id, 'verified' AS phone_state, 'same value in s0 and s1' AS phone_note, CASE WHEN n > 100 THEN 'conflict' ELSE 'unverified' END AS city_state, CASE WHEN n > 100 THEN 'differs between sources: Gent vs Brugge' ELSE '' END AS city_note,
  CASE WHEN n > 100 THEN 'Brugge' ELSE '' END AS city_other, CASE WHEN n > 40 THEN 's40' ELSE NULL END AS email_source,
  'note: merged ' || (n - 1) || ' duplicate record(s) - planted' || CASE WHEN n > 100 THEN '|merged duplicates disagree on: city: Gent vs Brugge - review' ELSE '' END AS flags FROM g""")
def g11_large_clusters(spark, sf_dir):
    """The customers of a market segment as one cluster: a telephone that all have from two sources, an e-mail address that the 41st brings, and a town in
    which the 101st differs."""
    ranked = matching.numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"])
    firsts = ranked.groupBy("c_mktsegment").agg(F.min("number").alias("start"), F.min("c_custkey").alias("first"), F.count("*").cast("int").alias("size"))
    placed = stored(ranked.join(firsts, "c_mktsegment").withColumn("place", (F.col("number") - F.col("start")).cast("int")), "placed")
    rows = placed.selectExpr("c_custkey AS ord", "'M' || CAST(c_custkey AS STRING) AS record_id", "CASE WHEN place = 40 THEN 's40' ELSE 's' || CAST(place % 2 AS STRING) END AS source", "'+32470000000' AS phone", "CASE WHEN place = 40 THEN 'x@y.be' END AS email", "CASE place WHEN 100 THEN 'Brugge' WHEN 0 THEN 'Gent' END AS city")
    membership = placed.selectExpr("c_mktsegment AS group_id", "0 AS part", "1 AS number", "'planted' AS reason", "'M' || CAST(first AS STRING) AS master_id", "size", "place", "'M' || CAST(c_custkey AS STRING) AS record_id")
    out = matching.merge_fields(to_records(rows, ACCOUNTS), membership, ACCOUNTS)
    return out.select("record_id", F.col("f_phone.status").alias("phone_state"), F.col("f_phone.note").alias("phone_note"), F.col("f_city.status").alias("city_state"), F.col("f_city.note").alias("city_note"), F.array_join("f_city.candidates", ",").alias("city_other"), F.col("f_email.source").alias("email_source"), F.array_join("merge_flags", "|").alias("flags"))


# --- SQL of queries that the registry has without any

SQL["g4_flag_counts"] = SQL["g4_s7_flag_counts"]
SQL["g8_problem_counts"] = SQL["g8_problem_totals"]
SQL["x5_audit"] = _NORMAL + _AUDITED + "SELECT d.status, count(x.record_id)::BIGINT AS n FROM (SELECT unnest(['VERIFIED','PARTIALLY_VERIFIED','UNVERIFIED','NEEDS_REVIEW','EXCLUDED']) AS status) d LEFT JOIN x ON x.status = d.status GROUP BY 1"
