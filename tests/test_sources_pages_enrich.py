import json

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import enrich, pages, workspace
from quarrymill.operators.records import plain, to_records, value
from quarrymill.schema import ACCOUNTS, COMPANIES, LEADS, FieldDef, Schema
from quarrymill.sources import delimited, landed, registry

HOME = """<html><head><title>Acme  Brugge</title><meta name="Description" content=" Best pumps "><style>x{}</style></head><body><script>var e='no@x.be'</script>
<p>Mail <a href="mailto:info@acme.be?subject=x">us</a> or sales [at] acme [dot] be, logo@2x.png, call 056 20 55 88</p><a href="tel:+32498123456">mobile</a>
<a href="/contact">Contact</a><a href="about">About us</a><a href="https://www.facebook.com/sharer/x">share</a><a href="https://www.facebook.com/acmebrugge/">fb</a><p>BTW BE 0629.985.405</p></body></html>"""


def test_schema():
    assert LEADS.name_field == "company_name" and Schema("x", (FieldDef("a"),)).name_field == "a"
    assert not ACCOUNTS.optional(["company_name"]).field("company_name").required
    for bad in (lambda: Schema("x", ()), lambda: FieldDef("a b"), lambda: ACCOUNTS.override({"zz": {}}), lambda: Schema("x", (FieldDef("a"), FieldDef("a")))):
        with pytest.raises(ValueError):
            bad()
    assert Schema.of({"name": "y", "fields": [{"name": "k", "type": "enum", "enum": ["a", "b"]}]}).field("k").enum == ("a", "b")


def test_delimited(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('﻿Company;Tel;City;Odd\n"Acme ""X""; NV";056 20 55 88;;1\n;;;\nB;;Gent;2\n', encoding="utf-8")
    rows = delimited.read_table(spark, str(path))
    assert rows.columns == ["Company", "Tel", "City", "Odd"]
    assert delimited.map_columns(rows.columns, LEADS) == ({"Company": "company_name", "Tel": "phone", "City": "city"}, ["Odd"])
    got = [(r.record_id, r.source_id, r.name, r.country) for r in delimited.ingest_rows(rows, LEADS, "list", "BE").select("record_id", "source_id", value("company_name").alias("name"), value("country").alias("country")).collect()]
    assert got == [("ROW-0002", "row 2", 'Acme "X"; NV', "BE"), ("ROW-0003", "row 3", "B", "BE")]
    for headers in (["a", "A"], ["a", ""], []):
        with pytest.raises(ValueError):
            delimited.check_headers(headers)
    with pytest.raises(ValueError):
        delimited.map_columns(["Company", "Organisation"], LEADS)
    path.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):  # noqa: B017
        delimited.read_table(spark, str(path)).collect()


def test_map_elements(spark):
    rows = [
        {"type": "node", "id": 1, "lat": 50.8, "lon": 3.2, "tags": {"name": "A", "amenity": "fast_food", "cuisine": "pizza;pasta", "contact:phone": "", "phone": "1"}},
        {"type": "way", "id": 2, "center": {"lat": 50.9, "lon": 3.3}, "tags": {"brand": "B", "shop": "yes", "official_name": "B NV"}}, {"type": "node", "id": 3, "tags": {}},
    ]
    df = spark.read.schema("type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>").json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    got = {r.source_id: r for r in landed.map_elements(df).collect()}
    assert (got["node/1"].company_name, got["node/1"].category, got["node/1"].subcategory, got["node/1"].phone) == ("A", "fast food", "pizza, pasta", "1")
    assert (got["way/2"].company_name, got["way/2"].legal_name, got["way/2"].latitude) == ("B", "B NV", "50.9") and len(got) == 2
    assert landed.select_elements(df, ["amenity=fast_food|cafe", "shop"]).count() == 2 and landed.select_elements(df, ["shop=no"]).count() == 0 and landed.select_elements(df, ["shop", "amenity"], (50.85, 3, 51, 4)).count() == 1


def test_answers_that_are_none(spark):
    """The map's and the register's transient errors, broken and odd bodies, nulls."""
    m, r = "https://m/api/interpreter", "https://r/vies/rest-api/x"
    rows = [
        (m, '{"elements": [], "remark": "runtime error: x"}', False), (m, '{"elements": [{"id": 1}], "remark": "RUNTIME ERROR"}', False), (m, '{"elements": [{"id": 1}]}', True), (m, '{"elements": []}', True), (m, '{"elements": "odd", "remark": "no"}', False),
        (m, "", False), (m, None, False), (m, '[1]', True), (r, '{"userError": "valid"}', True), (r, '{"userError": ""}', True), (r, '{}', True), (r, '{"userError": "MS_UNAVAILABLE"}', False), (r, '{"userError": "VALID", "errorWrappers": [{"error": "E"}]}', False),
        (r, '{"errorWrappers": []}', True), (r, "<html>", False), ("https://x/", "<html>", True), (None, None, True),
    ]
    df = spark.createDataFrame([(i, u, b) for i, (u, b, _) in enumerate(rows)], "i int, url string, body string")
    got = {x.i: (x.usable, x.why) for x in landed.judged_answers(df).select("i", "usable", "why").collect()}
    assert [got[i][0] for i in range(len(rows))] == [ok for *_, ok in rows]
    assert got[12][1] == "E" and got[14][1] == "unreadable" and all((why == "") == ok for ok, why in got.values())
    assert landed.elements_of(landed.judged_answers(df)).count() == 0  # no element has a type


def test_areas_and_graph(spark):
    rows = [("Kortrijk", "node", 9, "place", "city", 0.9, "city", "Kortrijk"), ("Kortrijk", "relation", 5, "boundary", "administrative", 0.4, "city", "Kortrijk"), ("Kortrijk", "way", 7, "boundary", "administrative", 0.8, "state", "Other")]
    df = spark.createDataFrame(rows, "query string, osm_type string, osm_id long, category string, type string, importance double, addresstype string, name string")
    assert landed.resolve_areas(df).first().area_id == 3_600_000_005
    out = landed.area_defaults(spark.createDataFrame([(None, None), ("NL", "X")], "country string, city string"), df.limit(1), "BE").collect()
    assert sorted(tuple(r) for r in out) == [("BE", "Kortrijk"), ("NL", "X")]
    v = lambda x: (x,)
    graph = spark.createDataFrame([(v("http://w/Q1"), v("Q1"), v("2001-05-06T"), v("acme"), v("MAILTO:a@b.be"))], ", ".join(f"{c} struct<value:string>" for c in ("company", "companyLabel", "dissolved", "linkedin", "email")))
    r = landed.graph_bindings(graph, "BE").first()
    assert (r.company_name, r.status_note, r.linkedin, r.email, len(r.flags)) == (None, "dissolved 2001-05-06", "https://www.linkedin.com/company/acme", "a@b.be", 2)


def test_registry(spark):
    df = spark.createDataFrame([("a",), ("b",)], "company_name string")
    out, warnings = registry.union_sources([(lambda: df, 1), (lambda: 1 / 0, None), (lambda: df.withColumn("city", F.lit("x")), None)], 2, "company_name")
    assert out.count() == 2 and len(warnings) == 1
    with pytest.raises(ValueError):
        registry.union_sources([(lambda: df.limit(0), None)], order="company_name")
    with pytest.raises(ValueError):
        registry.source(spark, "none such")


def test_pages(spark):
    df = spark.createDataFrame([("https://acme.be/", HOME, "acme.be", 0), ("https://acme.be/contact", "<p>Second: info@acme.be jan@acme.be</p>", "acme.be", 1), ("https://acme.be/x", None, "acme.be", 2)], "url string, html string, site string, page_ord int")
    content = pages.page_content(df, "site", "page_ord").cache()
    r = pages.site_contacts(content).first()
    assert (r.title, r.description) == ("Acme  Brugge", "Best pumps")
    assert list(r.emails) == ["info@acme.be", "sales@acme.be", "jan@acme.be"] and list(r.phones) == ["+32498123456", "+3256205588"] and list(r.vat_numbers) == ["BE0629985405"]
    assert [tuple(s) for s in r.socials] == [("facebook", "https://www.facebook.com/acmebrugge")]
    assert [(x.link, x.score) for x in pages.contact_links(content).orderBy(F.desc("score")).collect()] == [("https://acme.be/contact", 3), ("https://acme.be/about", 1)]
    names = content.where("page_ord = 0").select(pages.name_match(F.lit("Acme NV"), F.col("title"), F.col("text")), pages.name_match(F.lit("Zebra Holding"), F.col("title"), F.col("text"))).first()
    assert names[0] == 100 and names[1] < 90


def test_deep_pages_and_implied_ends(spark):
    html = "<p>" * 1200 + "x" + "<div>" * 3000 + "<a href='/y'>y</a><ul><li>a<li>b<li>c</ul>"
    df = spark.createDataFrame([("http://a.be/", html), ("http://b.be/", None)], "url string, html string")
    got = pages.html_items(df, "li", {"name": {}}).collect()
    assert [(r.item, r.name) for r in sorted(got, key=lambda r: r.item)] == [(0, "a"), (1, "b"), (2, "c")]
    assert pages.html_items(df, "ul > li:nth-of-type(2), a", {"name": {}}).count() == 2


@pytest.mark.parametrize("selector", ["p:not(.b)", "a >", "", "a[b"])
def test_unsupported_selectors_fail_at_once(spark, selector):
    df = spark.createDataFrame([("u", "<p>")], "url string, html string")
    with pytest.raises(ValueError, match="selector"):
        pages.html_items(df, None, {"x": {"selector": selector or " , a"}})


def test_phones_of_whole_texts(spark):
    text = "word " * 50_000 + "tel 0498 12 34 56"
    df = spark.createDataFrame([(text,)], "text string").select(pages.phones(F.col("text"), F.array().cast("array<string>")).alias("p"))
    assert list(df.first().p) == ["+32498123456"]


def test_sites_keep_texts_in_their_rows(spark):
    rows = [("https://acme.be/", "<p>one</p>", "acme.be", 0), ("https://acme.be/b", "<p>two b@acme.be a@acme.be</p>", "acme.be", 1), ("https://acme.be/c", "<p>a@acme.be</p>", "acme.be", 2), ("x", "<p>four</p>", None, 3)]
    content = pages.page_content(spark.createDataFrame(rows, "url string, html string, site string, page_ord int"), "site", "page_ord")
    texts = {r.page_ord: r.text for r in content.collect()}
    got = {r.site: r for r in pages.site_contacts(content).collect()}
    assert "text" not in got[None] and got["acme.be"].text_length == len(" ".join(texts[k] for k in range(3))) and got[None].text_length == len(texts[3])
    assert sorted(got["acme.be"].emails) == ["a@acme.be", "b@acme.be"] and list(got[None].emails) == list(got[None].socials) == []


def test_listing(spark):
    page = '<article class="pod"><h3><a title="T{0}" href="../i{0}.html">x</a></h3><p class="star Three"></p><p class="price">£5{0}.10</p></article>'
    rows = [("http://b.com/c/1", "<ol>" + page.format(1) + page.format(2) + '</ol><li class="next"><a href="2">n</a></li>'), ("http://b.com/c/2", page.format(3)), ("http://b.com/i1.html", "<table><tr><th>UPC</th><td>abc</td></tr></table>")]
    df = spark.createDataFrame(rows, "url string, html string")
    spec = {"title": {"selector": "h3 a", "attr": "title"}, "product_url": {"selector": "h3 > a", "attr": "href", "absolute": True}, "price": {"selector": ".price", "regex": r"([\d.]+)"}, "rating": {"selector": "p.star", "attr": "class", "regex": r"star (\w+)", "map": {"Three": 3}}, "stock": {"selector": ".none", "default": "0"}}
    walk = pages.follow_pages(df, "http://b.com/c/1", "li.next a")
    assert sorted((r.url, r.page_no) for r in walk.collect()) == [("http://b.com/c/1", 1), ("http://b.com/c/2", 2)]
    items = pages.html_items(walk, "article.pod", spec, {"currency": "GBP"})
    assert [tuple(r)[2:] for r in items.orderBy("title").collect()][0] == ("T1", "http://b.com/i1.html", "51.10", "3", "0", "GBP")
    out = {r.title: r for r in pages.detail_join(items, df, "product_url", {"upc": "tr:nth-of-type(1) td"}).collect()}
    assert (out["T1"].upc, out["T1"].detail_error, out["T2"].detail_error) == ("abc", None, "page not landed")


def test_pointers_double(spark):
    """A chain, a chain into a cycle, a gap, and a start that isn't there."""
    links = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("c150", None)] + [(f"r{i}", f"r{i + 1}") for i in range(20)] + [("r20", "r7"), ("g0", "g1"), ("g1", "g2"), ("s", "s")]
    df = spark.createDataFrame(links, "url string, next_url string")
    walk = lambda start, most=None: {r.url: r.page_no for r in pages.reached_pages(df, start, most).collect()}
    assert walk("c0") == {f"c{i}": i + 1 for i in range(151)}
    assert walk("c3", 10) == {f"c{i + 3}": i + 1 for i in range(10)}
    assert walk("r2") == {f"r{i}": i - 1 for i in range(2, 21)}
    assert walk("r9") == {f"r{i}": (i - 9) % 14 + 1 for i in range(7, 21)}
    assert walk("g0") == {"g0": 1, "g1": 2} and walk("s") == {"s": 1} and walk("none") == {}


def test_pages_that_no_item_names_are_not_parsed(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"u{i}", f"<b>{i}</b>") for i in range(30)], "url string, html string")
    items = spark.createDataFrame([("u1",), ("u2",), ("gone",), (None,)], "link string")
    out = pages.detail_join(items, df, "link", {"title": "b"})
    assert sorted(map(str, ((r.link, r.title, r.detail_error) for r in out.collect()))) == sorted(map(str, [("u1", "1", None), ("u2", "2", None), ("gone", None, "page not landed"), (None, None, "page not landed")]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftSemi")  # the semi-join lies below the parser
    assert out.select(F.count("*")).first()[0] == 4


def test_a_run_that_was_cut_off_is_saved_again(spark, tmp_path):
    from quarrymill.operators import workspace
    from quarrymill.operators.records import to_records

    folder = f"file://{tmp_path}/w"
    records = to_records(spark.createDataFrame([("R1", "A"), ("R2", "B")], "record_id string, company_name string"), COMPANIES)
    records.withColumn("run_id", F.lit("r1")).write.partitionBy("run_id").parquet(f"{folder}/records")  # and no row of the run
    with pytest.raises(ValueError, match="no such run"):
        workspace.load_run(spark, folder, "r1")
    for run in ("r1", "r2"):
        workspace.save_run(records, folder, run, "p", COMPANIES)
    assert [workspace.load_run(spark, folder, run).count() for run in ("r1", "r2")] == [2, 2]
    with pytest.raises(ValueError, match="already"):
        workspace.save_run(records, folder, "r1", "p", COMPANIES)


def test_enrichment(spark):
    rows = [("R1", "Acme Brugge", "https://acme.be/", "info@acme.be", "+3256205588", "BE0629985405", "8500"), ("R2", "Zebra", "https://zebra.be/", "x@dead.be", None, "BE0629985404", None), ("R3", "Koen Bakkerij", None, None, None, None, None)]
    base = to_records(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, record_id string, company_name string, website string, email string, phone string, vat_number string, postcode string"), COMPANIES, "list")
    sites = spark.createDataFrame([("R1", "live", 200, "https://acme.be/", "", 100.0, ["info@acme.be"], ["+3256205588", "+32498123456"], ["BE0629985405"], {"facebook": "https://www.facebook.com/acme"}, "Pumps"), ("R2", "dead", 404, "https://zebra.be/", "", 0.0, [], [], [], {}, "")], "record_id string, outcome string, http_status int, final_url string, error string, name_score double, emails array<string>, phones array<string>, vat_numbers array<string>, socials map<string,string>, description string")
    out = enrich.apply_site(base, sites, COMPANIES)
    register = spark.createDataFrame([("BE0629985405", True, "ACME BRUGGE NV", "Weg 1\n9000 Gent", "")], "vat string, valid boolean, name string, address string, error string")
    out = enrich.apply_vat_register(out, register, COMPANIES)
    out = enrich.apply_mail_domains(out, spark.createDataFrame([("dead.be", False), ("acme.be", True)], "domain string, deliverable boolean"))
    hits = spark.createDataFrame([("R3", 0, "https://www.yelp.com/koen", "Koen Bakkerij", ""), ("R3", 1, "bakkerijkoen.be", "Bakkerij", "Koen"), ("R3", 2, "other.be", "x", "")], "record_id string, place int, url string, title string, snippet string")
    out = enrich.find_missing_websites(out, hits, COMPANIES)
    got = {r.record_id: r for r in plain(out, COMPANIES, "flags").collect()}
    a, b, c = got["R1"], got["R2"], got["R3"]
    assert [a.website_status, a.company_name_status, a.email_status, a.phone_status, a.vat_number_status, a.facebook_status] == ["verified"] * 6
    assert (a.legal_name, a.description) == ("ACME BRUGGE NV", "Pumps") and "note: VAT registered address is 9000 Gent (different postcode)" in a.flags
    assert (b.website_status, b.vat_number_status, b.email_status) == ("invalid", "invalid", "invalid") and len(b.flags) == 3
    assert c.website == "https://bakkerijkoen.be/" and c.flags == ["website found via web search - verify"]
    profiles = spark.createDataFrame([("https://www.acme.be", "https://li/acme", "Pumps", 5)], "website string, linkedin string, industry string, employees int").select("*", *[F.lit(None).cast("string").alias(n) for n in ("founded", "description", "phone", "facebook")])
    more = {r.record_id: r for r in plain(enrich.apply_org_profiles(base, profiles, COMPANIES), COMPANIES).collect()}
    assert (more["R1"].industry, more["R1"].employees, more["R2"].industry) == ("Pumps", "5", None)


def test_workspace(spark, tmp_path):
    folder = str(tmp_path / "ws")
    one = to_records(spark.createDataFrame([(1, "A1", "AC1", "Acme"), (2, "A2", "AC2", "B")], "ord long, record_id string, account_id string, company_name string"), ACCOUNTS, "l")
    one = one.withColumns({"status": F.lit("UNVERIFIED"), "duplicate_of": F.lit("")})
    workspace.save_run(one, folder, "r1", "p", ACCOUNTS)
    for bad, run in ((one.union(one), "r2"), (one, "r1")):  # repeated ids; a known run
        with pytest.raises(ValueError):
            workspace.save_run(bad, folder, run, "p", ACCOUNTS)
    back = workspace.load_run(spark, folder, "r1")
    proposals = spark.createDataFrame([(1, "r1", "A1", "approved", "me", "", 0), (2, "r1", "A1", "approved", "you", "", 0), (3, "r1", "A2", "rejected", "me", "", 0), (4, "r1", "zz", "pending", "me", "", 0)], "proposal_id long, run_id string, record_id string, decision string, reviewer string, note string, expected_revision int").withColumn("created_at", F.current_timestamp())
    events, refused = workspace.apply_decisions(proposals, back, spark.createDataFrame([], workspace.EVENTS), ACCOUNTS)
    assert [(r.record_id, r.reviewer, r.revision) for r in events.collect()] == [("A1", "me", 1)] and sorted(r.proposal_id for r in refused.collect()) == [2, 3, 4]
    rows = workspace.approved(back, workspace.current_reviews(events), ACCOUNTS)
    workspace.write_approved_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().company_name == "Acme"
    with pytest.raises(Exception):  # noqa: B017
        workspace.write_approved_csv(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        workspace.compare_runs(one, one, ACCOUNTS, "city")
    with pytest.raises(ValueError):
        workspace.without_run(back, "zz")
    workspace.save_run(one, folder, "r2", "p", ACCOUNTS, report={"records": 2})
    workspace.save_run(one, folder, "r3", "other", ACCOUNTS)
    workspace.save_events(events, folder)
    assert {r.change for r in workspace.compare_saved(spark, folder, "r1", "r2", ACCOUNTS).collect()} == {"unchanged"}
    for other in ("r3", "none"):
        with pytest.raises(ValueError):
            workspace.compare_saved(spark, folder, "r1", other, ACCOUNTS)
    workspace.delete_run(spark, folder, "r1")
    left = [{r.run_id for r in spark.read.parquet(f"{folder}/{t}").collect()} for t in ("runs", "records")]
    assert left == [{"r2", "r3"}] * 2 and not list((tmp_path / "ws" / "events").glob("run_id=*"))
    with pytest.raises(ValueError):
        workspace.delete_run(spark, folder, "r1")


def test_pages_are_parsed_in_runs_and_leave_no_trees():
    import gc

    import pyarrow as pa

    html = "<html><body><p>text <b>bold</b></p>" + "x" * 5000 + "<a href='mailto:a@b.be'>m</a></body></html>"
    batch = pa.RecordBatch.from_pydict({"url": [f"http://s/{k}" for k in range(2000)], "html": [html] * 1999 + [None]})
    trees = lambda: sum(isinstance(x, pages.Node) for x in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        before = trees()
        for made in (pages._contacts, lambda b: pages._items(b, "p", {"t": {}})):
            sizes, most = [], 0
            for out in made(iter([batch])):
                sizes.append(out.num_rows)
                most = max(most, trees() - before)
            assert sum(sizes) in (1999, 2000) and max(sizes) <= 500 and most < 50
    finally:
        gc.enable()
