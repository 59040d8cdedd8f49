import random

import pytest

from quarrymill.operators import matching, rules
from quarrymill.operators.records import plain, to_records
from quarrymill.schema import LEADS

BASE = dict(company_name=None, phone=None, email=None, website=None, postcode=None, city=None, street=None, house_number=None, vat_number=None, category="x")


def table(spark, rows):
    names = ["record_id", "source", "ord", *BASE]
    data = [tuple(r.get("id", f"R{i:03d}") if n == "record_id" else r.get("source", "s") if n == "source" else i if n == "ord" else {**BASE, **r}[n] for n in names) for i, r in enumerate(rows)]
    return to_records(spark.createDataFrame(data, ", ".join(f"{n} {'long' if n == 'ord' else 'string'}" for n in names)), LEADS)


ROWS = [
    dict(company_name="Cafe De Brug", phone="+3256205588", postcode="8500", street="Markt", house_number="1"),
    dict(company_name="Café de Brug BV", phone="+3256205588", postcode="8500"),
    dict(company_name="Totally Different", phone="+3256205588"),
    dict(company_name="Bakkerij Jan", postcode="9000", street="Veld", house_number="2"),
    dict(company_name="Bakkerij Jan", postcode="9000", street="Veld", house_number="2"),
    dict(company_name="Chain Shop", website="https://chain.be/", postcode="1000"),
    dict(company_name="Chain Store Other", website="https://chain.be/x", postcode="2000"),
    dict(company_name="Lonely", postcode="3000"),
    dict(company_name="Slagerij Piet", website="https://piet.be/", postcode="4000", street="Weg", house_number="3"),
    dict(company_name="Piet Slagerij", website="https://piet.be/", postcode="4000", street="Weg", house_number="3"),
]


def test_rules(spark):
    rows = matching.features(table(spark, ROWS), LEADS)
    got = {(r.a, r.b): r for r in matching.score_pairs(rows, matching.block_pairs(rows)).collect()}
    short = {k: (r.confident, r.reason.split(";")[0]) for k, r in got.items()}
    assert short == {
        ("R000", "R001"): (True, "same phone"), ("R000", "R002"): (False, "same phone but different names - review"), ("R001", "R002"): (False, "same phone but different names - review"),
        ("R003", "R004"): (True, "names 100% similar"), ("R005", "R006"): (False, "conflicting location or legal identifier (branch or chain?) - review"), ("R008", "R009"): (True, "same website domain and address"),
    }


def test_flag_only(spark):
    records, groups = matching.dedupe(table(spark, ROWS), LEADS, merge=False)
    got = {r.record_id: r for r in records.collect()}
    assert [got[f"R00{i}"].duplicate_group for i in range(10)] == ["DUP-001", "DUP-001", "DUP-004", "DUP-002", "DUP-002", "DUP-006", "DUP-006", "", "DUP-003", "DUP-003"]
    assert all(r.duplicate_of == "" for r in got.values()) and any(f.startswith("duplicate group DUP-001") for f in got["R001"].flags)
    assert groups.count() == 6 and not any(r.merged for r in groups.collect())


def test_merge(spark):
    rows = [dict(company_name="Cafe De Brug", phone="+3256205588", city="Kortrijk", source="a"), dict(company_name="cafe de brug", phone="+3256205588", email="x@y.be", city="Gent", source="b")]
    records, groups = matching.dedupe(table(spark, rows), LEADS)
    got = {r.record_id: r for r in records.collect()}
    master, other = got["R001"], got["R000"]  # more cells are filled
    assert other.duplicate_of == "R001" and other.flags == ["duplicate of R001 (merged)"]
    assert master.f_email.value == "x@y.be" and master.f_phone.status == "verified" and master.f_company_name.note == "same value in b and a"
    assert master.f_city.status == "conflict" and master.f_city.candidates == ["Kortrijk"] and "disagree on: city: Gent vs Kortrijk" in master.flags[-1]
    table_row = matching.duplicates_table(groups, records, LEADS).first()
    assert (table_row.action, table_row.kept_id, table_row.other_ids, table_row.similarity) == ("merged automatically", "R001", "R000", 100)


def test_bridge_is_refused(spark):
    rows = [dict(company_name="Acme", phone="+3256205588", postcode=p) for p in ("8500", None, "3000")]
    records, groups = matching.dedupe(table(spark, rows), LEADS)
    merged = {r.record_id: r.duplicate_of for r in records.collect()}
    assert {merged["R000"], merged["R002"]} != {"R001"} and sum(v != "" for v in merged.values()) == 1
    assert any(r.reason == matching.REFUSED or "conflicting" in r.reason for r in groups.collect())


def test_large_block_and_budget(spark):
    rows = [dict(company_name=f"Firm {i}", email="shared@x.be") for i in range(120)]
    own = matching.features(table(spark, rows), LEADS)
    pairs = matching.block_pairs(own, part=50)
    assert pairs.count() == 120 * 119 // 2 and pairs.where("a_ord = 0 and b_ord = 119").count() == 1
    whole = matching.block_pairs(own)
    assert pairs.exceptAll(whole).isEmpty() and whole.exceptAll(pairs).isEmpty()
    with pytest.raises(ValueError, match="email:shared@x.be .120."):
        matching.block_pairs(own, 1000)


def plain_clusters(rows):
    """The order-dependent definition, on feature rows and matches."""
    feats = {r["record_id"]: r for r in rows["features"]}
    cluster = {}
    out = []
    for m in rows["matches"]:
        if not m["confident"]:
            continue
        left, right = cluster.setdefault(m["a"], {m["a"]}), cluster.setdefault(m["b"], {m["b"]})
        clash = any(feats[x]["identity"][k] and feats[y]["identity"][k] and feats[x]["identity"][k] != feats[y]["identity"][k] for x in left for y in right for k in matching.IDENTITY)
        out.append((m["a"], m["b"], not clash))
        if not clash:
            both = left | right
            for x in both:
                cluster[x] = both
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_replay(spark, seed):
    rng = random.Random(seed)
    rows = [dict(company_name=rng.choice(["Acme One", "Acme Two", "Brug"]), phone=rng.choice([None, "+3256205588", "+3256205589"]), email=rng.choice([None, "a@x.be", "b@x.be"]), postcode=rng.choice([None, None, "8500", "9000"])) for _ in range(24)]
    for parts in (1, 5):
        feats = matching.features(table(spark, rows).repartition(parts), LEADS)
        matches = matching.score_pairs(feats, matching.block_pairs(feats))
        ordered = [r.asDict(True) for r in matches.orderBy("edge_ord").collect()]
        want = plain_clusters({"features": [r.asDict(True) for r in feats.collect()], "matches": ordered})
        got = {(r.a, r.b): r.accepted for r in matching.cluster(feats, matches).collect()}
        assert want and all(got[a, b] == ok for a, b, ok in want)


def plain_decisions(edges, identities):
    """Edge by edge, with the clusters as sets."""
    cluster = {n: {n} for n in identities}
    out = {}
    for place, a, b in sorted(edges):
        left, right = cluster[a], cluster[b]
        fits = not any(identities[x][k] and identities[y][k] and identities[x][k] != identities[y][k] for x in left for y in right for k in range(3))
        out[place] = fits
        if fits and left is not right:
            both = left | right
            for x in both:
                cluster[x] = both
    return out


def graph(kind, rng):
    n = 40
    identities = {i: tuple(rng.choice([None, None, "p", "q", "r"][: rng.choice([3, 4, 5])]) for _ in range(3)) for i in range(n)}
    if kind == "star":
        pairs = [(0, i) for i in range(1, n)]
    elif kind == "chain":
        pairs = [(i, i + 1) for i in range(n - 1)]
    elif kind == "clique":
        pairs = [(i, j) for i in range(14) for j in range(i)]
    else:
        pairs = [tuple(rng.sample(range(n), 2)) for _ in range(90)]
    if kind != "chain":
        rng.shuffle(pairs)
    return [(p, a, b) for p, (a, b) in enumerate(pairs)], identities


@pytest.mark.parametrize("kind", ["star", "chain", "clique", "random"])
def test_rounds_equal_replay(spark, kind):
    """Many graphs of a kind side by side, decided in rounds until 25 edges are left, and in tasks alone."""
    rng = random.Random(kind)
    edges, nodes, want = [], [], {}
    for g in range(4):
        own, identities = graph(kind, rng)
        for place, ok in plain_decisions(own, identities).items():
            want[g * 1000 + place] = ok
        edges += [(g * 100 + a, g * 100 + b, ((g * 1000 + p, 0), g * 100 + a, g * 100 + b)) for p, a, b in own]
        nodes += [(g * 100 + i, *v) for i, v in identities.items()]
    assert 0 < sum(want.values()) < len(want)
    e = spark.createDataFrame(edges, "a_ord long, b_ord long, place struct<block: struct<ord: long, pos: int>, a_ord: long, b_ord: long>")
    n = spark.createDataFrame(nodes, "node long, k0 string, k1 string, k2 string")
    place = {(a, b, p[0][0]) for a, b, p in edges}
    for at_once in (25, 10**6):
        got = matching.decide(e, n, ["k0", "k1", "k2"], at_once)
        seen = {}
        for r in got.collect():
            seen.setdefault((r.a_ord, r.b_ord), []).append(r.accepted)
        by_pair = {}
        for a, b, p in sorted(place):
            by_pair.setdefault((a, b), []).append(want[p])
        assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in by_pair.items()}, at_once


def test_a_large_component_takes_few_rounds(spark, monkeypatch):
    """A star of 3,000 records around one without an address, which five towns share: no task replays it."""
    rounds = []
    whole = matching.connected_components
    monkeypatch.setattr(matching, "connected_components", lambda *a: rounds.append(1) or whole(*a))
    edges = [(0, i, ((i, 0), 0, i)) for i in range(1, 3000)]
    e = spark.createDataFrame(edges, "a_ord long, b_ord long, place struct<block: struct<ord: long, pos: int>, a_ord: long, b_ord: long>")
    n = spark.createDataFrame([(0, None, None, None)] + [(i, f"t{i % 5}", f"s{i % 2}" if i % 3 else None, None) for i in range(1, 3000)], "node long, k0 string, k1 string, k2 string")
    got = {r.b_ord: r.accepted for r in matching.decide(e, n, ["k0", "k1", "k2"], 10).collect()}
    assert got == {i: i % 5 == 1 and (i % 3 == 0 or i % 2 == 1) for i in range(1, 3000)} and len(rounds) < 8


RANK = {"verified": 3, "unverified": 2, "conflict": 1, "invalid": 0, "missing": -1}


def plain_merge(cells, name):
    """The ordered fold over (value, source, status, note); candidates are kept in order."""
    value, source, status, note = cells[0]
    seen, conflicts = [], []

    def add(v):
        if v is not None and v != value and v not in seen:
            seen.append(v)

    for v, s, st, n in cells[1:]:
        if not (v or "").strip():
            continue
        if not (value or "").strip():
            value, source, status, note = v, s, st, n
        elif value.lower().strip() == v.lower().strip():
            if RANK[st] > RANK[status]:
                status, note, source = st, n, s
            elif status == st == "unverified" and source != s:
                status, note = "verified", f"same value in {source} and {s}"
        else:
            add(v)
            if name not in matching.COSMETIC:
                if RANK[st] > RANK[status]:
                    old, value, source, status, note = value, v, s, st, n
                    if old not in seen:
                        seen.append(old)
                    seen = [x for x in dict.fromkeys(seen)]
                text = f"{value} vs {v}"
                conflicts.append(f"{name}: {text}")
                status, note = "conflict", f"{note}; differs between sources: {text}" if note else f"differs between sources: {text}"
    return value, source, status, note, conflicts


def test_merge_equals_the_fold_and_runs_are_short(spark):
    rng = random.Random(4)
    values = {"city": ["Gent", "gent ", "Brugge", None, " "], "description": ["x", "y", None]}
    rows, members, want = [], [], {}
    for g, n in enumerate([2, 3, 9, 40, 40, 3000]):
        own = []
        for place in range(n):
            rare = rng.random() < (0.004 if n > 1000 else 0.5)
            made = {k: (rng.choice(v) if rare or place == 0 else v[0], rng.choice("ab") if rare else "a", rng.choice(["unverified", "unverified", "verified", "invalid"]) if rare else "unverified", rng.choice(["", "n"]) if rare else "") for k, v in values.items()}
            own.append(made)
            rows.append((f"g{g}r{place}", *[tuple(made[k]) for k in values], [f"f{rng.randrange(3)}", f"missing {place}"] if rare else []))
            members.append((f"G{g}", 0, g, "why", f"g{g}r0", n, place, f"g{g}r{place}"))
        want[f"g{g}r0"] = {k: plain_merge([m[k] for m in own], k) for k in values}
    cell = "struct<value:string,source:string,status:string,note:string>"
    names = [f.column for f in LEADS.fields]
    raw = spark.createDataFrame(rows, f"record_id string, f_city {cell}, f_description {cell}, flags array<string>")
    full = "struct<value:string,source:string,status:string,note:string,candidates:array<string>>"
    as_cell = lambda c: f"CAST(named_struct('value', {c}.value, 'source', {c}.source, 'status', {c}.status, 'note', {c}.note, 'candidates', array()) AS {full}) AS {c}"
    records = raw.selectExpr("record_id", "flags", *[as_cell(c) if c in ("f_city", "f_description") else f"CAST(NULL AS {full}) AS {c}" for c in names])
    membership = spark.createDataFrame(members, "group_id string, part int, number int, reason string, master_id string, size int, place int, record_id string")
    for block in (7, 1000):
        got = {r.record_id: r for r in matching.merge_fields(records, membership, LEADS, block).collect()}
        assert set(got) == set(want)
        for k, fields in want.items():
            for name, (value, source, status, note, conflicts) in fields.items():
                c = got[k][f"f_{name}"]
                if (value or "").strip():
                    assert (c.value, c.source, c.status, c.note) == (value, source, status, note), (k, name)
            wanted = fields["city"][4][:4]
            clash = [f for f in got[k].merge_flags if f.startswith("merged duplicates")]
            assert clash == ([f"merged duplicates disagree on: {'; '.join(wanted)} - review"] if wanted else [])
    # what a field of the cluster of 3,000 comes down to
    from pyspark.sql import functions as F

    each = membership.join(records, "record_id").select("group_id", "place", F.lit(0).alias("k"), F.col("f_city").alias("cell"))
    assert matching.effective_cells(each).where("group_id = 'G5'").count() < 300


def test_rules_on_records(spark):
    rows = [
        dict(company_name=" Acme  NV ", phone="056 20 55 88", email="info@acme.be", website="acme.be", postcode="8500", vat_number="BE0629985405"),
        dict(company_name=None, phone="12", email="bad@", website="other.be", postcode="ABCD"),
        dict(company_name="B", email="x@gmail.com", website="b.be", category=None),
        dict(company_name="C", email="x@else.com", website="c.be", postcode="9000", city="Gent"),
    ]
    df = rules.validate_table(rules.normalize_table(table(spark, rows), LEADS), LEADS)
    got = {r.record_id: r for r in plain(rules.assign_status(rules.verify_phones(df), LEADS), LEADS, "flags", "problems", "status").collect()}
    a, b, c, d = (got[f"R00{i}"] for i in range(4))
    assert (a.company_name, a.phone, a.website, a.status, a.flags) == ("Acme NV", "+3256205588", "https://acme.be/", "UNVERIFIED", ["note: postcode present but city missing"])
    assert b.status == "EXCLUDED" and b.phone_status == "invalid" and b.email_status == "invalid" and b.postcode_status == "invalid"
    assert "missing required field: company name" in b.problems and "phone value could not be interpreted: '12'" in b.flags
    assert c.status == "NEEDS_REVIEW" and c.problems == ["missing required field: category"]
    assert d.status == "NEEDS_REVIEW" and d.problems == ["e-mail domain (else.com) differs from website domain (c.be) - review"]
    assert rules.assign_status(df, LEADS, audit=True).where("status = 'EXCLUDED'").count() == 0
    assert df.select(rules.completeness(LEADS).alias("c"), "record_id").orderBy("record_id").first().c == 39.1  # two required fields count twice: 9 of 23


def test_pruned_pairs_hold_all_matches(spark):
    rng = random.Random(5)
    words = ["bakker", "baker", "jansen", "janssen", "de", "x", "gent", "12345", "12354", "2345", "été", "aa", "restaurant"]
    rows = [dict(company_name=" ".join(rng.choices(words, k=rng.randint(1, 4))), email=rng.choice([None, None, "a@x.be", f"m{k % 9}@y.be"]), postcode=rng.choice(["8500", "9000", None])) for k in range(150)]
    feats = matching.features(table(spark, rows), LEADS)
    for threshold in (90, 75):
        want = matching.score_pairs(feats, matching.block_pairs(feats), threshold)
        pruned = matching.block_pairs(feats, part=40, threshold=threshold)
        got = matching.score_pairs(feats, pruned, threshold)
        assert want.count() > 300 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert pruned.count() < 0.8 * matching.block_pairs(feats).count()


def test_hot_postcode_is_compared(spark):
    """As many share a postcode that all pairs are beyond the budget: those that can be matches are found."""
    rows = [dict(company_name=f"{(k * 7919) % 100003:05d} {'abcdefghij'[k % 10] * 9}", postcode="8500") for k in range(900)] + [dict(company_name="Brug zeven", postcode="8500"), dict(company_name="Brug zevem", postcode="8500")]
    feats = matching.features(table(spark, rows), LEADS)
    with pytest.raises(ValueError, match="pc:8500"):
        matching.block_pairs(feats)
    found = matching.score_pairs(feats, matching.block_pairs(feats, threshold=90)).select("a", "b").collect()
    assert ("R900", "R901") in {(r.a, r.b) for r in found}
    records, _ = matching.dedupe(table(spark, rows), LEADS)
    assert records.where("record_id in ('R900', 'R901') and duplicate_group <> ''").count() == 2


def test_identifiers_only(spark):
    rows = [dict(company_name="Acme", phone="+3256205588", postcode="8500"), dict(company_name="Acme", phone="+3256205588"), dict(company_name="Acme", postcode="8500")]
    feats = matching.features(table(spark, rows), LEADS)
    assert [(r.a_ord, r.b_ord) for r in matching.block_pairs(feats, identifiers_only=True).collect()] == [(0, 1)]


def test_pairs_are_compared_once(spark):
    from quarrymill.operators.records import to_records
    from quarrymill.schema import ACCOUNTS

    raw = spark.createDataFrame([(1, "R1", "acme steel", "1000"), (2, "R2", "acme steeel", "1000"), (3, "R3", "other", "1000")], "ord long, record_id string, company_name string, postcode string")
    rows = matching.features(to_records(raw, ACCOUNTS), ACCOUNTS)
    got = matching.score_pairs(rows, matching.block_pairs(rows))
    assert [(r.a, r.b) for r in got.select("a", "b").collect()] == [("R1", "R2")]
    assert "_lcs" not in got._jdf.queryExecution().optimizedPlan().toString()  # stored: the filter on matches compares none again
