import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import codes, numbers, similarity, text, web


def values(spark, rows, expr):
    """expr(column) for each row, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


CASES = [
    (text.clean_text, {"  a \t b\n c ": "a b c", "a\rb": "ab", "\x00 ": None, None: None, "a b c": "a b c"}),
    (lambda x: text.clean_text(x, 5), {"abcdefgh": "abcd…", "abcde": "abcde", "abc defg": "abc…"}),
    (text.normalize_name, {" - Café ’t Hof, ": "Café 't Hof", "--": None, "A|": "A"}),
    (text.name_key, {"Café Müller B.V.": "cafe muller b v", "ACME NV": "acme", "The Limited Company": "the", None: "", "ﬁne ²": "fine 2", "straße": "stra e", "x sa. y": "x y"}),
    (text.spreadsheet_safe, {"a\x01b\nc": "ab\nc"}),
    (text.csv_cell, {"=1+1": "'=1+1", "  @x": "'  @x", "a\nb": "a | b", "\tx": "'\tx", None: "", "ok": "ok", "＝x": "'＝x", "-5": "'-5", "﻿+1": "'﻿+1"}),
    (text.generalise_flag, {"duplicate of REC-AB12 (merged)": "duplicate of <id>", "email: bad 'x'": "email", "group DUP-001 - ": "group <group>", "value 'abc' odd": "value '…' odd"}),
    (web.normalize_email, {" MAILTO:Info@X.be?subject=a": "info@x.be", "info [at] x [dot] be": "info@x.be", "<a b@x.be>": "ab@x.be", "none": None, "a(at)b.c": "a@b.c"}),
    (web.is_valid_email, {"a@b.be": True, "a@b": False, "a..b@c.be": False, ".a@b.be": False, None: False, "a@b.c1": False}),
    (web.email_domain, {"a@B@C.be": "c.be", "x": None}),
    (
        web.normalize_url,
        {
            "Example.COM": "https://example.com/", "http://x.be:80/a/?utm_source=q&b=1&c=%20d#f": "http://x.be/a?b=1&c=+d", "https://x.be:8443/": "https://x.be:8443/",
            "ftp://x.be": None, "info@x.be": None, "mailto:a@b.c": None, "localhost": None, "https://WWW.x.be/A/b/": "https://www.x.be/A/b", "//x.be/y": "https://x.be/y", "http://u@x.be/": "http://x.be/", "x.be?ref=1": "https://x.be/", "x.be/?a": "https://x.be/?a=",
        },
    ),
    (web.url_domain, {"https://www.X.be/a": "x.be", "x.be/b": "x.be", None: None, "https://": None, "http://a.b:80": "a.b"}),
    (web.social_network, {"https://x.com/barco": "twitter", "https://www.barco.com": None, "https://nl-nl.facebook.com/a": "facebook", "https://fb.me/a": "facebook"}),
    (lambda x: web.normalize_social(x, "facebook"), {"bastakortrijk": "https://www.facebook.com/bastakortrijk", "https://www.facebook.com/sharer/sharer.php?u=x": None, "https://x.com/a": None, "www.facebook.com": None, "a b": None}),
    (lambda x: web.normalize_social(x, "linkedin"), {"https://www.linkedin.com/company/barco/": "https://www.linkedin.com/company/barco", "https://www.linkedin.com/": None, "https://www.linkedin.com/feed/x": None}),
    (web.is_directory, {"https://www.yelp.com/x": True, "https://barco.com": False, None: False}),
    (
        web.is_public_url,
        {
            "https://x.be/a": True, "http://127.0.0.1/": False, "http://10.1.2.3/": False, "http://8.8.8.8/": True, "ftp://x.be": False, "http://u:p@x.be": False, "http://x.be:8080": False, "http://a.local": False, "http://LOCALHOST": False,
            "http://[::1]/": False, "http://[2606:4700::1111]/": True, "http://[fc00::1]/": False, "http://192.168.1.1": False, "http://172.20.0.1": False, "http://169.254.1.1": False, "http://x.be\\a": False, None: False, "http://[2001:db8::1]/": False, "http://100.64.0.1/": False,
        },
    ),
    (codes.normalize_postcode, {" b-8500 ": "8500", None: None}),
    (lambda x: codes.normalize_postcode(x, "NL"), {"1234ab": "1234 AB"}),
    (codes.is_valid_postcode, {"8500": True, "0500": False, None: False}),
    (lambda x: codes.is_valid_postcode(x, "XX"), {"1": None, None: False}),
    (codes.normalize_vat, {"BE 0629.985.405": "BE0629985405", "0629985405": "BE0629985405", "BTW BE0629.985.405": "BE0629985405", "629985405": "BE0629985405", "VAT: nl123": "NL123"}),
    (codes.is_valid_vat, {"BE0629985405": True, "BE0629985404": False, "BE0473191041": True, "XX123": None, "BE": False, None: False, "NL123456789B01": True}),
    (codes.normalize_phone, {"056 20 55 88": "+3256205588", "+32 (0)56 20.55.88": "+3256205588", "tel:0032 56 20 55 88": "+3256205588", "0498 12.34.56; 056": "+32498123456", "0498/12.34.56; 056": None, "abc": None, "12": None, "+1 650-253-0000": "+16502530000", "+999999999": "+999999999", "call me 056 20 55 88": "+3256205588"}),
    (lambda x: codes.phone_info(x)["type"], {"+3256205588": "fixed", "+32498123456": "mobile", "080012345": "toll-free", "+16502530000": "fixed/mobile", "+4915112345678": "mobile"}),
    (lambda x: codes.phone_info(x)["valid"], {"+3256205588": True, "+32123": False, None: False, "x": False}),
    (codes.format_phone_display, {"+3256205588": "+32 56 20 55 88", "+32498123456": "+32 498 12 34 56", "bad": "bad", "+31612345678": "+31 6 12345678"}),
    (lambda x: codes.vat_address_part(x, "city"), {"Street 5\n8510 Kortrijk": "Kortrijk", "x": "", None: ""}),
    (lambda x: codes.vat_address_part(x, "postcode"), {"Street 5\n8510 Kortrijk\nBelgium": "8510"}),
    (numbers.normalize_number, {"£51.77": 51.77, "1.234,50": 1234.5, "1,234.50": 1234.5, "1,234": 1234.0, "1,5": 1.5, "3 600": 3600.0, "nan": None, "inf": None, "1e999": None, "1e3": 1000.0, "3 600": 3600.0, "-2": -2.0, None: None}),
    (numbers.normalize_integer, {"22 available": 22, "1.7": None, "Three": None}),
    (numbers.normalize_year, {"1934-01-01T00:00:00Z": 1934, "in 2024": 2024, "999": None}),
    (numbers.normalize_date, {"2013-04-22T00:00:00Z": "2013-04-22", "22/04/2013": "2013-04-22", "22-4-2013": "2013-04-22", "22.04.2013": "2013-04-22", "2013/04/22": "2013-04-22", "2013-13-45 x": "2013-13-45", "soon": None, "31/02/2013": None}),
    (lambda x: numbers.normalize_coordinate(x, "latitude"), {"50.8276": 50.8276, "500": None}),
    (lambda x: numbers.normalize_coordinate(x, "longitude"), {"120.12345678": 120.123457}),
]


@pytest.mark.parametrize(("expr", "cases"), CASES, ids=range(len(CASES)))
def test_scalars(spark, expr, cases):
    assert dict(zip(cases, values(spark, list(cases), expr))) == cases


def test_strip_accents_is_nfkd(spark):
    rows = [chr(c) for c in [*range(32, 0x3000, 3), *range(0xF900, 0xFFEF)] if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    want = ["".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)) for c in rows]
    assert values(spark, rows, text.strip_accents) == want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, l, r = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not l or not r):
        return 100.0
    gap = bool(common)
    full_l, full_r = len(common) + gap + len(l), len(common) + gap + len(r)
    out = [100 * (1 - (len(l) + len(r) - 2 * plain_lcs(l, r)) / (full_l + full_r))]
    if common:
        out += [100 * (1 - (gap + len(l)) / (len(common) + full_l)), 100 * (1 - (gap + len(r)) / (len(common) + full_r))]
    return max(out)


PAIRS = [("kitten", "sitting"), ("", "a"), ("a", "a"), ("new york mets", "mets of york new"), ("brasserie de brug", "de brug"), ("cafe den hoek", "cafe den haek"), ("abc", "xyz"), ("a b", "b a")]


def test_token_set_ratio(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in df.select(similarity.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([plain_token_set(*p) for p in PAIRS])


def random_text(rng, most, letters="ab c"):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


def test_lanes_equal_the_definition():
    rng = random.Random(1)
    pairs = [(random_text(rng, most), random_text(rng, most)) for most in (3, 20, 64, 65, 66, 130, 300) for _ in range(12)]
    pairs += [("x" * 64, "x" * 64), ("x" * 128, "x" * 200), ("ab" * 64, "ba" * 70), ("\U0001f600é\0", "é\0"), ("a" * 63 + "b", "b" + "a" * 63)]
    assert similarity.lcs_lengths(*map(list, zip(*pairs))).tolist() == [plain_lcs(a, b) for a, b in pairs]
    assert similarity.lcs_lengths([], []).tolist() == []


def test_bounds_change_no_score(spark):
    rng = random.Random(2)
    pairs = [(random_text(rng, 40, "abcd  "), random_text(rng, 40, "abcd  ")) for _ in range(150)] + PAIRS + [("a\u2003b", "b a"), (None, "x"), ("x", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    want = [plain_token_set(*p) if None not in p else 0.0 for p in pairs]
    got = df.select(similarity.token_set_ratio(F.col("a"), F.col("b")).alias("x"), similarity.token_set_ratio(F.col("a"), F.col("b"), 70.0).alias("y")).collect()
    assert [r.x for r in got] == pytest.approx(want)
    assert all(y == pytest.approx(w) if w >= 70 else y < 70 for y, w in zip([r.y for r in got], want))


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    out = 0
    for s, t in [(s, t)] + [(t, s)] * (len(a) == len(b)):
        out = max([out, *(200 * plain_lcs(s, w) / (len(s) + len(w)) for w in {t[max(0, k) : k + len(s)] for k in range(1 - len(s), len(t))})])
    return out


def test_windows_equal_the_definition(monkeypatch):
    rng = random.Random(3)
    pairs = [(random_text(rng, n, "abc"), random_text(rng, m, "abcdef")) for n, m in ((4, 9), (9, 9), (20, 60), (70, 90)) for _ in range(8)] + [("", ""), ("", "x")]
    for lanes in (7, 4096):
        monkeypatch.setattr(similarity, "LANES", lanes)
        assert similarity.partial_scores(*map(list, zip(*pairs))).tolist() == pytest.approx([plain_partial(a, b) for a, b in pairs])


def test_partial_ratio(spark):
    def plain(a, b):
        if not a or not b:
            return 100.0 if a == b else 0.0
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        windows = {t[max(0, k) : k + len(s)] for k in range(1 - len(s), len(t))}
        out = max(200 * plain_lcs(s, w) / (len(s) + len(w)) for w in windows)
        if len(a) == len(b):
            out = max(out, max(200 * plain_lcs(t, s[max(0, k) : k + len(t)]) / (len(t) + len(s[max(0, k) : k + len(t)])) for k in range(1 - len(t), len(s))))
        return out

    pairs = [("brug", "de brugge"), ("abcd", "xxabzdyy"), ("abc", "abd"), ("", "x"), ("hello world", "wrld"), ("aab", "baa")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in df.select(similarity.partial_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([plain(*p) for p in pairs])
