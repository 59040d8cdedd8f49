import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quarrymill.llm.quality import base_rules, judge_quality, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n


def normal(line):
    return re.sub("[\x20\x09-\x0d]+", " ", line.lower()).strip(" ")


def plain_kept(rows, floor=3.0, slope=0.5, keep_share=0.4):
    """kept, and the text without its removed lines, of each row; the id of a row is its place."""
    hosts, lines = defaultdict(set), defaultdict(set)
    for host, text in rows:
        hosts[host].add(text)
        for x in text.split("\n"):
            if normal(x):
                lines[host, normal(x)].add(text)
    frequent = {k for k, v in lines.items() if len(v) > floor + slope * math.sqrt(len(hosts[k[0]]))}
    out, depleted = [], defaultdict(list)
    for i, (host, text) in enumerate(rows):
        gone = [normal(x) for x in text.split("\n") if (host, normal(x)) in frequent]
        clean = "\n".join(x for x in text.split("\n") if (host, normal(x)) not in frequent)
        n, left = len(WORD.findall(text)), len(WORD.findall(clean))
        out.append((not plain_base(text)[5] and left >= keep_share * n, clean))
        if not plain_base(text)[5] and left < keep_share * n:
            depleted[host, gone[0]].append((hashlib.md5(text.encode()).hexdigest()[:15], len(text), str(i), i))
    for own in depleted.values():
        i = min(own)[-1]
        out[i] = (True, rows[i][1])
    return out


TEXTS = ["", None, " \n\t ", "a b c a b c d", "a a a a", "x y", "#1 $2 | <p>\n#1 $2 | <p>\n\n#1 $2 | <p> ", "ab\x0bcd\x0cef\x85gh\xa0", "L one\nl One\n L one\nL one", "\U0001f600 é"]


def test_base_rules(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    names = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed"]
    for r in base_rules(docs).select("doc_id", *names).collect():
        assert tuple(r)[1:] == plain_base(texts[r.doc_id]), texts[r.doc_id]


def test_positions_beyond_the_packed_bits(spark, monkeypatch):
    from quarrymill.llm import quality

    monkeypatch.setattr(quality, "_BITS", 4)
    text = "a b c d e f g h i j k l m n o p q a b c x y z a b c"
    row = base_rules(spark.createDataFrame([(text,)], "text string")).select("__n_repeat_words").first()
    assert row[0] == plain_base(text)[4] == 9


def lined_corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    menus = [line(15) for _ in range(6)]
    copied = [line(30) for _ in range(4)]
    rows = []
    for k in range(60):
        own = [line(25) for _ in range(4)] + rng.sample(menus, 2)
        rows.append(("hot" if k % 3 else "cold", "\n".join(own)))
    rows += [("hot", "\n".join([*menus, line(3)])) for _ in range(3)]  # little but menus
    rows += [("hot", "\n".join([*copied, line(2)])) for _ in range(20)]  # near copies of one document
    rows += [("hot", rows[0][1])] * 15 + [("hot", "\n".join(m.upper() + " " for m in menus))]
    return rows


@pytest.mark.parametrize("most", [10_000, 0])
def test_frequent_lines(spark, monkeypatch, most):
    """Menus planted in hosts of different sizes, at the limits that queries use."""
    from quarrymill.llm import quality

    monkeypatch.setattr(quality, "BROADCAST_LINES", most)
    rows = lined_corpus()
    docs = spark.createDataFrame([(i, h, t, len(t), True) for i, (h, t) in enumerate(rows)], "doc_id int, source string, text string, n_chars long, kept boolean")
    want = plain_kept(rows)
    got = {r.doc_id: r for r in judge_quality(docs).collect()}
    assert [(got[i].kept, got[i].clean_text) for i in range(len(rows))] == want
    copies = {rows[i][1] for i in range(63, 83) if want[i][0]}
    assert sum(k for k, _ in want[60:63]) <= 1 and len(copies) == 1  # little but menus; near copies: one keeps its lines
    assert all(k and c != t for (k, c), (_, t) in zip(want[:60:3], rows[:60:3]) if c != t) and sum(c != t for (_, c), (_, t) in zip(want, rows)) > 50
    kept = keep_good(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (c, len(c)) for i, (k, c) in enumerate(want) if k}


@pytest.mark.parametrize("most", [10_000, 0])
def test_removed_lines_leave_the_texts(spark, monkeypatch, most):
    from quarrymill.llm import quality

    monkeypatch.setattr(quality, "BROADCAST_LINES", most)
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(20)]
    rows = [("a", f"Menu  HOME\n\n{own[k]}\n menu home ") for k in range(12)] + [("b", f"menu home\n{own[k]}") for k in range(12, 14)]
    rows += [("a", own[k]) for k in range(14, 18)] + [("a", rows[0][1])]
    docs = spark.createDataFrame([(i, h, t, len(t)) for i, (h, t) in enumerate(rows)], "doc_id int, source string, text string, n_chars long")
    want = {i: c for i, (_, c) in enumerate(plain_kept(rows))}
    assert sum(want[i] == f"\n{own[i]}" for i in range(12)) == 12
    kept = keep_good(docs)
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (t, len(t)) for i, t in want.items()}
    assert {r.doc_id: r.clean_text for r in judge_quality(docs).collect()} == want


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None), (1, None, "w " * 60), (1, None, "w " * 60)], "doc_id long, source string, text string")
    assert sorted((str(r.doc_id), r.kept) for r in judge_quality(docs).collect()) == [("1", False), ("1", False), ("None", False)]
    assert judge_quality(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = {"en": "the of and to in is that it was for on with as by".split(), "fr": "le la les de des et un une que qui dans pour sur par".split()}
    rows = []
    for k in range(40):
        lang = "en" if k % 2 else "fr"
        rows.append((k, " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "er"]) + str(k * (i % 9 == 0)) for i in range(150)), lang, f"s{k % 3}"))
    text = rows[5][1].split(" ")
    rows += [(50, " ".join(text[:70] + ["other"] + text[71:]), "en", "s1"), (51, rows[5][1], "en", "s0"), (51, rows[5][1], "en", "s0"), (52, "12 34 " * 60, "en", "s1")]
    rows += [(53, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(80)), None, "s1"), (54, "too short", "en", "s1"), (55, None, None, None), (None, rows[7][1], "en", "s2")]
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    first = corpus_pipeline.quality_rules(spark, docs, "")
    assert first.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in first.collect())
    assert ids == sorted(str(r.doc_id) for r in docs.collect() if not plain_base(r.text)[5])
    second = corpus_pipeline.language_id(spark, docs, "")
    assert second.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in second.collect()} == {52, 53, 55}
    third = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert third.columns == docs.columns
    got = sorted(str(r.doc_id) for r in third.collect())
    assert got == sorted(map(str, [*range(40), 52, 53, 54, 55]))
    fourth = corpus_pipeline.packing(spark, third, "").groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in fourth)


def test_language_stage_keeps_wide_alphabets(spark):
    rng = random.Random(7)
    words = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(1, 2))) for _ in range(2500)]
    rows = [(k, "，".join(rng.choice(words) for _ in range(200)), "zh") for k in range(40)]
    rows += [(k, " ".join(rng.choice(["the", "of", "and", "to", "in", "that", "was"]) for _ in range(120)), "en") for k in range(40, 80)]
    rows += [(80, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(80)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == list(range(80))


def test_language_stage_learns_from_all_documents(spark):
    from pyspark.sql import functions as F

    rng = random.Random(13)
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    order = [(r.id, r.held) for r in spark.range(400).select("id", held.alias("held")).orderBy(F.xxhash64("id")).collect()]
    first = {i for h in (True, False) for i in [i for i, own in order if own == h][:64]}
    words = {True: ["ab", "abba", "baa", "bab", "aab"], False: ["ox", "oxo", "xoo", "xx", "oo"]}  # no common letter
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[i in first]) for _ in range(150)), "en") for i, _ in order], "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, docs, "").count() == 400


def test_learnt_text_counts_every_pair(spark):
    from quarrymill.llm import language

    rows = [(1, "a b " * 500, "en"), (2, None, "en"), (3, "", "en"), (4, "x y", None), (5, "lone", "fr"), (6, "中文中文", "zh"), (7, "1 2", "de")]
    rows += [(k, f"c d w{chr(97 + k % 26)}{chr(97 + k // 26)}", "en") for k in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [dict(language.learnt_text(docs.repartition(n), 24, None, "text", "lang")) for n in (1, 4)]
    assert got[0] == got[1] and got[0].keys() == {"en", "fr", "zh"} and got[0]["fr"] == "lone" and "中文" in got[0]["zh"]
    assert "a b" in got[0]["en"] and "c d" in got[0]["en"] and len(got[0]["en"]) <= 24
    assert language.chained([(" a", " b"), (" c", " d"), (" b", " c")], 100) == "a b c d"
    assert dict(language.learnt_text(docs, 1000, 1, "text", "lang")).keys() == {"en"}


CLASHING = "id long, gone string, cost_limit double, score int, lang_pred string, phrase_cost string, __removed string, __clean int, stage_row string, member long, component_id int"


def test_columns_of_any_name_stay(spark, docs):
    names = [c.split() for c in CLASHING.split(", ")]
    wide = docs.selectExpr("*", *[f"cast(length(coalesce(text, '')) as {t}) as {c}" for c, t in names])
    key = lambda rows: sorted(map(repr, rows))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns
        assert key(out.collect()) == key(stage(spark, docs, "").selectExpr("*", *[f"cast(length(coalesce(text, '')) as {t}) as {c}" for c, t in names]).collect())


def plain_groups(rows, width=5):
    """Rows that stay when one of each group of near duplicates does, every pair compared."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    first = {}
    for i, (doc_id, text) in enumerate(rows):
        first.setdefault(of[i], []).append((doc_id is None, doc_id or 0, hashlib.md5((text or "").encode()).hexdigest(), i))
    return sorted(repr(rows[min(v)[-1]]) for v in first.values())


def test_rows_that_repeat_an_id_are_told_apart(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    rows = [(0, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[1] + " x"), (2, texts[2]), (2, texts[2]), (None, texts[3]), (None, texts[3] + " y"), (None, texts[1])]
    rows += [(5, texts[4] + " b"), (5, texts[4] + " a"), (6, ""), (6, None), (None, None)]
    for k in range(40):
        words = texts[rng.randrange(6)].split()
        words[rng.randrange(60)] = f"v{k}"
        rows.append((rng.choice([None, 3, 7, 50 + k]), " ".join(words[: rng.choice([60, 60, 40])])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5):
        got = corpus_pipeline.one_of_each_group(spark, table.repartition(n), "").collect()
        assert sorted(repr((r.doc_id, r.text)) for r in got) == plain_groups(rows)
    assert {r.text for r in got} >= {texts[0], texts[2]} and any(r.text in (texts[1], texts[1] + " x") or r.doc_id == 1 for r in got)


def test_stages_of_empty_tables(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_short_texts_are_judged_too(spark):
    from quarrymill.llm.language import within_limit
    from pyspark.sql import functions as F

    rows = [(n, c) for n in (1, 20, 50, 80, 200, 5000) for c in (3.9, 4.0, 6.9, 7.1, 8.5, 9.9, 10.0)]
    got = {(r.n, r.c): r.ok for r in spark.createDataFrame(rows, "n int, c double").select("n", "c", within_limit({"en": (4.0, 10.0)}, F.lit("en"), F.col("c"), F.col("n")).alias("ok")).collect()}
    for n, c in rows:
        assert got[n, c] == (c < 4 + 6 * min(1, 0.5 * math.sqrt(200 / min(n, 200)))), (n, c)
    assert spark.range(1).select(within_limit({}, F.lit("en"), F.lit(99.0), F.lit(5))).first()[0]


def test_run(spark):
    assert len(corpus_pipeline.STAGES) == 4
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()
