import random
import re
from collections import Counter, defaultdict

from quarrymill.llm.collocations import StripeCounter, hot_words, merged_stripes, mine_phrases, score_of
from quarrymill.llm import collocations


def plain(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed, n, langs=("en", "fr", None, "und")):
    rng = random.Random(seed)
    words = ["the", "The", "a", "of", "new", "york", "city", "\x1c", "naïve", "漢字", "x;y", "don't", "\\n"]
    gaps = [" ", "  ", "\t", ". ", ", ", "\n", "\x0b", "! "]
    return [(rng.choice(langs), "".join(rng.choice(words) + rng.choices(gaps, [30, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(0, 120)))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 3) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a int")


def test_equals_definition(spark):
    rows = [*made(1, 150), ("en", None), ("en", ""), ("de", "one two three"), (None, "of the " * 50), ("en", "ha " * 3000), ("en", "ha " * 3000)]
    wanted = plain(rows)
    assert len({r[0] for r in wanted}) == 3
    for options in ({}, {"tokens": 50}):
        assert sorted(tuple(r) for r in mine_phrases(frame(spark, rows), **options).collect()) == wanted, options
    assert sorted(tuple(r) for r in mine_phrases(frame(spark, rows), least=3, share=80, top=7).collect()) == plain(rows, 3, 80, 7)


def test_long_text_in_parts():
    text = " ".join(t for _, t in made(5, 60))

    def counted(width, **options):
        counter, out = StripeCounter(width, **options), Counter()
        for batch in [*counter.add("en", text), *counter.add("fr", text), *counter.flush()]:
            for r in batch.to_pylist():
                for w, c in zip(r["next"], r["counts"]):
                    out[r["lang"], r["w1"], r["w2"], w] += c
        return out

    pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    for width in (1, 2):
        want = Counter()
        for w in pieces:
            for lang in ("en", "fr"):
                for i in range(len(w) - width + 1):
                    if width == 1 or i + 2 < len(w):
                        want[lang, w[i], w[i + 1] if width == 2 else None, w[i + width] if i + width < len(w) else None] += 1
        hot = frozenset({("en", b"the")})
        assert want == counted(width, tokens=10**9) == counted(width, tokens=30, part=70, hot=hot) == counted(width, tokens=1, part=1)


def test_exact_scores(spark):
    a, left, right = 999_999_999_999_989, 999_999_999_999_991, 999_999_999_999_997
    got = spark.createDataFrame([(a, left, right), (7, 9, 11)], "a long, l long, r long").select(score_of("a", "l", "r")).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (left * right), 1_000_000 * 49 // 99]


def test_empty_table_and_one_prefix(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mine_phrases(none).count() == 0
    # everything follows one word: its stripe lies in many slices, and the total is that of all
    texts = frame(spark, [("en", " ".join(f"a w{i % 700}x" for i in range(k, k + 2000))) for k in range(4)]).select("lang", "text")
    merged = merged_stripes(texts, 1, 10, 3_000_000, frozenset({("en", b"a")})).where("w1 = 'a'")
    assert merged.count() > 30 and merged.selectExpr("sum(total)").first()[0] == 8000
    assert merged_stripes(texts, 1, 10, 3_000_000, frozenset()).where("w1 = 'a'").count() == 1


def test_layout_and_filter_change_nothing(spark, monkeypatch):
    rows = made(3, 120)
    wanted = plain(rows)
    assert hot_words(frame(spark, rows * 3).select("lang", "text")) is not None
    monkeypatch.setattr(collocations, "hot_words", lambda texts: frozenset((c, w) for c in ("en", "fr", "und") for w in (b"the", b"of", b"a")))
    monkeypatch.setattr(collocations, "pair_filter", lambda two: b"\xff" * (collocations.FILTER_BITS // 8))
    assert sorted(tuple(r) for r in mine_phrases(frame(spark, rows)).collect()) == wanted
