import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarrymill.llm import language, telephony, url_filter
from quarrymill.llm.common import tokenizer_path
from quarrymill.llm.pieces import PieceModel, decode_pieces, encode_pieces

# --- URL filter


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = []
    for rule, _ in url_filter.RULES:
        at, rest = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    "http://www.EXAMPLE.com/en/1?x#y", "https://example.com/en/", "https://example.com/en", "http://a.net/es/2", "http://a.net/fr/", "http://net/es/x",
    "http://a.org/x", "http://spam.org/en/?q=http://b.com/", None, "", "no scheme.com/", "x://y://z/en/", "http://com", "http://com/", "http://notcom/", "a\nb://C.com/\nen/?", "http://sub.example.com/en/9", "http://Ünï.com/",
] * 2


def test_urls(spark):
    rows = [(i if i != 3 else None, u, "rule") for i, u in enumerate(URLS)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        r = by[i]
        assert (r.host, r.path) == plain_parts(u)
        assert r.rule == plain_rule(r.host, r.path)
        if r.rule:
            assert r.verdict == dict(url_filter.RULES)[r.rule]
        else:
            assert r.verdict == ("block" if r.block_score >= 0.5 else "allow")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_model_learns():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(f"{'pills' if k % 2 else 'news'}-{word()}.org", f"/{word()}") for k in range(400)]
    y = np.arange(400) % 2
    model = url_filter.UrlModel().fit(*zip(*rows[:300]), y[:300])
    assert ((model.probability(*zip(*rows[300:])) > 0.5) == y[300:]).mean() > 0.97
    one = url_filter.UrlModel().fit(["a"], ["/"], np.array([True]))
    assert one.probability(["b"], ["/"])[0] > 0.9 and url_filter.UrlModel().fit([], [], np.array([])).probability(["b"], [""])[0] < 0.1


def test_url_model_on_held_out_rules(spark):
    """Fitted on four fifths of the URLs with a rule, by hash, and asked for the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = sorted({(r.host, r.path, r.verdict == "block") for r in url_filter.filter_urls(pages).where("rule is not null").collect()})
    held = [zlib.crc32(f"{h}{p}".encode()) % 5 == 0 for h, p, _ in rows]
    hosts, paths, block = zip(*[r for r, k in zip(rows, held) if not k])
    model = url_filter.UrlModel().fit(hosts, paths, np.array(block))
    hosts, paths, block = zip(*[r for r, k in zip(rows, held) if k])
    got = ((model.probability(hosts, paths) >= 0.5) == np.array(block)).mean()
    assert len(block) > 100 and got > 0.95, got


# --- Telephony


def scalar_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step, diff = int(telephony.IMA_STEPS[index]), 0
            diff = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(telephony.IMA_MOVES[code])))
            out.append(value)
    return out


def test_tables():
    mu, a = telephony.TABLES[telephony.MU_LAW], telephony.TABLES[telephony.A_LAW]
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_equals_scalar():
    blocks = np.random.default_rng(2).integers(0, 256, (7, 36), dtype=np.uint8)
    got = telephony.decode_ima_blocks(blocks)
    assert got.tolist() == [scalar_ima(b.tobytes()) for b in blocks]


def test_resample_keeps_a_tone():
    x = (8000 * np.sin(np.arange(4000) * 2 * math.pi * 300 / 8000)).astype(np.int16)
    y = telephony.resample(x, 8000, 16000)
    want = 8000 * np.sin(np.arange(8000) * 2 * math.pi * 300 / 16000)
    assert len(y) == 8000 and np.abs(y[100:-100] - want[100:-100]).max() < 100
    assert len(telephony.resample(x, 8000, 11025)) == math.ceil(4000 * 11025 / 8000)
    assert len(telephony.resample(x[:0], 8000, 16000)) == 0


def plain_resample(x, rate, to, taps=8):
    """Zeros between the samples, the whole filter over all of them, every ``down``-th of the sums."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    h = telephony._filter(up, down, taps).astype(np.int64)
    wide = np.zeros(len(x) * up, np.int64)
    wide[::up] = x
    full = np.convolve(wide, h)[len(h) // 2 :][: len(wide)]
    return np.clip((full + (1 << 13)) >> 14, -32768, 32767)[::down][: -(-len(x) * up // down)]


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(telephony, "BLOCK_SAMPLES", block)
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 400):
        x = rng.integers(-3000, 3000, n).astype(np.int16)
        for native in (8000, 11_025):
            assert telephony.resample(x, native, 16_000).tolist() == plain_resample(x, native, 16_000).tolist()
        assert (telephony.from_planes(telephony.to_planes(x)) == x).all()
        y = x.astype(object)
        rough = sum(abs(p - q) for p, q in zip(y, y[1:])) // max(1, n - 1)
        crossings = sum((p < 0) != (q < 0) for p, q in zip(y, y[1:]))
        assert telephony.describe(x) == f"n={n};rms={math.isqrt(sum(v * v for v in y) // n)};peak={max(map(abs, y))};zc={crossings};rough={rough}"
    assert telephony.describe(x[:0]) == "n=0;rms=0;peak=0;zc=0;rough=0"


def test_a_very_long_text(spark):
    """50 MB beside short ones: tasks go by bytes, not by rows."""
    docs = spark.createDataFrame([(1, "short"), (2, "a text of some length, "), (3, None)], "doc_id long, text string").selectExpr("doc_id", "case when doc_id = 2 then repeat(text, 2200000) else text end as text")
    got = {r.doc_id: r for r in telephony.store_text_audio(docs, keep=["doc_id", "n_bytes", "payload_bytes", "n_samples"]).collect()}
    assert got[2].n_bytes == 23 * 2_200_000 and got[2].feature.startswith(f"n={2 * got[2].n_samples};") and got[1].n_bytes == 5 and got[3].n_bytes == 0


def test_media(spark):
    texts = ["abc", "", None, "ä" * 288, "x" * 577, "abc", *[f"text {k} " * 90 for k in range(160)]]
    docs = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in telephony.store_text_audio(docs).collect()}
    media = {r.doc_id: bytes(r.media) for r in telephony.text_media(docs).collect()}
    tags = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r, parsed = got[i], telephony.parse_wav(media[i])
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert r.media_bytes == len(media[i]) and r.media_sha256 == hashlib.sha256(media[i]).hexdigest()
        pcm = telephony.to_pcm([parsed])[0]
        if parsed["tag"] in telephony.TABLES:
            assert pcm.tolist() == telephony.TABLES[parsed["tag"]][list(want)].tolist()
        else:
            blocks = [b"\0" * 4 + want[k : k + 288] for k in range(0, len(want), 288)]
            assert pcm.tolist() == sum(map(scalar_ima, blocks), [])
        back = telephony.from_planes(bytes(r.pcm))  # as it is stored: every sample at 16 kHz
        assert r.rate == 16_000 and len(back) == 2 * len(pcm) == 2 * r.n_samples
        assert back.tolist() == plain_resample(pcm, 8000, 16_000).tolist() and r.feature == telephony.describe(back)
        tags.add(parsed["tag"])
    assert got[0][1:] == got[5][1:] and got[0].feature != got[4].feature
    assert tags == {telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM}


def test_decode_media(spark):
    rng = np.random.default_rng(5)
    adpcm = rng.integers(0, 256, 3 * 36, dtype=np.uint8).tobytes()
    pcm = rng.integers(-9, 9, 50).astype("<i2").tobytes()
    media = [
        telephony.wav(bytes(range(256)), telephony.A_LAW, 16000), telephony.wav(adpcm, telephony.IMA_ADPCM, 16000, 36, 4, 150), telephony.wav(pcm, telephony.PCM, 16000, 2, 16),
        None, b"junk", telephony.wav(b"ab", 99), telephony.wav(adpcm, telephony.IMA_ADPCM, 16000, 36, 4, 195)[:-8],
    ]
    got = {r.doc_id: r for r in telephony.decode_media(spark.createDataFrame(list(enumerate(media)), "doc_id long, media binary")).collect()}
    assert telephony.parse_wav(bytes(got[0].pcm))["data"] == telephony.TABLES[telephony.A_LAW].astype("<i2").tobytes()
    want = sum((scalar_ima(adpcm[k : k + 36]) for k in (0, 36, 72)), [])[:150]
    assert np.frombuffer(telephony.parse_wav(bytes(got[1].pcm))["data"], "<i2").tolist() == want
    assert telephony.parse_wav(bytes(got[2].pcm))["data"] == pcm
    assert all(got[k].pcm is None and got[k].error for k in (3, 4, 5, 6))


# --- SentencePiece


@pytest.fixture(scope="module")
def coder():
    return PieceModel(tokenizer_path("piece_bpe_32k.model"), capacity=2000)


def test_long_runs_of_spaces(coder):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), random.Random(3)
    texts = ["x" + " " * n + "the end" for n in (30, 31, 1000, 50_000)] + [" " * 77, "\n" + " " * 40 + "\n▁▁ a"]
    texts += ["".join(rng.choice(["a", "the", "\n", "▁", "é", "日", " " * rng.randint(1, 60)]) for _ in range(20)) for _ in range(200)]
    for t in texts:
        assert coder.encode(t)[0].tolist()[:-1] == library.encode(t), t[:50]


def test_pieces_equal_library(coder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(4)
    alphabet = "aabcdeeénñ漢字\n\t\r ▁.,!0123\U0001f600\x00ﬁ  <s>th­é"
    texts = ["", " ", "Hello world", "a" * 300, "line\n line\nline"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 15))) for _ in range(5000)]
    for t in texts:
        want = sp.encode(t, add_eos=True)
        ids, decimals = coder.encode(t)
        assert ids.tolist() == want and decimals == " ".join(map(str, want)), t
        assert coder.decode(ids) == sp.decode(want), t


def test_piece_columns(spark):
    rows = [(0, "Hello  world"), (1, None), (None, ""), (0, "Hello  world")]
    coded = encode_pieces(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids"))
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in decode_pieces(coded).collect())
    assert back == [(False, 0, "Hello  world"), (False, 0, "Hello  world"), (False, 1, ""), (True, 0, "")]
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- Language


def plain_phrases(text, labelled):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in labelled:
            k += 1
        n, at = n + 1, at + k
    return n


def test_cross_parsing_equals_brute_force():
    rng = random.Random(6)
    labelled = tuple((name, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60))) for name, letters in (("xx", "abcde"), ("yy", "cdefg")))
    parser = language.CrossParser(labelled, block=16)
    texts = [language.fold("".join(rng.choice("abcdefg h!Z") for _ in range(rng.randint(0, 70)))) for _ in range(60)]
    texts += [own[a:b].strip() for _, own in labelled for a, b in ((0, len(own)), (3, 150), (40, 41))] + [labelled[0][1] * 2]
    texts += [language.fold("".join(rng.choice("abcdefg h") for _ in range(12_000))), ""]
    for chunk in (1 << 14, 3):
        got = parser.phrases([parser.fold(t) for t in texts], chunk)
        for t, row in zip(texts, got):
            assert row.tolist() == [plain_phrases(t, own) for _, own in labelled], t


def test_cross_parsing_knows_every_letter():
    rng = random.Random(8)
    labelled = tuple((name, " ".join("".join(chr(first + rng.randrange(900)) for _ in range(rng.randint(1, 6))) for _ in range(900))) for name, first in (("xx", 0x4E00), ("yy", 0x5400)))
    parser = language.CrossParser(labelled, block=16)
    texts = [own[k : k + 300].strip() for _, own in labelled for k in range(0, 900, 90)]
    got = parser.phrases([parser.fold(t) for t in texts])
    for t, row in zip(texts, got):
        assert row.tolist() == [plain_phrases(t, own) for _, own in labelled], t
    assert [r[0] for r in parser.judge(texts)] == ["xx"] * 10 + ["yy"] * 10


def test_every_language_is_labelled(spark):
    docs = spark.createDataFrame([(k, "abc def", f"l{k:03}") for k in range(70)], "doc_id long, text string, lang string")
    assert len(language.labelled_text(docs, 10, 1000, None, "doc_id", "text", "lang")) == 70


def test_languages(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog and the bird", "en", "q"), (2, "le chat et le chien et la souris", "fr", "q"), (3, "the bird and the cat", None, None), (4, None, None, None), (5, "12 !!", "en", None), (6, "", None, None), (None, "la souris et le chat", None, None)],
        "doc_id long, text string, lang string, score string",
    )
    labelled = language.labelled_text(docs, 10, 1000, 8, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language.identify_languages(docs, labelled).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {1: "en", 2: "fr", 3: "en", 4: "und", 5: "und", 6: "und", None: "fr"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0
    assert language.identify_languages(docs.limit(0), labelled).collect() == []
    assert {r.lang_pred for r in language.identify_languages(docs, ()).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op6_cross_parsing(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang_pred = lang))").first()[0]
    assert got > 0.97
