"""Phrase collocation mining by stripes (operator 12).

Each prefix of one or two words keys a stripe: a counter of the words that follow it, with an end for words that end their piece. A task
counts its texts' stripes with numpy and ships each once; stripes of a prefix are merged element by element. The merged stripes
give all that is asked for: entries are the counts of phrases, totals of one-word stripes those of words, and the largest entries on either
side tell which phrases of two words a longer one subsumes.

Stripes of two words are counted where both pairs of a window are frequent: a Bloom filter of a fixed size tells the tasks, and what it lets through by
mistake is too rare to be a candidate. Stripes of very frequent words are dealt out in slices by the next word, so that no prefix is a task of its
own. Which words those are is guessed from one document in a hundred; results don't depend on it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, small_batches, stored, table

#: Characters that end a piece, and A-Z in lower case.
_BREAKS, _UPPER = b".,;:!?\n\v\f\r", bytes(range(ord("A"), ord("Z") + 1))
_TABLE = bytes.maketrans(_BREAKS + b"\t" + _UPPER, b"\n" * len(_BREAKS) + b" " + _UPPER.lower())

#: Slices of a frequent word's stripes; a word is frequent that makes up this share of its language's words.
SLICES, HOT_SHARE = 64, 1 / 20_000
#: Bits of a word's number within a task's counter: three numbers share 63.
_BITS = 21
#: Bits of the filter of frequent pairs (8 MB), at most 2,048 parts of 4 KB.
FILTER_BITS = 1 << 26

STRIPES = "lang string, w1 string, w2 string, slice int, next array<string>, counts array<long>"


def word_hash(lang: str, word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode() + b"\n" + word, digest_size=8).digest(), "little")


def pair_places(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """The two bits of the filter that stand for pairs of word hashes (uint64)."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return [((h * np.uint64(k)) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64) for k in (0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class StripeCounter:
    """Counts stripes of texts in bounded memory: after ``tokens`` words, or where the numbers of distinct words run out, they are given out.
    ``width``: words of a prefix; ``pairs``: the filter (bits) of frequent pairs for prefixes of two; ``hot``: (lang, word) with slices."""

    def __init__(self, width: int, tokens: int, hot: frozenset = frozenset(), pairs: np.ndarray | None = None, part: int = 4_000_000):
        self.width, self.tokens, self.hot, self.pairs, self.part = width, tokens, hot, pairs, part
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}  # of words, by language; 0 is the end of a piece
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.ids: list[np.ndarray] = []
        self.size = 0

    def _number(self, lang: str, words: list[bytes]) -> np.ndarray:
        own = self.numbers.setdefault(lang, {b"\n": 0})
        for w in set(words).difference(own):
            own[w] = len(self.words)
            self.words.append(w)
            self.langs.append(lang)
        return np.fromiter(map(own.__getitem__, words), np.int64, len(words))

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        """Takes a text; gives out what has been counted when there is enough of it. A long text is taken in parts; the last
        words of a part that is given out go on to the next, so that no count is lost or doubled."""
        raw = text.encode().translate(_TABLE)
        at = 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= self.part else raw.find(b" ", at + self.part)
            end = len(raw) if end < 0 else end
            words = [w for w in raw[at:end].replace(b"\n", b" \n ").split(b" ") if w]
            self.ids.append(self._number(lang, words))
            self.size += len(words)
            at = end
            if self.size >= self.tokens or len(self.words) >= 1 << (_BITS - 1):
                yield from self.flush(lang if at < len(raw) else None)
        self.ids.append(np.zeros(1, np.int64))

    def flush(self, goes_on: str | None = None) -> Iterator[pa.RecordBatch]:
        """Stripes of all that has been counted; ``goes_on`` is the language of a text of which more is to come."""
        x = np.concatenate([np.zeros(0, np.int64), *self.ids])
        held = [self.words[i] if i else b"\n" for i in x[max(len(x) - self.width, 0) :]] if goes_on is not None else []
        starts = len(x) - len(held)
        x = np.concatenate([x, np.zeros(2, np.int64)])
        first, second, third = (x[k : starts + k] for k in range(3))
        if self.width == 1:
            keys = ((first << _BITS) | second)[first > 0]
        else:
            own = (first > 0) & (second > 0) & (third > 0)
            first, second, third = first[own], second[own], third[own]
            if self.pairs is not None:
                h = np.array([word_hash(c, w) for c, w in zip(self.langs, self.words)], np.uint64)
                own = np.ones(len(first), bool)
                for a, b in ((first, second), (second, third)):
                    for place in pair_places(h[a], h[b]):
                        own &= self.pairs[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                first, second, third = first[own], second[own], third[own]
            keys = (first << 2 * _BITS) | (second << _BITS) | third
        if len(keys):
            yield from self._stripes(*np.unique(keys, return_counts=True))
        self._clear()
        if held:
            self.ids.append(self._number(goes_on, held))
            self.size = len(held)

    def _stripes(self, keys: np.ndarray, counts: np.ndarray, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
        mask = (1 << _BITS) - 1
        words, langs = np.array(self.words, object), np.array(self.langs, object)
        hot = np.fromiter((x in self.hot for x in zip(self.langs, self.words)), bool, len(words))
        last, prefix = keys & mask, keys >> _BITS
        w1 = prefix if self.width == 1 else prefix >> _BITS
        part = np.zeros(len(keys), np.int64)
        sliced = hot[w1] & (last > 0)
        part[sliced] = [zlib.crc32(w) % SLICES for w in words[last[sliced]]]
        order = np.lexsort((part, prefix))
        counts, last, part, prefix, w1 = counts[order], last[order], part[order], prefix[order], w1[order]
        first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]))
        bounds = np.append(first, len(prefix))
        as_text = lambda k: pa.array(np.where(k > 0, words[k], None), pa.binary()).cast(pa.string())
        for k in range(0, len(first), rows):
            own = bounds[k : k + rows + 1]
            at, lo, hi = own[:-1], own[0], own[-1]
            offsets = pa.array(own - lo, pa.int32())
            cols = [
                pa.array(langs[w1[at]], pa.string()), as_text(w1[at]), as_text(prefix[at] & mask if self.width == 2 else np.zeros(len(at), np.int64)), pa.array(part[at], pa.int32()),
                pa.ListArray.from_arrays(offsets, as_text(last[lo:hi])), pa.ListArray.from_arrays(offsets, pa.array(counts[lo:hi], pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in STRIPES.split(", ")])


def _count_stripes(batches: Iterator[pa.RecordBatch], width: int, tokens: int, hot: frozenset, pairs) -> Iterator[pa.RecordBatch]:
    counter = StripeCounter(width, tokens, hot, None if pairs is None else np.frombuffer(pairs.value, np.uint8))
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from counter.add(lang, text.as_py())
    yield from counter.flush()


def merged_stripes(texts: DataFrame, width: int, least: int, tokens: int, hot: frozenset, pairs=None) -> DataFrame:
    """Merged slices of stripes of texts (lang, text): lang, w1, w2 (null for prefixes of one word), slice, total (of all entries), and next: (word, count)
    of the words that follow ``least`` times or more. Stored."""
    key = ["lang", "w1", "w2", "slice"]
    shipped = map_arrow(texts, _count_stripes, STRIPES, width=width, tokens=tokens, hot=hot, pairs=pairs).repartition(*key)
    each = shipped.select(*key, F.explode(F.arrays_zip("next", "counts")).alias("x"))
    entries = each.groupBy(*key, F.col("x.next").alias("word")).agg(F.sum("x.counts").alias("count"))  # within the partition: it is dealt by less
    often = F.collect_list(F.when((F.col("count") >= least) & F.col("word").isNotNull(), F.struct("word", "count")))
    merged = entries.groupBy(*key).agg(F.sum("count").alias("total"), often.alias("next"))
    return stored(merged if width == 1 else merged.where("size(next) > 0"), f"stripes-{width}")


def hot_words(texts: DataFrame, share: float = HOT_SHARE) -> frozenset:
    """(lang, word) of the words that make up ``share`` of their language's words in one document of a hundred: at most 1 / share of them each
    of the 50 languages with the most words. Only for how stripes are dealt out."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(100)) == 0)
    lower = F.translate("text", _UPPER.decode(), _UPPER.decode().lower())
    words = some.select("lang", F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D\x20\x09]+")).alias("word")).where("word != ''").groupBy("lang", "word").count()
    words = stored(words, "some-words")
    langs = words.groupBy("lang").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "lang").limit(50)
    rows = words.join(F.broadcast(langs), "lang").where(F.col("count") >= F.greatest(F.lit(2.0), share * F.col("n"))).select("lang", "word").limit(int(2 / share)).collect()
    return frozenset((r.lang, r.word.encode()) for r in rows)


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a filter with the pairs' bits."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        langs, w1, w2 = (batch.column(k).to_pylist() for k in range(3))
        first = np.array([word_hash(c, w.encode()) for c, w in zip(langs, w1)], np.uint64)
        second = np.array([word_hash(c, w.encode()) for c, w in zip(langs, w2)], np.uint64)
        for place in pair_places(first, second):
            np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
    parts = bits.reshape(-1, 4096)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["part", "bits"])


def pair_filter(two: DataFrame) -> bytes:
    """The filter of the pairs (lang, w1, w2): FILTER_BITS bits, whatever their number."""
    parts = map_arrow(two.select("lang", "w1", "w2"), _filter_parts, "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in parts.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(out)


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (left right)) in decimals of 38 digits: exact for counts below 10^15."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"cast(cast({wide(a)} * {wide(a)} as decimal(31,0)) * cast(1000000 as decimal(7,0)) div ({wide(left)} * {wide(right)}) as long)")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, share: int = 50, top: int = 2000, tokens: int = 3_000_000) -> DataFrame:
    """The first ``top`` collocations of two or three words of each language: lang, rank, phrase, a, l, r, n and score.

    A phrase is a candidate with ``least`` occurrences within pieces; its score is that of its worst cut; it is dropped if a longer candidate holds it
    that has ``share`` per cent of its occurrences. A null lang counts as ``und``; null and empty texts hold nothing; texts of any length
    are taken in parts (a task counts ``tokens`` words at a time); repeated rows count as often as they occur; ties go by count and phrase; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text != ''")
    hot = hot_words(texts)
    singles = merged_stripes(texts, 1, least, tokens, hot)
    one = stored(singles.groupBy("lang", "w1").agg(F.sum("total").alias("f")), "words")
    total = one.groupBy("lang").agg(F.sum("f").alias("n"))
    often_one = one.where(F.col("f") >= least)
    often_two = stored(singles.where("size(next) > 0").select("lang", "w1", F.explode("next").alias("x")).select("lang", "w1", F.col("x.word").alias("w2"), F.col("x.count").alias("f")), "pairs")
    pairs = spark.sparkContext.broadcast(pair_filter(often_two))
    doubles = merged_stripes(texts, 2, least, tokens, hot, pairs)
    three = stored(doubles.select("lang", "w1", "w2", F.explode("next").alias("x")).select("lang", "w1", "w2", F.col("x.word").alias("w3"), F.col("x.count").alias("a")), "triples")
    word = lambda name, out: often_one.select("lang", F.col("w1").alias(name), F.col("f").alias(out))
    pair = lambda x, y, out: often_two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("f").alias(out))
    # the largest longer phrase on either side
    after = three.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    before = three.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("longer"))
    longer = after.unionByName(before).groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    pairs = often_two.withColumnRenamed("f", "a").join(longer, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    pairs = pairs.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r").withColumn("score", score_of("a", "l", "r"))
    cuts = three.join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
    cuts = cuts.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
    cuts = cuts.withColumns({"s1": score_of("a", "l1", "r1"), "s2": score_of("a", "l2", "r2")})
    worst = F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), F.col("s1").alias("score"))).otherwise(F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"), F.col("s2").alias("score")))
    triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", worst.alias("worst")).select("lang", "phrase", "a", "worst.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # the first of each of 64 parts, then of those: a language that holds most phrases is no task of its own
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}

_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_no, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS doc_no FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, 1 AS k, w[i] AS g FROM runs
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM runs WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM runs WHERE i + 2 <= len(w)),
f AS (SELECT lang, k, g, count(*) AS c FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, g, c AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
longer AS (
  SELECT lang, g, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer USING (lang, g) WHERE m IS NULL OR 100 * m < 50 * a),
cuts AS (
  SELECT lang, g, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
  UNION ALL SELECT lang, g, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3),
scored AS (
  SELECT u.lang, u.g, a, cut, p.c AS l, q.c AS r, ((1000000::HUGEINT * a * a) // (p.c::HUGEINT * q.c))::BIGINT AS score
  FROM cuts u JOIN f p ON p.lang = u.lang AND p.g = u.x JOIN f q ON q.lang = u.lang AND q.g = u.y),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM worst WHERE place = 1)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

SQL = {"op12_collocations": _SQL}
