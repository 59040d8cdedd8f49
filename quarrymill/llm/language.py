"""Language identification by cross-parsing (operator 6).

Labelled text of each language goes into a suffix automaton, which accepts every substring of it. A text is parsed
greedily into the longest phrases that the automaton accepts; the language that needs the fewest phrases,
each weighted by log2 of the length of its labelled text (the cost of pointing into it), wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, map_arrow, small_batches, table

UNDETERMINED = "und"
#: Symbols: 0 fills up, 1 stands for anything but letters, 2 for letters without a symbol.
FILL, GAP, OTHER, FIRST = 0, 1, 2, 3


def fold(text: str) -> str:
    """Lower-cased letters, with one space for each run of other characters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the minimal automaton of all suffixes of ``text``; state 0 is the start."""
    follow: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        at, last = last, new
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at < 0:
            continue
        to = follow[at][c]
        if length[to] == length[at] + 1:
            link[new] = to
            continue
        twin = len(follow)
        follow.append(dict(follow[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        link[to] = link[new] = twin
        while at >= 0 and follow[at].get(c) == to:
            follow[at][c] = twin
            at = link[at]
    return follow


class CrossParser:
    """Parses texts with one automaton per language; labelled: language -> folded text. Every letter of the labelled
    texts has a symbol. Transitions lie in one sparse row per language, so that wide alphabets take no more room."""

    def __init__(self, labelled: tuple[tuple[str, str], ...], block: int = 128):
        self.names = [name for name, text in labelled if text]
        texts = [text for _, text in labelled if text]
        self.weights = np.array([np.log2(len(t) + 1) for t in texts])
        self.block = block
        counts: dict[str, int] = {}
        for t in texts:
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        counts.pop(" ", None)
        known = sorted(counts, key=lambda c: (-counts[c], c))
        self.width = FIRST + len(known)
        self.symbol = np.where(_letters(), OTHER, GAP).astype(np.int32)
        for k, c in enumerate(known):
            self.symbol[ord(c)] = FIRST + k
        number = {c: FIRST + k for k, c in enumerate(known)} | {" ": GAP}
        self.tables = [self._table(suffix_automaton(t), number) for t in texts]

    def _table(self, follow: list[dict[str, int]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner, target, start. A state is its base; its transition by symbol c stands at base + c, where ``owner`` is that
        base. Base 0 owns nothing: it's the start, and states without transitions. Without a transition
        a phrase begins, and ``start`` has the next state by symbol, times two, plus one (but for FILL)."""
        w = self.width
        base, bases, used = [0] * len(follow), {0}, set()
        free = end = w + 1
        for s in sorted(range(1, len(follow)), key=lambda s: -len(follow[s])):
            own = sorted(number[c] for c in follow[s])
            if not own:
                break
            while free in used:
                free += 1
            for at in range(free - own[0], free - own[0] + 50):
                if at not in bases and not any(at + c in used for c in own):
                    break
            else:
                at = end - own[0]
                while at in bases:
                    at += 1
                free += 50
            base[s] = at
            bases.add(at)
            used.update(at + c for c in own)
            end = max(end, at + own[-1] + 1)
        owner, target = np.full(max(bases) + w, -1, np.int32), np.zeros(max(bases) + w, np.int32)
        start = np.ones(w, np.int32)
        start[FILL] = 0
        for c, to in follow[0].items():
            start[number[c]] = base[to] * 2 + 1
        for s, moves in enumerate(follow[1:], 1):
            for c, to in moves.items():
                owner[base[s] + number[c]], target[base[s] + number[c]] = base[s], base[to] * 2
        return owner, target, start

    def fold(self, text: str) -> np.ndarray:
        """Symbols of the folded text."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        s = s[keep]
        return s[int(len(s) > 0 and s[0] == GAP) : len(s) - int(len(s) > 1 and s[-1] == GAP)]

    def phrases(self, texts: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
        """Phrases (texts x languages).

        Texts are parsed in blocks side by side, each as if a phrase began with it. Then the blocks for which the block before
        ends within a phrase are parsed again from there, until they come to a state that they had at this letter before, as
        all that follows is then the same; and so on while ends of blocks change. ``chunk`` blocks are at work at a time.
        """
        blocks = np.array([-(-len(t) // self.block) for t in texts], np.int64)
        total = int(blocks.sum())
        flat = np.zeros(total * self.block, np.int32)
        at = np.r_[0, np.cumsum(blocks)] * self.block
        for t, a in zip(texts, at.tolist()):
            flat[a : a + len(t)] = t
        lanes = flat.reshape(total, self.block)
        owner_text = np.repeat(np.arange(len(texts)), blocks)
        follows = np.r_[False, owner_text[1:] == owner_text[:-1]][:total]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, table in enumerate(self.tables):
            last = 0
            for first in range(0, total, chunk):
                part = slice(first, first + chunk)
                count, last = self._parse(np.ascontiguousarray(lanes[part].T), follows[part], last, *table)
                out[:, k] += np.bincount(owner_text[part], count, len(texts)).astype(np.int64)
        return out

    @staticmethod
    def _parse(lanes: np.ndarray, follows: np.ndarray, before: int, owner: np.ndarray, target: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, int]:
        """Phrases that begin in each lane, and the state after the last. ``before``: the state before the first."""
        steps, count = lanes.shape
        got = np.empty((steps, count), np.int32)
        state = np.zeros(count, np.int32)
        for r, row in enumerate(lanes):
            place = state + row
            got[r] = np.where(owner.take(place) == state, target.take(place), start.take(row))
            state = got[r] >> 1
        ends, used = state, np.zeros(count, np.int32)
        todo = np.flatnonzero(follows)
        while len(todo):
            came = np.where(todo > 0, ends[todo - 1], before)
            new = came != used[todo]
            own, state = todo[new], came[new]
            used[own] = state
            for r in range(steps):
                row = lanes[r, own]
                place = state + row
                now = np.where(owner.take(place) == state, target.take(place), start.take(row))
                apart = now >> 1 != got[r, own] >> 1
                got[r, own] = now
                own, state = own[apart], now[apart] >> 1
                if not len(own):
                    break
            ends[own] = state
            todo = own + 1
            todo = todo[todo < count]
            todo = todo[follows[todo]]
        return (got & 1).sum(0), int(ends[-1])

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, normalised phrases a letter) of each text. The score is how much cheaper the best
        language is than the next, as a share; without letters, or without labelled text, it's ``und`` and 0."""
        symbols = [self.fold(t or "") for t in texts]
        sizes = np.array([int((s >= OTHER).sum()) for s in symbols])
        cost = self.phrases(symbols) * self.weights if self.names else np.zeros((len(texts), 0))
        out = []
        for n, own in zip(sizes.tolist(), cost):
            if not n or not len(own):
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            order = np.argsort(own, kind="stable")  # ties go to the first name
            best = own[order[0]]
            score = 1.0 - float(best / own[order[1]]) if len(own) > 1 else 1.0
            out.append((self.names[order[0]], score, float(best) / n))
        return out


@lru_cache(maxsize=1)
def parser(labelled: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(labelled)


def _chosen(own: DataFrame, docs_per_language: int) -> DataFrame:
    """The rows (doc_id, lang, text) of the first documents of each language in hash order of their ids, each once."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = own.select("doc_id", "lang", rank.alias("rank")).where(F.col("rank") <= docs_per_language).select("lang", "doc_id").distinct()
    return own.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


#: Languages to learn at most, the most frequent ones; characters to read of a text to learn from; characters from which on a text's cost is certain.
MOST_LANGUAGES, MOST_CHARS, CERTAIN = 64, 200_000, 200


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang and text; of texts to learn from the first MOST_CHARS characters are enough."""
    text = F.substring(F.col(text_col).cast("string"), 1, MOST_CHARS)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    return own.where("lang is not null and doc_id is not null")


def labelled_text(docs: DataFrame, docs_per_language: int, chars_per_language: int, max_languages: int | None, id_col: str, text_col: str, lang_col: str, train=None) -> tuple[tuple[str, str], ...]:
    """Folded text of each language, by name: of its documents, in hash order of their ids, whole ones up to
    ``chars_per_language`` letters and spaces, of which the last may be cut. Only the ``max_languages`` with the most
    documents, unless that is None. The driver sees at most ``docs_per_language`` texts of each language."""
    own = _labelled(docs, id_col, text_col, lang_col)
    own = own.where(train) if train is not None else own
    if max_languages is not None:
        own = own.where(F.col("lang").isin([r[0] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]))
    texts: dict[str, str] = {}
    for r in sorted(_chosen(own, docs_per_language).collect(), key=lambda r: (r.lang, _mix(r.doc_id))):
        if len(texts.get(r.lang, "")) < chars_per_language and r.text:
            texts[r.lang] = (texts.get(r.lang, "") + " " + fold(r.text))[:chars_per_language].strip()
    return tuple(sorted(texts.items()))


#: Letters of scripts that set no spaces between words: each is a token. Other tokens are words, of which long ones are cut.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN, _NO_LETTERS = re.compile(f" ?[{_ALONE}]| ?[^ {_ALONE}]{{1,40}}"), re.compile(r"[\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    """Words and letters of a whole text, each with the space before it, if there is one."""
    return _TOKEN.findall(" " + _NO_LETTERS.sub(" ", (text or "").lower()).strip())


def _count_tokens(batches: Iterator[pa.RecordBatch], limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """(lang, token, count) of a task's texts, given out whenever ``limit`` have gathered."""
    seen: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        arrays = [pa.array([lang for lang, own in seen.items() for _ in own], pa.string()), pa.array([t for own in seen.values() for t in own], pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([c for own in seen.values() for c in own.values()], pa.int64())], ["lang", "token", "c"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen.setdefault(lang, Counter()).update(tokens_of(text.as_py()))
            if sum(map(len, seen.values())) >= limit:
                yield out()
                seen.clear()
    if any(seen.values()):
        yield out()


def _count_pairs(batches: Iterator[pa.RecordBatch], shared, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """(lang, first, second, count) of neighbouring tokens of a task's texts, both among the shared ones, as their numbers; a last one stands before
    number -1, so that texts of one word count too. Given out whenever ``limit`` have gathered."""
    places, found, size = shared.value, {}, 0

    def out() -> pa.RecordBatch:
        rows = [(lang, *np.unique(np.concatenate(own), return_counts=True)) for lang, own in found.items()]
        codes = np.concatenate([r[1] for r in rows])
        langs = pa.array([lang for lang, own, _ in rows for _ in range(len(own))], pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array((codes >> 32)), pa.array((codes & (1 << 32) - 1) - 1), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int64))], ["lang", "first", "second", "c"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            get = places[lang].get if lang in places else {}.get
            at = np.array([*[get(t, -1) for t in tokens_of(text.as_py())], -2], np.int64)
            first, second = at[:-1], np.maximum(at[1:], -1)
            codes = (first << 32 | second + 1)[(first >= 0) & (at[1:] != -1)]
            if len(codes):
                found.setdefault(lang, []).append(codes)
                size += len(codes)
            if size >= limit:
                yield out()
                found, size = {}, 0
    if size:
        yield out()


def _highest(counts: DataFrame, by: list[str], most: int, parts: int = 64) -> DataFrame:
    """The ``most`` rows of each language with the highest sums of ``c``, equal ones by hash, and their rank from 1: first of each of some parts by hash of ``by``."""
    key = F.xxhash64(*by)
    dealt = counts.withColumn("key", key).withColumn("part", F.pmod(key, F.lit(parts))).groupBy("lang", "part", "key", *by).agg(F.sum("c").alias("c"))
    for own in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*own).orderBy(F.desc("c"), "key", *by)
        dealt = dealt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return dealt.select("lang", "rank", *by)


def chained(pairs: list[tuple[str, str]], letters: int) -> str:
    """A folded text of at most ``letters`` that holds the pairs of tokens, the most frequent first: those for which there is surely room
    follow each other wherever one ends as another begins."""
    room, after = 0, {}
    for k, (first, second) in enumerate(pairs):
        room += len(second) or len(first)
        if room > 0.8 * letters:
            break
        after.setdefault(first, []).append(k)
    after = {first: own[::-1] for first, own in after.items()}
    out, size, used = [], 0, set()
    for k, (first, second) in enumerate(pairs):
        if k in used:
            continue
        out.append(first)
        size += len(first)
        while k is not None and size < letters:
            used.add(k)
            out.append(pairs[k][1])
            size += len(out[-1])
            own = after.get(out[-1], [])
            while own and own[-1] in used:
                own.pop()
            k = own[-1] if own else None
        if size >= letters:
            break
    return fold("".join(out))[:letters].strip()


def learnt_text(docs: DataFrame, chars_per_language: int, max_languages: int | None, text_col: str, lang_col: str, train: Column | None = None) -> tuple[tuple[str, str], ...]:
    """Text for each language's automaton, by name, learnt from all its documents: tokens of every whole text are counted, then neighbouring ones of
    the most frequent (one for each six letters of the text to make), and the most frequent pairs make a text of ``chars_per_language`` letters and spaces; see
    chained(). Only the ``max_languages`` with the most documents, unless that is None. The driver sees one pair for each three letters at most.

    Null and empty texts teach nothing, rows without a language neither; repeated rows count each."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs if train is None else docs.where(train)
    own = own.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    if max_languages is not None:
        own = own.where(F.col("lang").isin([r[0] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]))
    tokens: dict[str, list[str]] = {}
    for r in sorted(_highest(map_arrow(own, _count_tokens, "lang string, token string, c long"), ["token"], -(-chars_per_language // 6)).toArrow().to_pylist(), key=lambda r: (r["lang"], r["rank"])):
        tokens.setdefault(r["lang"], []).append(r["token"])
    shared = spark.sparkContext.broadcast({lang: {t: k for k, t in enumerate(known)} for lang, known in tokens.items()})
    counts = map_arrow(own, _count_pairs, "lang string, first long, second long, c long", shared=shared)
    pairs: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(_highest(counts, ["first", "second"], -(-chars_per_language // 3)).toArrow().to_pylist(), key=lambda r: (r["lang"], r["rank"])):
        known = tokens[r["lang"]]
        pairs.setdefault(r["lang"], []).append((known[r["first"]], known[r["second"]] if r["second"] >= 0 else ""))
    shared.unpersist()
    texts = {lang: chained(own, chars_per_language) for lang, own in pairs.items()}
    return tuple(sorted((lang, text) for lang, text in texts.items() if text))


def cost_limits(docs: DataFrame, labelled: tuple[tuple[str, str], ...], text_col: str, lang_col: str, held: Column) -> dict[str, tuple[float, float]]:
    """For each language what 90 % of all its documents for which ``held`` holds need at most, of those with CERTAIN characters or more (to a thousandth), and
    what letters cost that are phrases of their own. Languages without such documents have none."""
    most = {name: float(np.log2(len(text) + 1)) for name, text in labelled}
    own = docs.where(held).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    own = own.where(F.col("lang").isin(list(most)) & (F.length("text") >= CERTAIN))
    judged = identify_languages(own, labelled, ["lang"]).where("lang_pred = lang")
    costs = judged.groupBy("lang", F.round("phrase_cost", 3).alias("cost")).agg(F.count("*").alias("n"))
    rows = costs.groupBy("lang").agg(F.percentile("cost", 0.9, F.col("n")).alias("cost")).collect()
    return {r.lang: (r.cost, most[r.lang]) for r in rows}


def within_limit(limits: dict[str, tuple[float, float]], lang: Column, cost: Column, length: Column) -> Column:
    """Is a text's cost below its language's limit? That is halfway from the first of cost_limits() to the second for a text of CERTAIN characters or
    more, and goes on towards the second with the root of how many times shorter a text is. No language is without a limit but those
    without held-out documents."""
    wide = F.least(F.lit(1.0), 0.5 * F.sqrt(F.lit(float(CERTAIN)) / F.greatest(F.least(length, F.lit(CERTAIN)), F.lit(1))))
    cases = F.lit(None).cast("double")
    for name, (own, most) in sorted(limits.items()):
        cases = F.when(lang == name, F.lit(own) + F.lit(most - own) * wide).otherwise(cases)
    return F.coalesce(cost < cases, F.lit(True))


def _mix(x: int) -> int:
    return (x * 0x9E3779B97F4A7C15) & (1 << 64) - 1


def _judge(batches: Iterator[pa.RecordBatch], labelled: tuple[tuple[str, str], ...], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    names = ["lang_pred", "score", "phrase_cost"]
    for batch in batches:
        judge, rows, part, size = parser(labelled).judge, [], [], 0
        for text in batch.column(0):  # some millions of characters at a time bound the memory
            part.append(text.as_py())
            size += len(part[-1] or "")
            if size >= chars:
                rows, part, size = rows + judge(part), [], 0
        rows += judge(part)
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *names])


def identify_languages(
    docs: DataFrame,
    labelled: tuple[tuple[str, str], ...],
    keep: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """The columns of ``keep`` (all of ``docs`` by default) with lang_pred, score and phrase_cost for every whole text.

    Columns of these names that ``docs`` has are replaced. A null text, an empty one and one without letters are ``und``
    with score 0. Repeated rows are all judged. Ties go to the first language by name. Texts of any length are parsed whole.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    new = {"lang_pred", "score", "phrase_cost"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double").add("phrase_cost", "double")
    return map_arrow(own, _judge, schema, labelled=labelled)


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labelled = labelled_text(docs, 64, 24_000, MOST_LANGUAGES, "doc_id", "text", "lang", ~held_out)
    rows = documents(docs).withColumn("held_out", held_out)
    return identify_languages(rows, labelled, ["doc_id", "held_out"])


QUERIES = {"op6_cross_parsing": op6_cross_parsing}
SQL: dict[str, str] = {}
