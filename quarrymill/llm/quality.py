"""Quality rules by cross-document line frequency (operator 1), in DataFrame operations only.

Lines are normalised and hashed. For each host the distinct documents that hold a line are counted (exact copies
count once); lines above the limit are removed from all texts, and documents of which too little is left are rejected. Near copies
share most of their lines and would all be depleted: of the depleted documents of a host that lose the same line first, one (the first by hash
of its text, then by id) is spared and stays whole; exact copies of it are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import stored, table

BLANK = r"[\x20\x09-\x0D]"
#: The most removed lines that are broadcast, as two hashes each by host; with more, each document's own are joined to
#: it by shuffle.
BROADCAST_LINES = 10_000
#: Windows are told apart by the upper bits of a hash; the lower ones hold the position.
_BITS = 20


def _let(value: Column, body) -> Column:
    """body(x) with x bound to ``value``, which is then computed once for all of the body's lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def _windows(words: Column, key) -> Column:
    """A key for each window of three words, in order of position."""
    last = F.size(words) - 3
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: key(i))).otherwise(F.array())


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of three words that occur twice or more, the first occurrence included.

    Keys of windows are sorted, and equal ones no more than two places apart compared word by word: windows that share a
    key, but no words, would have to be three to hide one. Texts with more words than the position bits can hold are
    sorted by hash and position apart.
    """

    def same(p: Column, q: Column) -> Column:
        parts = [F.get(words, p + k) == F.get(words, q + k) for k in range(3)]
        return F.coalesce(parts[0] & parts[1] & parts[2], F.lit(False))

    def marked(keys: Column, high, place) -> Column:
        def near(x: Column, y: Column) -> Column:
            return F.coalesce(high(x) == high(y), F.lit(False)) & same(place(x), place(y))

        found = F.filter(keys, lambda x, k: near(x, F.get(keys, k - 1)) | near(x, F.get(keys, k + 1)) | near(x, F.get(keys, k - 2)) | near(x, F.get(keys, k + 2)))
        return F.sort_array(F.transform(found, place))

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(F.shiftright(h, _BITS), _BITS).bitwiseOR(i.cast("long"))

    def apart(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.cast("long").alias("i"))

    short = _let(F.sort_array(_windows(words, packed)), lambda keys: marked(keys, lambda x: F.shiftright(x, _BITS), lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))))
    long = _let(F.sort_array(_windows(words, apart)), lambda keys: marked(keys, lambda x: x["h"], lambda x: x["i"]))
    places = F.when(F.size(words) < 1 << _BITS, short).otherwise(long)
    steps = _let(places, lambda r: F.transform(r, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(r, k + 1) - p, F.lit(3).cast("long")))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __base_failed."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # words are bound within one expression: a filter that is pushed down must not split the text for every window
    counts = _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    own = docs.withColumn("__counts", counts).withColumns(
        {
            "__n_words": F.col("__counts.n"),
            "__word_chars": (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long"),
            "__n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "__n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "__n_repeat_words": F.col("__counts.repeated"),
        }
    )
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    return own.withColumn("__base_failed", failed).drop("__counts")


def document_key(host_col: str, text_col: str) -> list[Column]:
    """Host (empty for null), and hash (the upper 60 bits of MD5) and length of the text: equal for exact copies on one host."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    return [host.alias("__host"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("__text_hash"), F.length(text).alias("__text_length")]


KEY = ["__host", "__text_hash", "__text_length"]


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANK + "+", " "))


def document_lines(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """A row for each line with a word: its document's key and the hash of the normalised line."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(*document_key(host_col, text_col), F.explode(F.split(text, "\n")).alias("line"))
    rows = rows.select(*KEY, normal_line(F.col("line")).alias("line")).where("line != ''")
    return rows.select(*KEY, F.xxhash64("line").alias("__line"))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", floor: float = 3.0, slope: float = 0.5) -> DataFrame:
    """__host and __line of the lines above the limit: lines that more than ``floor`` + ``slope`` * sqrt(n) distinct documents hold of a
    host with n of them. Stored."""
    held = document_lines(docs, host_col, text_col).distinct()  # exact copies on one host count once
    often = held.groupBy("__host", "__line").agg(F.count("*").alias("documents")).where(F.col("documents") > floor)
    hosts = docs.select(*document_key(host_col, text_col)).distinct().groupBy("__host").agg(F.count("*").alias("host_documents"))
    limit = F.lit(floor) + F.lit(slope) * F.sqrt(F.col("host_documents").cast("double"))
    return stored(often.join(hosts, "__host").where(F.col("documents") > limit).select("__host", "__line"), "frequent-lines")


def with_clean_text(docs: DataFrame, removed: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """``docs`` with KEY and __clean: a struct of the text without its removed lines, the words that are left of it, and the
    line that goes first (normalised); null where the text holds none.

    The other lines, blank ones included, stay as they are and in order.
    """
    keyed = docs.select("*", *document_key(host_col, text_col))
    if removed.count() <= BROADCAST_LINES:
        chosen = F.broadcast(removed.groupBy("__host").agg(F.collect_list("__line").alias("__removed")))
        rows = keyed.join(chosen, "__host", "left")
    else:
        places = document_lines(docs, host_col, text_col).join(removed, ["__host", "__line"])
        rows = keyed.join(places.groupBy(*KEY).agg(F.collect_set("__line").alias("__removed")), KEY, "left")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def clean(z: Column) -> Column:
        # blank lines have no hash, as document_lines leaves them out
        hashes = F.transform(z["lines"], lambda x: _let(normal_line(x), lambda n: F.when(n != "", F.xxhash64(n))))
        rest = lambda h, hit: F.concat_ws("\n", F.filter(z["lines"], lambda x, i: ~F.coalesce(F.array_contains(hit, F.get(h, i)), F.lit(False))))
        first = lambda h, hit: normal_line(F.get(z["lines"], F.array_position(h, F.get(hit, F.lit(0))).cast("int") - 1))
        sized = lambda f: lambda t: F.struct(t.alias("text"), F.size(words_of(t)).cast("long").alias("words"), f.alias("first"))
        return _let(hashes, lambda h: _let(F.array_intersect(h, z["mine"]), lambda hit: F.when(F.size(hit) > 0, _let(rest(h, hit), sized(first(h, hit))))))

    own = _let(F.struct(F.split(text, "\n").alias("lines"), F.col("__removed").alias("mine")), clean)
    return rows.withColumn("__clean", F.when(F.col("__removed").isNotNull(), own)).drop("__removed")


def _row_id(docs: DataFrame, id_col: str) -> Column:
    return (F.col(f"`{id_col}`") if id_col in docs.columns else F.lit(None)).cast("string").alias("__id")


def spared_documents(docs: DataFrame, removed: DataFrame, host_col: str, text_col: str, id_col: str, keep_share: float) -> DataFrame:
    """KEY and __id of the depleted documents that stay whole: one of those of a host that lose the same line first. Stored."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = with_clean_text(docs, removed, host_col, text_col)
    least = _let(words_of(text), lambda w: F.size(w) * F.lit(keep_share))
    # by an exploded array, as in keep_good(); the base rules, which cost most, are asked of depleted documents alone
    worse = lambda c: F.when(c["words"] < least, good_base(text)).otherwise(F.lit(False))
    depleted = own.select(*KEY, _row_id(docs, id_col), F.explode(F.filter(F.array("__clean"), worse)).alias("c"))
    first = depleted.groupBy("__host", F.col("c.first").alias("line")).agg(F.min(F.struct("__text_hash", "__text_length", "__id")).alias("d"))
    return stored(first.select("__host", "d.*").distinct(), "spared-documents")


def good_base(text: Column) -> Column:
    return _let(words_of(text), lambda w: (F.size(w) >= 50) & (100 * repeated_words(w) <= 50 * F.size(w)))


def _with_spared(own: DataFrame, spared: DataFrame, id_col: str) -> DataFrame:
    """``own`` (with KEY) where __clean is null for the spared documents."""
    count = spared.count()
    if count == 0:
        return own
    names = {c: f"{c}_spared" for c in (*KEY, "__id")}
    mine = spared.select(*[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("__spared"))
    mine = F.broadcast(mine) if count <= BROADCAST_LINES else mine
    met = own.withColumn("__id", _row_id(own, id_col))
    on = [met[c] == mine[n] for c, n in names.items() if c != "__id"] + [met["__id"].eqNullSafe(mine[names["__id"]])]
    met = met.join(mine, on, "left")
    return met.withColumn("__clean", F.when(F.col("__spared").isNull(), F.col("__clean"))).drop("__spared", "__id", *names.values())


def judge_quality(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep_share: float = 0.4, id_col: str = "doc_id", **limits) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_share, kept and
    clean_text (the text without its removed lines). A document is depleted, and not kept, if less than ``keep_share`` of its
    words is left, unless it is spared; ``limits``: see frequent_lines().

    Columns of these names in ``docs`` are replaced; those whose names start with two underscores must not be this module's. A null text counts as empty
    (no words: base_failed); a null host counts as the empty one; repeated rows get the same verdict; of ties of the hash the smaller id is spared; lines of
    any length are told by hashes alone; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    removed = frequent_lines(docs, host_col, text_col, **limits)
    spared = spared_documents(docs, removed, host_col, text_col, id_col, keep_share)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in {*names, "removed_share", "kept", "clean_text"}]
    own = base_rules(_with_spared(with_clean_text(docs.select(*keep), removed, host_col, text_col), spared, id_col), text_col)
    own = own.select(*keep, "__clean", *[F.col(f"__{c}").alias(c) for c in names])
    left = F.coalesce("__clean.words", "n_words")
    own = own.withColumn("removed_share", F.when(F.col("n_words") > 0, (F.col("n_words") - left) / F.col("n_words")).otherwise(F.lit(0.0)))
    own = own.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * F.lit(keep_share)))
    return own.withColumn("clean_text", F.coalesce("__clean.text", F.col(f"`{text_col}`").cast("string"))).drop("__clean")


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text", length_col: str = "n_chars", keep_share: float = 0.4, id_col: str = "doc_id", **limits) -> DataFrame:
    """The rows of ``docs`` that judge_quality keeps, with the columns of ``docs``: texts without their removed lines,
    and their length where ``docs`` has ``length_col``. No document is shuffled unless the removed lines, or the spared documents, are too many to
    broadcast. Columns of any name stay as they are. Nulls, ties and repeated rows as in judge_quality()."""
    types = dict(docs.dtypes)
    plain = lambda c, out: (F.col(f"`{c}`").cast("string") if c in types else F.lit(None).cast("string")).alias(out)
    packed = docs.select(plain(host_col, "host"), plain(text_col, "text"), plain(id_col, "id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    narrow = packed.select("host", "text", "id")
    removed = frequent_lines(narrow, "host", "text", **limits)
    spared = spared_documents(narrow, removed, "host", "text", "id", keep_share)
    text = F.coalesce("text", F.lit(""))
    own = _with_spared(with_clean_text(packed.where(good_base(text)), removed, "host", "text"), spared, "id")
    # a row is kept by exploding an array of one item or none: a filter would compute the clean text a second time
    enough = lambda c: c["words"].isNull() | (c["words"] >= F.size(words_of(text)) * F.lit(keep_share))
    own = own.select("doc", F.explode(F.filter(F.array("__clean"), enough)).alias("clean"))
    new = {text_col: F.col("clean.text"), length_col: F.length("clean.text")}
    part = lambda c: F.col("doc").getField(c)
    return own.select(*[(F.when(F.col("clean").isNotNull(), new[c].cast(types[c])).otherwise(part(c)) if c in new else part(c)).alias(c) for c in docs.columns])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = judge_quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_share")


_SQL_BASE = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
base AS (SELECT doc_id, host, text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n, 0) AS n_repeat_words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
         FROM docs JOIN split USING (doc_id) LEFT JOIN marked USING (doc_id)),
raw AS (SELECT doc_id, host, text, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS place FROM base),
lines AS (SELECT doc_id, host, text, place, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
sized AS (SELECT *, len(string_split(line, ' ')) AS words FROM lines),
hosts AS (SELECT host, count(DISTINCT text) AS total FROM docs GROUP BY host),
often AS (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line),
frequent AS (SELECT host, line FROM often JOIN hosts USING (host) WHERE n > 3.0::DOUBLE + 0.5::DOUBLE * sqrt(total)),
gone AS (SELECT doc_id, sum(words) AS words, min_by(line, place) AS first FROM sized JOIN frequent USING (host, line) GROUP BY doc_id),
all_judged AS (SELECT doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat_words,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(words, 0) AS gone, first, host, md5(text) AS h
           FROM base LEFT JOIN gone USING (doc_id)),
spared AS (SELECT min_by(doc_id, h || ' ' || doc_id::VARCHAR) AS doc_id FROM all_judged WHERE NOT base_failed AND n_words - gone < n_words * 0.4::DOUBLE GROUP BY host, first),
judged AS (SELECT * REPLACE (CASE WHEN doc_id IN (SELECT doc_id FROM spared) THEN 0 ELSE gone END AS gone) FROM all_judged)
"""

SQL_JUDGED = _SQL_BASE + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - gone >= n_words * 0.4::DOUBLE AS kept,
  CASE WHEN n_words > 0 THEN gone::DOUBLE / n_words ELSE 0.0 END::DOUBLE AS removed_share
FROM judged"""

QUERIES = {"op1_line_frequency": op1_line_frequency}
SQL = {"op1_line_frequency": SQL_JUDGED}
