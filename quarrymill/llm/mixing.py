"""Mixing sources to target weights by weighted fair queueing (operator 11).

The documents of a source are shuffled by a hash and queue up, pass after pass. A document's virtual finish time is the number of its source's
words up to its end, divided by the source's target. All sources' documents are then sorted by it, in ranges over the whole cluster, and the
mix ends where its words reach the budget: at any place of the mix each source has had its share.

Targets share the budget by weight; none is above what ``passes`` passes over its source give, and what is over goes to the others by
weight. As all sources reach their targets at virtual time 1, a document that crosses it is cut there into two pieces.

Words, not texts, are shuffled, and equal rows as one with their number. Running sums are taken in buckets of the hash, and in ranges of the virtual time, after
the sums of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import WORD, stored, table
from quarrymill.operators.matching import numbered

#: Documents, about, whose running sum is taken in one place.
BUCKET_ROWS = 20_000


def source_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (a row each) with ``weight``: the weights in turn by code point of the source, null last."""
    placed = numbered(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"])
    turn = F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1
    return placed.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn.cast("int")).cast("long")).drop("__null", "number")


def with_targets(sources: DataFrame, share: float, passes: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``. Rounds: those whose share by weight of what is left is above their limit
    get the limit; the driver learns two sums a round."""
    sources = stored(sources, "mix-sources")
    limit = F.col("source_size") * passes
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    taken, full, weight = 0, -1, 0
    level = F.lit(False)
    while True:
        row = sources.agg(F.sum(F.when(level, limit)), F.count(F.when(level, 1)), F.sum(F.when(level, 0).otherwise(F.col("weight")))).first()
        if (row[1] or 0) == full:
            break
        taken, full, weight = row[0] or 0, row[1] or 0, row[2] or 0
        rest = share * total - taken
        level = limit.cast("double") < F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1)))
    own = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1)))
    return sources.withColumn("target", F.when(level, limit.cast("double")).otherwise(own))


def shuffle_key(seed: int, *cols: Column) -> Column:
    """60 bits of an MD5 hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sums_before(df: DataFrame, group: list[str], part: str, order: list, size: Column, label: str) -> DataFrame:
    """``df`` with ``label``: the sum of ``size`` over the rows of ``group`` before it, first by ``part``, then by ``order``."""
    keys = [*group, part]
    sums = df.groupBy(*keys).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return placed.join(starts, keys).withColumn(label, (F.col("__start") + F.col("__within")).cast("long")).drop("__start", "__within")


def queue(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each distinct (source, doc_id, size) with ``copies``, its source's size and target, and ``begin``: the words of its
    source before it in a pass. Stored."""
    own = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    own = stored(own.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-documents")
    sources = own.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = stored(with_targets(source_weights(sources, weights), share, passes), "mix-targets")
    buckets = own.count() // BUCKET_ROWS + 64
    keyed = own.withColumn("__key", shuffle_key(seed, F.col("doc_id"), F.col("size"), F.col("source"))).withColumn("__bucket", F.floor(F.col("__key") / F.lit(2.0**60) * buckets))
    # null is a source, but no key of a join
    known = keyed.withColumns({"__null": F.col("source").isNull(), "__name": F.coalesce("source", F.lit(""))})
    placed = _sums_before(known, ["__null", "__name"], "__bucket", ["__key", "doc_id", "size"], F.col("size") * F.col("copies"), "begin")
    of = targets.select(F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name"), "source_size", "weight", "target")
    out = placed.join(of, ["__null", "__name"]).select("source", "doc_id", "size", "copies", "source_size", "weight", "target", "begin")
    return stored(out, "mix-queue")


def mix(queued: DataFrame, passes: int = 2) -> DataFrame:
    """The mix: source, doc_id, size, copies, pass, from (words of the pass's copies before), words, virtual_time and place (words of the mix before). A row
    is the copies of a document in one pass, or a piece of them. It ends where the targets are reached, at the last full word.

    ``orderBy("place")`` gives it in order.
    """
    each = queued.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    each = each.withColumn("first", F.col("pass") * F.col("source_size") + F.col("begin")).withColumn("last", F.col("first") + F.col("size") * F.col("copies"))
    cut = F.floor("target")
    pieces = F.when((F.col("first") < cut) & (cut < F.col("last")), F.array(F.struct(F.col("first").alias("a"), cut.alias("b")), F.struct(cut.alias("a"), F.col("last").alias("b"))))
    each = each.withColumn("piece", F.explode(F.coalesce(pieces, F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b"))))))
    each = each.withColumns({"from": F.col("piece.a") - F.col("first"), "words": F.col("piece.b") - F.col("piece.a"), "virtual_time": F.col("piece.b") / F.col("target")})
    # no source has had a word of its target after time 1, but for the fractions of words that the budget still holds
    near = each.where(F.col("piece.a") <= cut)
    narrow = near.select("source", "doc_id", "size", "copies", "pass", "from", "words", "virtual_time", F.col("piece.a").alias("__at"), "target")
    order = ["virtual_time", "source", "__at"]
    ranged = stored(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    placed = _sums_before(ranged.withColumn("__all", F.lit(0)), ["__all"], "__range", order, F.col("words"), "place")
    total = queued.groupBy("source").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0] or 0.0
    placed = placed.withColumn("words", F.least("words", F.floor(F.lit(total + 1e-6)) - F.col("place"))).where("words > 0")
    return placed.drop("__all", "__at", "__range", "target")


def mixed_documents(queued: DataFrame, taken: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target and taken (words of it in the mix, repeats counted)."""
    key = ["source", "doc_id", "size"]
    parts = taken.groupBy(*key).agg(F.collect_list(F.struct("from", "words")).alias("parts"))  # a pass or two, in two pieces at most
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in key], "parts")
    met = queued.join(parts, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left")
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    low, high = (F.col("copy") - 1) * F.col("size"), F.col("copy") * F.col("size")
    mine = F.aggregate(F.coalesce("parts", F.array()), F.lit(0).cast("long"), lambda s, p: s + F.greatest(F.lit(0).cast("long"), F.least(high, p["from"] + p["words"]) - F.greatest(low, p["from"])))
    return each.select("doc_id", "source", "size", "source_size", "target", mine.alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 11, **columns) -> tuple[DataFrame, DataFrame]:
    """(mix, documents): see mix() and mixed_documents().

    A null text has no words; a null source is one of its own, the last; null ids and rows that repeat an id stay; equal rows are taken one after
    the other; documents without words and sources without a target are in no mix; without any words all targets are 0; an empty table gives no
    rows; texts of any length count by their words; other columns are not read. Reruns agree.
    """
    queued = queue(docs, weights, share, passes, seed, **columns)
    mixed = stored(mix(queued, passes), "mix")
    return mixed, mixed_documents(queued, mixed)


def op11_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))[1].select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op11_fair_mixing": op11_fair_mixing}

_SQL = r"""
WITH docs AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM docs GROUP BY source),
weighted AS (SELECT source, source_size, (CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight FROM src),
levels AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS before, sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    (SELECT sum(source_size) FROM src) AS total
  FROM weighted WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 2 * source_size < (1.5::DOUBLE * total - before) * weight / open_weight AS is_full FROM levels),
rest AS (SELECT 1.5::DOUBLE * coalesce(max(total), 0) - coalesce(sum(2 * source_size) FILTER (is_full), 0) AS words, (sum(weight) FILTER (NOT is_full))::DOUBLE AS weight FROM capped),
targets AS (SELECT c.source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE r.words * c.weight / r.weight END AS target FROM capped c, rest r),
keyed AS (SELECT *, ('0x' || md5('11|' || coalesce(doc_id::VARCHAR, '-') || '|' || size || '|' || coalesce(source, '-'))[1:15])::BIGINT AS h FROM docs),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM keyed),
passes AS (
  SELECT p.source, doc_id, size, source_size, target, floor(target)::BIGINT AS cut, n, n * source_size + begin AS a, n * source_size + begin + size AS b
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS n) WHERE size > 0),
pieces AS (
  SELECT source, doc_id, size, target, a, CASE WHEN a < cut AND cut < b THEN cut ELSE b END AS b FROM passes
  UNION ALL SELECT source, doc_id, size, target, cut, b FROM passes WHERE a < cut AND cut < b),
mix AS (SELECT *, coalesce(sum(b - a) OVER (ORDER BY b / target, source NULLS FIRST, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM pieces),
budget AS (SELECT floor(coalesce(sum(target), 0) + 1e-6)::BIGINT AS words FROM targets),
had AS (SELECT source, doc_id, size, sum(greatest(0, least(b - a, words - place)))::BIGINT AS taken FROM mix, budget GROUP BY ALL)
SELECT d.doc_id, d.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN had h ON h.source IS NOT DISTINCT FROM d.source AND h.doc_id = d.doc_id AND h.size = d.size"""

SQL = {"op11_fair_mixing": _SQL}
