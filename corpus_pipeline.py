"""A corpus pipeline: quality rules, language ID, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read again.
All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import stored, table
from quarrymill.llm.language import MOST_LANGUAGES, UNDETERMINED, cost_limits, identify_languages, learnt_text, within_limit
from quarrymill.llm.packing import pack_documents
from quarrymill.llm.quality import keep_good
from quarrymill.llm.rtree_join import near_duplicates

#: The most removed rows that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def _unused(docs: DataFrame) -> str:
    """A name with which no column of ``docs`` starts, in any case."""
    name = "stage_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that no frequent lines deplete, without those lines. A null text counts as empty
    and goes; a null source is a host of its own; repeated rows share their verdict; an empty table stays empty; other columns, whatever their names,
    stay as they are."""
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labels: those without letters go, and those for which the best language needs much
    shorter phrases than for its own held-out documents. For a short text, whose cost is less certain, the limit is wider. Four fifths of all labelled
    documents teach the phrases, and the last fifth the limits.

    A null text is undetermined and goes; a null lang labels nothing; repeated rows share their verdict; an empty table stays empty; other columns,
    whatever their names, stay as they are.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labelled = learnt_text(docs, 24_000, MOST_LANGUAGES, "text", "lang", ~held)
    limits = cost_limits(docs, labelled, "text", "lang", held)
    row = _unused(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("text").cast("string").alias(f"{row}_text"))
    judged = identify_languages(packed, labelled, [row], f"{row}_text")
    good = (F.col("lang_pred") != UNDETERMINED) & within_limit(limits, F.col("lang_pred"), F.col("phrase_cost"), F.length(F.col(row)["text"]))
    return judged.where(good).select(f"{row}.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): the one with the smallest id, of equal ids that with the
    smallest text by hash.

    Rows count, not ids: each gets a stored key, so that rows that repeat an id are grouped by their own texts, and null ids come last. Rows without words
    are in no group and stay.
    """
    row = _unused(docs)
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-rows")
    groups = stored(near_duplicates(keyed, id_col=row).select(F.col("doc_id").alias("member"), "component_id"), "row-groups")
    shared = groups.where("member <> component_id").select("component_id").distinct()
    members = groups.join(shared, "component_id", "left_semi")
    own = keyed.select(F.col(row).alias("member"), F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    placed = stored(members.join(own, "member").select("component_id", "member", F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "member").alias("place")), "group-members")
    first = placed.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.member").alias("member"))
    gone = stored(placed.join(first, "member", "left_anti").select(F.col("member").alias(f"{row}_gone")), "gone-rows")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return keyed.join(gone, F.col(row) == F.col(f"{row}_gone"), "left_anti").drop(row)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null text is an empty document, null ids stay, repeated rows are packed each; see
    pack_documents()."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", one_of_each_group),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express language ID, the tokenizer and packing; tests hold each stage against brute force.
ORACLE_SQL = None
