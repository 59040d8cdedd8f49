"""Merkle fixity audit of WARC archives (operator 5).

Records are WARC records at byte offsets of archives. Each is hashed; ordered ranges of offsets are hashed over their records'
hashes, archives over their ranges, and groups of archives over those, up to one root. Replicas are compared from the root
down: equal roots end the audit, and below only branches that differ are read. Levels are stored in order of their parents, so
that a filter by parents reaches the files and row groups of these branches alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, stored, table

#: Bits of an offset that a range spans, and bits of an archive number that a group of archives spans.
RANGE_BITS, GROUP_BITS = 16, 8
#: The most differing parents that are sent to the scan as a filter; more are joined.
FILTERED = 2_000
NODE = ["archive", "offset"]


def warc_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", archive_bits: int = 10) -> DataFrame:
    """archive, offset (bytes before the record in its archive), record_id and record of pages as WARC 1.0 records, in archives of
    2 ** ``archive_bits`` ids.

    Null bodies and URIs count as empty. Rows without an id are left out; rows that repeat one follow each other in order of their
    bytes. An empty table gives no records. Columns besides the three are not read.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), text(uri_col).alias("uri"), text(body_col).alias("body")).where("record_id is not null")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.col("record_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"),
    )
    own = own.select("record_id", F.concat(head, F.col("body"), F.lit("\r\n\r\n")).alias("record"), F.shiftright("record_id", archive_bits).alias("archive"))
    before = Window.partitionBy("archive").orderBy("record_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("archive", F.coalesce(F.sum(F.octet_length("record").cast("long")).over(before), F.lit(0)).cast("long").alias("offset"), "record_id", "record")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data, at = content.as_py(), 0
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                fields = dict(x.split(b":", 1) for x in data[at:end].lower().split(b"\r\n")[1:] if b":" in x)
                if end < 0 or not data.startswith(b"WARC/", at) or not fields.get(b"content-length", b"").strip().isdigit():
                    rows.append((path, at, data[at:]))  # what can't be read is one record
                    break
                stop = end + 8 + int(fields[b"content-length"])
                rows.append((path, at, data[at:stop]))
                at = stop
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()))], ["path", "offset", "record"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive (a hash of the file's name without its folder), offset, record_id (null) and record of uncompressed WARC files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    name = F.substring_index("path", "/", -1)
    return map_arrow(files, _parse, "path string, offset long, record binary").select(F.xxhash64(name).alias("archive"), "offset", F.lit(None).cast("long").alias("record_id"), "record")


def record_hashes(records: DataFrame) -> DataFrame:
    """archive, offset, hash and record_id (the least) by offset. Records that repeat an offset are hashed together by their count,
    extremes and sums, in any order. Nulls hash apart from empty records; those without archive or offset are left out."""
    own = records.where("archive is not null and offset is not null").select(*NODE, "record_id", F.coalesce(F.sha2(F.col("record").cast("binary"), 256), F.lit("-")).alias("h"))
    several = F.sha2(F.concat_ws(":", F.count("*"), F.min("h"), F.max("h"), F.bit_xor(F.xxhash64("h")), F.sum(F.xxhash64(F.lit(1), "h").cast("decimal(38,0)"))), 256)
    return own.groupBy(*NODE).agg(F.when(F.count("*") > 1, several).otherwise(F.min("h")).alias("hash"), F.min("record_id").alias("record_id"))


def _up(level: int) -> tuple[Column, Column]:
    """The parent of a node: of a record its range, of a range its archive, then groups of archives."""
    if level == 0:
        return F.col("archive"), F.shiftright("offset", RANGE_BITS)
    return (F.col("archive") if level == 1 else F.shiftright("archive", GROUP_BITS)), F.lit(0).cast("long")


class MerkleTree:
    """Levels of (archive, offset, hash), records first; the root hashes what the last level holds."""

    def __init__(self, records: DataFrame):
        self.levels = [self._kept(record_hashes(records), 0)]
        while len(self.levels) < 3 or self.levels[-1].count() > 1 << GROUP_BITS:
            level = len(self.levels)
            up = _up(level - 1)
            nodes = self.levels[-1].groupBy(up[0].alias("archive"), up[1].alias("offset")).agg(self._joined().alias("hash"))
            self.levels.append(self._kept(nodes, level))
        self.root = self.levels[-1].agg(self._joined()).first()[0]

    @staticmethod
    def _joined() -> Column:
        children = F.sort_array(F.collect_list(F.struct(*NODE, "hash")))
        return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["archive"], c["offset"], c["hash"])), ";"), 256)

    @staticmethod
    def _kept(nodes: DataFrame, level: int) -> DataFrame:
        up = _up(level)
        own = nodes.withColumns({"up_archive": up[0], "up_offset": up[1]})
        return stored(own.repartitionByRange("up_archive", "up_offset").sortWithinPartitions("up_archive", "up_offset", *NODE), f"merkle-{level}")

    def children(self, level: int, parents: DataFrame | None) -> DataFrame:
        """Nodes of a level below ``parents`` (all without them)."""
        nodes = self.levels[level]
        if parents is None:
            return nodes
        few = parents.select(*NODE).limit(FILTERED + 1).collect()
        if len(few) <= FILTERED:
            nodes = nodes.where(F.col("up_archive").isin([r.archive for r in few]) & F.col("up_offset").isin([r.offset for r in few]))
        return nodes.join(parents.select(F.col("archive").alias("up_archive"), F.col("offset").alias("up_offset")), ["up_archive", "up_offset"], "left_semi")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(archive, offset, record_id, fault) of the records (see warc_records) on which two replicas differ: changed, missing (on the
    right) or extra. Equal replicas, and empty ones, give no rows after a look at the roots."""
    one, two = MerkleTree(left), MerkleTree(right)
    same = one.root == two.root and len(one.levels) == len(two.levels)
    # trees of other heights are compared from their archives on
    level = 0 if same else len(one.levels) - 1 if len(one.levels) == len(two.levels) else 2
    suspects = one.levels[0].limit(0) if same else None
    while True:
        x, y = (t.children(level, suspects).drop("up_archive", "up_offset") for t in (one, two))
        y = y.withColumnsRenamed({"hash": "other", "record_id": "other_id"})
        differ = stored(x.join(y, NODE, "full_outer").where("not (hash <=> other)"), "suspects")
        if level == 0:
            fault = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
            return differ.select(*NODE, F.coalesce("record_id", "other_id").alias("record_id"), fault.alias("fault"))
        suspects, level = differ, level - 1


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a replica in which some records have another byte, are lost, or stand once more at another place."""
    own = stored(warc_records(table(spark, sf_dir, "pages")), "replica")
    rot = F.concat(F.substring("record", F.lit(1), F.length("record") - 5), F.when(F.substring("record", -5, 1) == "x", "y").otherwise("x"), F.lit("\r\n\r\n"))
    copied = own.where("record_id % 389 = 11").withColumn("offset", F.col("offset") + (1 << 40))
    damaged = own.where("record_id % 211 <> 7").withColumn("record", F.when(F.col("record_id") % 97 == 5, rot).otherwise(F.col("record"))).unionByName(copied)
    return audit(own, stored(damaged, "replica")).withColumnRenamed("record_id", "page_id")


_SQL = """
WITH r AS (SELECT page_id, page_id >> 10 AS archive, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2) AS record FROM pages),
w AS (SELECT *, coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM r)
SELECT archive::BIGINT AS archive, place AS "offset", page_id, CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'changed' END AS fault FROM w WHERE page_id % 211 = 7 OR page_id % 97 = 5
UNION ALL SELECT archive::BIGINT, place + 1099511627776, page_id, 'extra' FROM w WHERE page_id % 389 = 11"""

QUERIES = {"op5_merkle_fixity": op5_merkle_fixity}
SQL = {"op5_merkle_fixity": _SQL}
