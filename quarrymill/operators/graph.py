"""Connected components of links that lie in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.storage import stored


#: The most links that one task joins at once; with more, links are contracted in rounds until so many are left.
LINKS_IN_A_TASK = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and label (the first of its component that came) of links src, dst."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (p := root(x)) != (q := root(y)):
                parent[q] = p
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(root, nodes), kind)], ["node", "label"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", in_a_task: int = LINKS_IN_A_TASK) -> DataFrame:
    """node and component (the smallest node reached) of all nodes with a link to another one.

    While more than ``in_a_task`` links are left, every node joins the neighbour that comes first in an order by hash, new in each round, and the links
    shrink to those between the nodes that were joined: a star is gone after one round, a chain loses a share of its
    nodes. What is left is joined in one task. Links and labels are stored; the driver learns how many links are left. Null
    ends are left out.
    """
    x, y = F.col(a), F.col(b)
    alive = stored(links.where(x != y).select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).distinct(), "graph-edges")
    trail: list[DataFrame] = []
    while alive.count() > in_a_task:

        def ranked(c: str, turn: int = len(trail)) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))

        both = alive.union(alive.select("dst", "src"))
        first = both.groupBy("src").agg(F.min(ranked("dst")).alias("near"))
        labels = stored(first.select(F.col("src").alias("node"), F.least("near", ranked("src"))["id"].alias("label")), "graph-labels")
        trail.append(labels)
        of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
        ends = alive.join(of("src"), "src").join(of("dst"), "dst").where("src_label <> dst_label")
        alive = stored(ends.select(F.least("src_label", "dst_label").alias("src"), F.greatest("src_label", "dst_label").alias("dst")).distinct(), "graph-edges")
    kind = dict(alive.dtypes)["src"]
    roots = stored(alive.repartition(1).mapInArrow(_joined, f"node {kind}, label {kind}"), "graph-labels")
    for labels in reversed(trail):
        further = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
        roots = labels.join(further, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    roots = stored(roots, "graph-roots") if trail else roots
    least = roots.groupBy("label").agg(F.min("node").alias("component"))
    return roots.join(least, "label").select("node", "component")
