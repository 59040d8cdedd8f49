"""N-gram Jaccard join by R-trees over count vectors (operator 10).

Shingles are hashed into groups; a document's counts per group are a point. The overlap of two documents is at most
the sum over groups of the smaller count, and that of all documents below two R-tree nodes at most the sum of the smaller
of the nodes' upper corners. Pairs that survive the bound are verified on the shingle sets themselves.

One tree over all documents would have to compare most of its nodes with each other, as corners of large nodes bound little.
So documents are first dealt to families, each with a tree of its own. Work goes in these steps, none of which
brings more than counts to the driver:

1. digest: each text becomes a shingle set, and equal sets one node from here on;
2. families: linked documents share a key (see Routing); nodes that keys join, directly or through others, are a family;
3. trees: a family's R-tree is joined with itself in a task, which verifies what survives at once. Large families are dealt
   to blocks at random, and each block also holds the same few members, through which the blocks' components meet;
4. components of all links. Keys of large families that still join several components get further trees: the nodes outside
   of the largest component, block by block, against all others. So no pair is left untried that could join two components;
5. the components go back to every document.

A tree task that is after components leaves out pairs that are known to be joined, and gives out fewer links than it has nodes.
One that is after the numbers of links tries all pairs of its family and gives out a sum for each node.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, map_arrow, stored, table
from quarrymill.llm.shingles import Routing, count_vector, mix, set_digest, shingle_sets
from quarrymill.operators.graph import connected_components

U = np.uint64
#: Groups of the count vectors, and how many of them are summed for the coarser points of tree nodes.
GROUPS, FOLD = 256, 8


def fold(counts: np.ndarray) -> np.ndarray:
    """Counts of groups of groups: shorter vectors, whose bound is looser."""
    return counts.reshape(len(counts), GROUPS // FOLD, FOLD).sum(2, dtype=np.int32)


def _parts(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts, some millions of bytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _digest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in _parts(batches):
        sets = shingle_sets(texts, width)
        cols = [pa.array(ids, pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n"])


def _blobs(keys: np.ndarray, nodes: np.ndarray, parts: int, hot: int) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """Packed keys and nodes for each part. Keys that more than ``hot`` of these nodes have are known to be shared: their
    members go out as they are, spread over all parts, and only one of them stands for the rest in the key's own part."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    runs = np.diff(np.r_[first, len(keys)])
    often = np.repeat(runs > hot, runs)
    part = (keys % U(parts)).astype(np.int64)
    spread = (mix(nodes.view(U)) % U(parts)).astype(np.int64)
    stay = ~often
    stay[first] = True
    for is_hot, chosen, to in ((False, np.flatnonzero(stay), part), (True, np.flatnonzero(often), spread)):
        own = chosen[np.argsort(to[chosen], kind="stable")]
        ends = np.searchsorted(to[own], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            at = own[ends[p] : ends[p + 1]]
            yield p, is_hot, keys[at].tobytes(), nodes[at].tobytes()


def _route(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, parts: int, hot: int, flush: int = 600_000) -> Iterator[pa.RecordBatch]:
    routing = Routing(num, den)
    keys: list[np.ndarray] = []
    nodes: list[int] = []
    seen: set[int] = set()
    size = 0

    def packed() -> pa.RecordBatch:
        all_nodes = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        rows = list(_blobs(np.concatenate(keys), all_nodes, parts, hot))
        types = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "hot", "keys", "nodes"])

    for _, texts in _parts(batches):
        for s in shingle_sets(texts, width):
            node = set_digest(s)
            if len(s) and node not in seen:  # copies in one task need their keys only once
                seen.add(node)
                keys.append(routing.keys(s))
                nodes.append(node)
                size += len(keys[-1])
                if size >= flush:
                    yield packed()
                    keys, nodes, size = [], [], 0
                    seen.clear()
    if keys:
        yield packed()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the keys that two or more nodes share. A task holds the packed keys of its parts."""
    keys, nodes = [], []
    for batch in batches:
        for hot, k, n in zip(*(batch.column(c).to_pylist() for c in ("hot", "keys", "nodes"))):
            k, n = np.frombuffer(k, np.int64), np.frombuffer(n, np.int64)
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "node"])
            else:
                keys.append(k)
                nodes.append(n)
    if keys:
        k, n = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((n, k))
        k, n = k[order], n[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])]
        k, n = k[new], n[new]
        same = k[1:] == k[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(k[shared]), pa.array(n[shared])], ["key", "node"])


# --- the tree of a family


class RTree:
    """A packed R-tree: points sorted by size and counts, ``fan`` to a leaf and leaves to a node. A node keeps its upper
    corner (of folded counts), its least and its largest size.

    ``label``: a number for each point, in tree order; pairs of points with one label are left out, and so are pairs of
    nodes that hold this label alone. ``side``: likewise, where given, pairs of points with one side.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, fan: int = 24, label: np.ndarray | None = None, side: np.ndarray | None = None):
        coarse = fold(counts)
        self.order = np.lexsort((*coarse.T[::-1], sizes))
        self.sizes, self.counts, self.coarse, self.fan = sizes[self.order], counts[self.order], coarse[self.order], fan
        self.label = np.arange(len(sizes)) if label is None else label[self.order]
        self.side = None if side is None else side[self.order]
        self.levels = []
        low, high, corner = self.sizes, self.sizes, self.coarse
        while True:
            at = np.arange(0, len(low), fan)
            low, high, corner = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at)
            self.levels.append((low, high, corner))
            if len(low) == 1:
                break

    def _spans(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest label below each node of a level."""
        at = np.arange(0, len(self.label), self.fan ** (level + 1))
        return np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)

    def _survive(self, i: np.ndarray, j: np.ndarray, level: int, routing: Routing) -> np.ndarray:
        """Which pairs of nodes (of points at level -1) may have linked points below them."""
        low, high, corner = (self.sizes, self.sizes, self.coarse) if level < 0 else self.levels[level]
        ok = (low[i] * routing.num <= high[j] * routing.den) & (low[j] * routing.num <= high[i] * routing.den)
        if level < 0:
            ok &= self.label[i] != self.label[j]
            if self.side is not None:
                ok &= self.side[i] != self.side[j]
        else:
            least, most = self._spans(level)
            ok &= (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
        i, j = i[ok], j[ok]
        for points in (corner, self.counts) if level < 0 else (corner,):  # points: first folded, then in full
            fits = np.minimum(points[i], points[j]).sum(1) >= routing.needed(low[i] + low[j])
            ok[ok] = fits
            i, j = i[fits], j[fits]
        return ok

    def pairs(self, routing: Routing, block: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (their places in tree order) that survive the bound, going down from the root with itself,
        some nodes at a time."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = max(1, block // self.fan**2)
        below = np.arange(self.fan)
        while todo:
            level, i, j = todo.pop()
            if len(i) > step:
                todo.append((level, i[step:], j[step:]))
            count = len(self.sizes) if level == 0 else len(self.levels[level - 1][0])
            a, b = i[:step, None, None] * self.fan, j[:step, None, None] * self.fan
            x, y = np.broadcast_arrays(a + below[:, None], b + below)
            x, y = x.ravel(), y.ravel()
            ok = (x < count) & (y < count) & ((x < y) if level == 0 else (x <= y))
            x, y = x[ok], y[ok]
            ok = self._survive(x, y, level - 1, routing)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            if level:
                todo.append((level - 1, x, y))
            else:
                yield x, y


def linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    overlap = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * overlap >= num * (len(both) - overlap)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of each value of ``key``, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        cuts = [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        if held and len(k) and held[-1].column(key)[-1].as_py() != k[0]:
            cuts = [0, *cuts]
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        if at < len(k):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _family(rows: pa.Table, count: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, RTree] | None:
    """Ids and sets of a cell's nodes in tree order (a node that came twice stands once), their weights, and the tree."""
    node, first = np.unique(rows["node"].to_numpy(), return_index=True)
    if len(node) < 2:
        return None
    sets = [np.frombuffer(rows["shingles"][k].as_py(), U) for k in first.tolist()]
    label = np.arange(len(node)) if count else np.unique(rows["component"].to_numpy()[first], return_inverse=True)[1]
    side = rows["side"].to_numpy()[first] if rows["crossed"][0].as_py() else None
    counts = np.array([count_vector(s, GROUPS) for s in sets])
    tree = RTree(np.array([len(s) for s in sets]), counts, label=label, side=side)
    return node[tree.order], [sets[k] for k in tree.order.tolist()], rows["copies"].to_numpy()[first][tree.order], tree


def _join(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links that join all that a cell's trees can join: fewer than it has nodes."""
    routing = Routing(num, den)
    for rows in _runs(batches, "cell"):
        if (got := _family(rows, False)) is None:
            continue
        node, sets, _, tree = got
        out = []
        for x, y in tree.pairs(routing):
            while len(x):
                done = len(x)
                for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
                    if linked(sets[i], sets[j], num, den):
                        out.append((i, j))
                        tree.label[tree.label == tree.label[j]] = tree.label[i]
                        done = k + 1
                        break
                x, y = x[done:], y[done:]
                apart = tree.label[x] != tree.label[y]
                x, y = x[apart], y[apart]
        if out:
            i, j = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])


def _count(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """For each node of a cell the documents with another set that it links with."""
    routing = Routing(num, den)
    for rows in _runs(batches, "cell"):
        if (got := _family(rows, True)) is None:
            continue
        node, sets, copies, tree = got
        links = np.zeros(len(node), np.int64)
        for x, y in tree.pairs(routing):
            for i, j in zip(x.tolist(), y.tolist()):
                if linked(sets[i], sets[j], num, den):
                    links[i] += copies[j]
                    links[j] += copies[i]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The other columns, and the packed shingle set, of the rows whose text has the digest of the wanted node."""
    for batch in batches:
        at = 0
        for _, texts in _parts([batch]):
            part = batch.slice(at, len(texts))
            at += len(texts)
            sets = shingle_sets(texts, width)
            wanted = part.column("node").to_pylist()
            keep = [k for k, s in enumerate(sets) if len(s) and set_digest(s) == wanted[k]]
            rest = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in WANTED), pa.array([sets[k].tobytes() for k in keep], pa.binary())], [*WANTED, "shingles"])


WANTED = ("node", "component", "copies", "places")


class JaccardJoin:
    """Links and components of the documents of a table.

    ``width``: words in a shingle; documents link when den * overlap >= num * union of their shingle sets.
    ``cell_rows``, ``cell_shingles``: nodes, and shingles in all, of a block of a large family. ``shared``: about how many
    members all of its blocks hold. ``broadcast_rows``: the most wanted ids that are broadcast to filter the texts; beyond
    it they are joined by shuffle.
    """

    def __init__(self, docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = 64, cell_rows: int = 512, cell_shingles: int = 1_000_000, shared: int = 24, broadcast_rows: int = 300_000):
        self.docs, self.width, self.num, self.den = documents(docs, id_col, text_col), width, num, den
        self.cell_rows, self.cell_shingles, self.shared, self.broadcast_rows, self.hot = cell_rows, cell_shingles, shared, broadcast_rows, hot
        self.spark = docs.sparkSession
        self.routing = Routing(num, den)
        self.rows = stored(map_arrow(self.docs, _digest, "doc_id long, node long, n long", width=width), "digests")
        own = self.rows.where("node is not null").groupBy("node")
        self.nodes = stored(own.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies")), "nodes")

    def cells(self) -> DataFrame:
        """(key, node) of the keys that several nodes share. The number of parts grows with that of the keys."""
        keys = self.nodes.agg(F.coalesce(F.sum(self.routing.key_count(F.col("n"))), F.lit(0))).first()[0]
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(keys // 2_000_000) + 1)
        packed = map_arrow(self.docs, _route, "part long, hot boolean, keys binary, nodes binary", width=self.width, num=self.num, den=self.den, parts=parts, hot=self.hot)
        return stored(map_arrow(packed.repartition(parts, "part"), _cells, "key long, node long"), "cells")

    def families(self, members: DataFrame) -> DataFrame:
        """node, family, n, copies and the number of blocks of its family."""
        first = members.groupBy("key").agg(F.min("node").alias("first"))
        star = members.join(first, "key").where("node <> first").select("node", "first").distinct()
        family = connected_components(star, "node", "first").withColumnRenamed("component", "family")
        own = family.join(self.nodes.drop("doc_id"), "node")
        size = own.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        blocks = F.ceil(F.greatest(F.col("members") / self.cell_rows, F.col("shingles") / self.cell_shingles)).cast("int")
        return stored(own.join(size.select("family", "members", blocks.alias("blocks")), "family"), "families")

    def trees(self, placed: DataFrame, task, schema: str) -> DataFrame:
        """What ``task`` makes of the cells of ``placed``: node, component, copies, and an array of places (cell, side, crossed).
        Sets come from one text of each node."""
        wanted = stored(placed.join(self.nodes.select("node", F.col("doc_id").alias("wanted_id")), "node"), "wanted")
        chosen = F.broadcast(wanted) if wanted.count() <= self.broadcast_rows else wanted
        texts = self.docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text", *WANTED)
        place = "array<struct<cell: long, side: int, crossed: boolean>>"
        sets = map_arrow(texts, _sets, f"node long, component long, copies long, places {place}, shingles binary", width=self.width)
        rows = sets.select("node", "component", "copies", "shingles", F.explode("places").alias("p")).select("node", "component", "copies", "shingles", "p.cell", "p.side", "p.crossed")
        rows = rows.repartition("cell").sortWithinPartitions("cell")
        return stored(map_arrow(rows, task, schema, num=self.num, den=self.den), "links")

    @staticmethod
    def place(group: str, low: Column, high: Column, side: Column) -> Column:
        return F.struct(F.xxhash64(group, low, high).alias("cell"), side.cast("int").alias("side"), (low != high).alias("crossed"))

    def first_links(self, families: DataFrame) -> DataFrame:
        """Links within the blocks of families."""
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
        block = F.when(F.pmod(F.xxhash64(F.lit(1), "node"), F.col("members")) < self.shared, all_blocks).otherwise(F.array(own))
        places = F.transform(block, lambda b: self.place("family", b, b, F.lit(0)))
        placed = families.select("node", F.col("node").alias("component"), "copies", places.alias("places"))
        return self.trees(placed, _join, "a long, b long")

    def further_links(self, members: DataFrame, families: DataFrame, components: DataFrame) -> DataFrame:
        """Links between components that a key of a large family still joins. The nodes of the largest component among those of
        keys with the same first node meet all others, but not each other."""
        large = families.where("blocks > 1").select("node")
        own = members.join(large, "node").join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        own = stored(own, "open-keys")
        keys = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first")).where("low <> high")
        own = stored(own.join(keys.select("key", "first"), "key").select("first", "node", "component").distinct(), "open-nodes")
        parts = own.groupBy("first", "component").agg(F.count("*").alias("size")).groupBy("first")
        parts = parts.agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("size"))
        blocks = lambda n: F.ceil(n / self.cell_rows).cast("int")
        parts = parts.select("first", F.col("most.component").alias("giant"), blocks(F.col("most.size")).alias("giants"), blocks(F.col("size") - F.col("most.size")).alias("others"))
        own = own.join(stored(parts, "open-parts"), "first").withColumn("is_giant", F.col("component") == F.col("giant"))
        mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_giant"), F.col("giants")).otherwise(F.col("others"))).cast("int")
        own = own.withColumn("mine", F.when(F.col("is_giant"), F.col("others") + mine).otherwise(mine))
        last = F.when(F.col("is_giant"), F.col("others")).otherwise(F.col("others") + F.col("giants")) - 1
        places = F.transform(F.sequence(F.lit(0), last), lambda b: self.place("first", F.least(b, "mine"), F.greatest(b, "mine"), F.col("mine")))
        placed = own.groupBy("node", "component").agg(F.flatten(F.collect_list(places)).alias("places")).withColumn("copies", F.lit(1).cast("long"))
        return self.trees(placed, _join, "a long, b long")

    def components(self) -> DataFrame:
        """node and component of the nodes that link with another."""
        members = self.cells()
        families = self.families(members)
        links = self.first_links(families)
        found = stored(connected_components(links), "components")
        if families.where("blocks > 1").isEmpty():
            return found
        more = self.further_links(members, families, found)
        return found if more.isEmpty() else connected_components(links.union(more))

    def link_counts(self) -> DataFrame:
        """doc_id and n_links of every row: the other rows that it links with, copies included. All pairs of a family are
        tried, block by block, which takes the square of its nodes in time; what goes out is a number a node and block."""
        families = self.families(self.cells())
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: self.place("family", F.least(b, own), F.greatest(b, own), own))
        counts = self.trees(families.select("node", F.col("node").alias("component"), "copies", places.alias("places")), _count, "node long, links long")
        counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
        of = self.nodes.select("node", "copies").join(counts, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        return self.rows.select("doc_id", "node").join(of, "node", "left").select("doc_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))

    def documents(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row; see near_duplicates()."""
        named = self.nodes.select("node", "doc_id").join(self.components(), "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = stored(named, "named")
        lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of = stored(named.join(lowest, "component").select("node", "component_id"), "components")
        out = self.rows.select("doc_id", "node", "n").join(of, "node", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row.

    Five words and a similarity of 0.8 by default. A document without words (or with a null text) has no shingles and
    links with nothing: its component is itself. A null id stays, and never names a component that has other ids.
    Repeated rows are all returned. An empty table gives no rows. Columns besides id and text are not read.
    """
    return JaccardJoin(docs, width, num, den, id_col, text_col).documents()


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
SQL: dict[str, str] = {}
