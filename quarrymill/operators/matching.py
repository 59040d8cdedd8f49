"""Finding, clustering and merging duplicate records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import web
from quarrymill.functions.similarity import BLANK, set_ratio, word_sets
from quarrymill.functions.text import let, name_key
from quarrymill.operators.graph import connected_components
from quarrymill.operators.records import changed, filled, flag, noted, set_value, strings, value, with_candidates
from quarrymill.operators.rules import completeness, quality, rank
from quarrymill.schema import Schema
from quarrymill.storage import stored

#: What identifies a record, what tells two apart, and cells whose differences are no conflicts.
IDENTIFIERS = ("phone", "email", "website", "vat_number", "product_url", "upc")
IDENTITY = ("country", "postcode", "street", "house_number", "vat_number", "upc")
COSMETIC = ("latitude", "longitude", "description", "opening_hours", "subcategory", "district")


def identifiers(schema: Schema) -> Column:
    """An array of (kind, id) of a record's identifiers."""
    forms = {"email": F.lower, "product_url": F.lower, "upc": F.lower, "website": web.url_domain}
    own = [(k, forms.get(k, lambda x: x)(value(k))) for k in IDENTIFIERS if schema.field(k)]
    return F.array_compact(F.array(*[let(v, lambda x, k=k: F.when(x.isNotNull(), F.struct(F.lit(k).alias("kind"), x.alias("id")))) for k, v in own]))


def address_key(schema: Schema) -> Column:
    """``postcode|street|number`` without bars at the ends."""
    part = lambda n: F.coalesce(value(n), F.lit("")) if schema.field(n) else F.lit("")
    return F.btrim(F.concat_ws("|", F.btrim(part("postcode")), name_key(part("street")), F.btrim(F.lower(part("house_number")))), F.lit("|"))


def features(records: DataFrame, schema: Schema) -> DataFrame:
    """What pairs of records are compared by: one narrow row per record."""
    keys = [F.when(value(k).isNotNull(), name_key(value(k))).alias(k) if schema.field(k) else F.lit(None).cast("string").alias(k) for k in IDENTITY]
    postcode = value("postcode") if schema.field("postcode") else F.lit(None).cast("string")
    return records.select(
        "record_id", "ord", name_key(value(schema.name_field)).alias("name"), identifiers(schema).alias("ids"), address_key(schema).alias("address"),
        postcode.alias("postcode"), F.struct(*keys).alias("identity"),
    )


#: Members of a block that meet in one place; larger blocks are split into parts of about so many, and parts meet parts.
PART = 512


#: What pairs of records are compared by: records that agree in all of it are a class.
COMPARED = ("name", "ids", "address", "postcode", "identity")


def record_classes(rows: DataFrame) -> DataFrame:
    """Membership of feature rows in classes: ord, class_ord (the smallest ord of the class) and size. Copies count once in the tasks before they are
    dealt out, and a class of any size is counted, not gathered. Stored."""
    keyed = rows.select("ord", F.xxhash64(*COMPARED).alias("digest"), *COMPARED)
    classes = keyed.groupBy("digest", *COMPARED).agg(F.min("ord").alias("class_ord"), F.count("*").alias("size"))
    same = [keyed["digest"] == classes["digest"], *[keyed[c].eqNullSafe(classes[c]) for c in COMPARED]]
    return stored(keyed.join(classes, same).select("ord", "class_ord", "size"), "record-classes")


def class_pairs(rows: DataFrame, pair_budget: int | None = None, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): block_pairs() of the classes' first records, and record_classes(). The budget counts pairs of classes, so that a mailbox or
    postcode that thousands of like records share is no reason to stop. What holds for a pair holds for all pairs of their members, and each class
    of two records or more is a pair with itself (see class_matches())."""
    membership = record_classes(rows)
    first = rows.join(membership.where("ord = class_ord").select("ord"), "ord", "left_semi")
    return block_pairs(first, pair_budget, part), membership


def class_matches(rows: DataFrame, pairs: DataFrame, membership: DataFrame, threshold: int = 90) -> DataFrame:
    """Matches of classes: a_ord, b_ord (first records; equal for matches within a class), similarity, reason, confident, and record_pairs: how many
    pairs of records the match stands for. Every pair of classes is compared once, whatever their sizes."""
    sizes = membership.where("ord = class_ord").select("ord", "size")
    within = sizes.where("size > 1").select(F.col("ord").alias("a_ord"), F.col("ord").alias("b_ord"))
    own = lambda x: rows.select(F.col("ord").alias(f"{x}_ord"), F.struct("*").alias(x))
    both = pairs.select("a_ord", "b_ord").unionByName(within).join(own("a"), "a_ord").join(own("b"), "b_ord")
    met = both.withColumn("m", compare(F.col("a"), F.col("b"), threshold)).where("m is not null").select("a_ord", "b_ord", "m.*")
    of = lambda x: sizes.select(F.col("ord").alias(f"{x}_ord"), F.col("size").alias(f"{x}_size"))
    stands = F.when(F.col("a_ord") == F.col("b_ord"), F.expr("a_size * (a_size - 1) div 2")).otherwise(F.expr("a_size * b_size"))
    return met.join(of("a"), "a_ord").join(of("b"), "b_ord").withColumn("record_pairs", stands.cast("long")).drop("a_size", "b_size")


def _letters(name: Column) -> Column:
    """What bounds the similarity of names without a look at them: n (length of their different words, a space between each two) and low and high, 128 bits
    set by hash for each letter and how many like it come before."""
    words = F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), BLANK), lambda w: w != ""))

    def bits(s: Column) -> Column:
        at = F.transform(s, lambda c, i: F.pmod(F.xxhash64(c, i + 1 - F.array_position(s, c).cast("int")), F.lit(128)).cast("int"))
        mask = lambda own: F.aggregate(F.filter(at, own), F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)))))
        return F.struct(mask(lambda k: k < 64).alias("low"), mask(lambda k: k >= 64).alias("high")).cast("struct<low:bigint,high:bigint>")

    letters = let(F.array_sort(F.filter(F.split(F.array_join(words, ""), ""), lambda c: c != "")), bits)
    return F.struct(F.length(F.array_join(words, " ")).alias("n"), letters["low"].alias("low"), letters["high"].alias("high")).cast("struct<n:int,low:bigint,high:bigint>")


def may_be_alike(x: Column, y: Column, threshold: float) -> Column:
    """False only where the names of _letters() x and y have a token_set_ratio() below ``threshold``.

    Letters of one name that the other lacks lie in its words of its own, and cost a step each on the way to the other's. So a score is reached by few of
    them in one name (its own words are no more than the common ones allow) or by few in both.
    """
    t = threshold / 100
    q = 2 * (1 - t) / t
    lacking = lambda a, b: F.bit_count(a["low"].bitwiseAND(F.bitwise_not(b["low"]))) + F.bit_count(a["high"].bitwiseAND(F.bitwise_not(b["high"])))
    spare = lambda a: F.greatest((q * (a["n"] - 1) - 1) / (1 + q), F.lit(0.0)) + 1e-6
    few = (lacking(x, y) <= spare(x)) | (lacking(y, x) <= spare(y)) | (lacking(x, y) + lacking(y, x) <= (1 - t) * (x["n"] + y["n"]) + 1e-6)
    return (x["n"] > 0) & (y["n"] > 0) & few


def block_pairs(rows: DataFrame, pair_budget: int | None = None, part: int = PART, threshold: int | None = None, identifiers_only: bool = False) -> DataFrame:
    """(a_ord, b_ord, edge_ord) of the records that share an identifier, a postcode or the first six letters of the name; each
    pair once, with the order in which blocks and records give it.

    With a ``threshold`` pairs are left out, before they are shuffled, that no rule of compare() can match: those without a common identifier whose letters
    rule out names so similar. With ``identifiers_only`` postcodes and names make no blocks.

    More pairs than the budget raise an error before any is made; the default is 250,000, or 50 a record where that is
    more: a block that many records share (a mailbox, a dummy postcode) has pairs by the square of its size. With a threshold the default counts the
    pairs with a common identifier alone, as these are matches; the others are only looked at. The pairs of a large
    block are made part by part, in as many tasks as there are pairs of parts.
    """
    kinds = F.transform("ids", lambda x: F.concat(x["kind"], F.lit(":"), x["id"]))
    others = strings(F.concat(F.lit("pc:"), F.col("postcode")), F.when(F.col("name") != "", F.concat(F.lit("name:"), F.substring("name", 1, 6))))
    pruned = threshold is not None and threshold > 0
    # ids as hashes, and a bit for each, which tells most records without a common one apart
    hashed = F.transform("ids", lambda x: F.xxhash64(x["kind"], x["id"]))
    mask = F.aggregate(hashed, F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))
    seen = F.struct(mask.alias("mask"), hashed.alias("ids"), _letters(F.col("name")).alias("letters")).cast("struct<mask:bigint,ids:array<bigint>,letters:struct<n:int,low:bigint,high:bigint>>") if pruned else F.lit(0)
    keyed = rows.select("ord", F.size("ids").alias("n_ids"), seen.alias("seen"), F.posexplode(kinds if identifiers_only else F.concat(kinds, others)).alias("pos", "key"))
    keyed = stored(keyed.select("ord", "pos", "key", (F.col("pos") < F.col("n_ids")).alias("by_id"), "seen"), "block-keys")
    first = keyed.groupBy("key").agg(F.min(F.struct("ord", "pos")).alias("block"), F.count("*").alias("members"), F.first("by_id").alias("by_id")).where("members > 1")
    first = stored(first.withColumn("parts", F.ceil(F.col("members") / part).cast("int")), "blocks")
    counted = first.where("by_id") if pruned and pair_budget is None else first
    total = counted.agg(F.sum(F.expr("members * (members - 1) / 2"))).first()[0] or 0
    budget = max(250_000, 50 * rows.count()) if pair_budget is None else pair_budget
    if total > budget:
        worst = [f"{r.key} ({r.members})" for r in counted.orderBy(F.desc("members"), "key").limit(3).collect()]
        raise ValueError(f"{total:.0f} pairs to compare, but the budget is {budget}: split the input or mend the most shared values, {', '.join(worst)}")
    own = keyed.drop("by_id").join(first, "key").withColumn("mine", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int"))
    left = own.select("key", "block", "by_id", F.col("ord").alias("a"), F.col("seen").alias("x"), F.col("mine").alias("p"), F.explode(F.sequence("mine", F.col("parts") - 1)).alias("q"))
    right = own.select("key", F.col("ord").alias("b"), F.col("seen").alias("y"), F.col("mine").alias("q"), F.explode(F.sequence(F.lit(0), "mine")).alias("p"))
    which = F.expr("(p < q and a <> b) or (p = q and a < b)")
    if pruned:
        x, y = F.col("x"), F.col("y")
        shared = (x["mask"].bitwiseAND(y["mask"]) != 0) & F.arrays_overlap(x["ids"], y["ids"])
        which = which & (F.col("by_id") | may_be_alike(x["letters"], y["letters"], threshold) | shared)
    met = left.join(right, ["key", "p", "q"]).where(which)
    pairs = met.select(F.least("a", "b").alias("a_ord"), F.greatest("a", "b").alias("b_ord"), "block").where("a_ord < b_ord")
    return pairs.groupBy("a_ord", "b_ord").agg(F.min(F.struct("block", "a_ord", "b_ord")).alias("edge_ord"))


def compare(a: Column, b: Column, threshold: int = 90, words: Column | None = None) -> Column:
    """(similarity, reason, confident) of two feature rows, null for no match. The first rule that holds decides. ``words``: a column with the word_sets()
    of the names, where there is one."""
    shared = F.transform(F.filter(a["ids"], lambda x: F.array_contains(b["ids"], x)), lambda x: x["kind"])
    # names of records that share no identifier count from the threshold on alone
    needed = F.when(F.arrays_overlap(a["ids"], b["ids"]), 0.0).otherwise(float(threshold))
    similarity = F.when((a["name"] != "") & (b["name"] != ""), set_ratio(word_sets(a["name"], b["name"]) if words is None else words, needed)).otherwise(0.0)
    conflict = F.lit(False)
    for k in IDENTITY:
        conflict = conflict | F.coalesce(a["identity"][k] != b["identity"][k], F.lit(False))
    address = (a["address"] != "") & (a["address"] == b["address"]) & a["address"].contains("|")
    postcode = F.coalesce(a["postcode"] == b["postcode"], F.lit(False))
    nowhere = a["postcode"].isNull() & b["postcode"].isNull()

    def rules(s: Column) -> Column:
        sim, hard = s["sim"], F.filter(s["shared"], lambda k: k != "website")
        site, alike = F.array_contains(s["shared"], "website"), s["sim"] >= threshold
        percent = F.concat(F.bround(sim, 0).cast("int").cast("string"), F.lit("% similar"))
        which = F.concat(F.lit("same "), F.array_join(hard, ", "))
        where = F.when(s["address"], "same address").when(s["postcode"], "same postcode").otherwise("no address on either record")
        made = lambda reason, sure: F.struct(sim.alias("similarity"), reason.alias("reason"), sure.alias("confident"))
        no, yes = F.lit(False), F.lit(True)
        return (
            F.when(s["conflict"] & ((F.size(s["shared"]) > 0) | alike), made(F.lit("conflicting location or legal identifier (branch or chain?) - review"), no))
            .when((F.size(hard) > 0) & (sim >= 60), made(F.concat(which, F.lit("; names "), percent), yes))
            .when(site & alike & s["address"], made(F.concat(F.lit("same website domain and address; names "), percent), yes))
            .when(alike & (s["address"] | s["postcode"] | s["nowhere"]), made(F.concat(F.lit("names "), percent, F.lit("; "), where), s["address"]))
            .when(site, made(F.concat(F.lit("same website domain but different name/address (branch or chain?) - names "), percent), no))
            .when(F.size(hard) > 0, made(F.concat(which, F.lit(" but different names - review")), no))
        )

    parts = F.struct(similarity.alias("sim"), shared.alias("shared"), conflict.alias("conflict"), F.coalesce(address, F.lit(False)).alias("address"), postcode.alias("postcode"), nowhere.alias("nowhere"))
    return let(parts, rules)


def score_pairs(rows: DataFrame, pairs: DataFrame, threshold: int = 90) -> DataFrame:
    """Matches: a, b (record ids), similarity, reason, confident, edge_ord."""
    own = lambda x: rows.select(F.col("ord").alias(f"{x}_ord"), F.struct("*").alias(x))
    both = pairs.join(own("a"), "a_ord").join(own("b"), "b_ord")
    both = both.withColumn("__words", word_sets(F.col("a.name"), F.col("b.name")))
    out = both.withColumn("m", compare(F.col("a"), F.col("b"), threshold, F.col("__words")))
    out = out.select(F.col("a.record_id").alias("a"), F.col("b.record_id").alias("b"), "a_ord", "b_ord", "m", "edge_ord")
    # stored, as the filter would compare every pair once more
    return stored(out, "compared-pairs").where("m is not null").select("a", "b", "a_ord", "b_ord", "m.*", "edge_ord")


REFUSED = "transitive duplicate group contains conflicting locations or legal identifiers - review"


def _replay(edges: pd.DataFrame) -> pd.DataFrame:
    """Joins the clusters x, y of one component by its edges in order; a join that would bring differing identities together is refused."""
    root: dict[int, int] = {}
    known: dict[int, dict[str, str]] = {}

    def find(x: int) -> int:
        while (up := root[x]) != x:
            root[x] = x = root[up]
        return x

    edges = edges.sort_values("place", kind="stable")
    accepted = []
    for a, b, ka, kb in zip(edges.x, edges.y, edges.a_identity, edges.b_identity):
        for x, k in ((a, ka), (b, kb)):
            if x not in root:
                root[x], known[x] = x, {n: v for n, v in dict(k).items() if v is not None}
        x, y = find(a), find(b)
        fits = all(known[y].get(n, v) == v for n, v in known[x].items())
        accepted.append(fits)
        if fits and x != y:
            root[y] = x
            known[x] |= known[y]
    return edges.assign(accepted=accepted)[["a_ord", "b_ord", "accepted"]]


#: The most undecided matches that are replayed component by component in tasks; with more, they are decided in rounds.
REPLAYED_AT_ONCE = 200_000


def _identity_of(keys: list[str], x: str, y: str) -> tuple[Column, Column, Column]:
    """(clash, x within y, y within x) of the identities of clusters x and y."""
    clash, in_y, in_x = F.lit(False), F.lit(True), F.lit(True)
    for k in keys:
        a, b = F.col(f"{x}.{k}"), F.col(f"{y}.{k}")
        clash = clash | F.coalesce(a != b, F.lit(False))
        in_y, in_x = in_y & (a.isNull() | a.eqNullSafe(b)), in_x & (b.isNull() | b.eqNullSafe(a))
    return clash, in_y, in_x


def decide(edges: DataFrame, identities: DataFrame, keys: list[str], at_once: int = REPLAYED_AT_ONCE) -> DataFrame:
    """``edges`` (a_ord, b_ord, place) with ``accepted``: what joining the nodes edge by edge in the order of ``place`` gives, where an edge that
    would bring two values of one of ``keys`` into a cluster is refused. ``identities``: node and the keys' values. Stored.

    Rounds decide many edges at once, each as its turn would:

    * ends in one cluster: accepted; clusters that clash: refused, as clusters only grow, and with them what they clash with;
    * an edge that is the first open one at both its clusters: accepted, as nothing changes the two before its turn;
    * an edge that is the first open one at a cluster whose identity is part of the other's: accepted, as the other's will hold it still at its turn,
      and isn't changed by it.

    Clusters that are joined become one (connected components of the round's edges), and its identity is that of both. So a star or a chain of records
    of one identity takes a round, and a cluster changes its identity as often as there are keys. When ``at_once`` edges are left, at most, their
    components are replayed in tasks.
    """
    nodes = stored(identities.select(F.col("node").alias("id"), F.struct(*keys).alias("known")), "identities")
    left = stored(edges.select("a_ord", "b_ord", "place", F.col("a_ord").alias("x"), F.col("b_ord").alias("y")), "open-edges")
    done: list[DataFrame] = []
    while left.count() > at_once:
        of = lambda end: nodes.select(F.col("id").alias(end), F.col("known").alias(f"known_{end}"))
        clash, in_y, in_x = _identity_of(keys, "known_x", "known_y")
        seen = left.join(of("x"), "x").join(of("y"), "y").select("a_ord", "b_ord", "place", "x", "y", clash.alias("clash"), in_y.alias("in_y"), in_x.alias("in_x"))
        seen = stored(seen, "seen-edges")
        settled = seen.where("x = y or clash").select("a_ord", "b_ord", (F.col("x") == F.col("y")).alias("accepted"))
        rest = seen.where("x <> y and not clash")
        ends = rest.select(F.col("x").alias("id"), "place", F.col("y").alias("other"), F.col("in_y").alias("within")).unionByName(rest.select(F.col("y").alias("id"), "place", F.col("x").alias("other"), F.col("in_x").alias("within")))
        first = ends.groupBy("id").agg(F.min(F.struct("place", "other", "within")).alias("e")).select("id", "e.*")
        now = first.groupBy("place").agg(F.count("*").alias("sides"), F.max("within").alias("within"), F.min("id").alias("x"), F.max(F.greatest("id", "other")).alias("y"), F.min(F.least("id", "other")).alias("low"))
        now = stored(now.where("sides = 2 or within").select("place", F.col("low").alias("x"), "y"), "decided-edges")
        labels = stored(connected_components(now, "x", "y").withColumnRenamed("component", "label"), "joined-clusters")
        done.append(stored(settled.unionByName(rest.join(now.select("place"), "place", "left_semi").select("a_ord", "b_ord", F.lit(True).alias("accepted"))), "decisions"))
        to = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        open_ = rest.join(now.select("place"), "place", "left_anti").join(to("x"), "x", "left").join(to("y"), "y", "left")
        left = stored(open_.select("a_ord", "b_ord", "place", F.coalesce("x_label", "x").alias("x"), F.coalesce("y_label", "y").alias("y")), "open-edges")
        merged = nodes.join(labels, nodes["id"] == labels["node"], "left").groupBy(F.coalesce("label", "id").alias("id")).agg(*[F.max(f"known.{k}").alias(k) for k in keys])
        nodes = stored(merged.select("id", F.struct(*keys).alias("known")), "identities")
    own = left.join(nodes.select(F.col("id").alias("x"), F.col("known").alias("a_identity")), "x").join(nodes.select(F.col("id").alias("y"), F.col("known").alias("b_identity")), "y")
    components = connected_components(left, "x", "y", at_once).withColumnRenamed("node", "x")
    own = own.join(components, "x", "left").withColumn("component", F.coalesce("component", "x"))
    as_map = lambda c: F.create_map(*[v for k in keys for v in (F.lit(k), F.col(f"{c}.{k}"))])
    text = F.to_json(F.array(*[F.format_string("%020d", c) for c in (F.col("place.block.ord"), F.col("place.block.pos"), F.col("place.a_ord"), F.col("place.b_ord"))]))
    again = own.select("component", "a_ord", "b_ord", "x", "y", text.alias("place"), as_map("a_identity").alias("a_identity"), as_map("b_identity").alias("b_identity"))
    done.append(again.groupBy("component").applyInPandas(_replay, "a_ord long, b_ord long, accepted boolean"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out, "decided")


def cluster(rows: DataFrame, matches: DataFrame, at_once: int = REPLAYED_AT_ONCE) -> DataFrame:
    """``matches`` with accepted (it joined its records) and a_cluster, b_cluster (the smallest ord of a record's cluster).

    Components of confident matches whose records don't contradict each other are clusters. In the others the matches are decided in
    order; see decide(). No component has to fit a task.
    """
    sure = matches.where("confident")
    components = stored(connected_components(sure, "a_ord", "b_ord"), "components")
    distinct = [F.count_distinct(F.col(f"identity.{k}")).alias(k) for k in IDENTITY]
    members = rows.join(components, rows["ord"] == components["node"])
    odd = stored(members.groupBy("component").agg(*distinct).where(" or ".join(f"{k} > 1" for k in IDENTITY)).select("component"), "odd-components")
    if odd.isEmpty():
        placed = components
        decided = sure.select("a_ord", "b_ord", F.lit(True).alias("accepted"))
    else:
        of = components.withColumnRenamed("node", "a_ord")
        edges = stored(sure.join(of, "a_ord").join(odd, "component", "left_semi").select("a_ord", "b_ord", F.col("edge_ord").alias("place")), "odd-edges")
        nodes = members.join(odd, "component", "left_semi").select("node", *[F.col(f"identity.{k}").alias(k) for k in IDENTITY])
        ruled = decide(edges, nodes, list(IDENTITY), at_once)
        plain = sure.join(of, "a_ord").join(odd, "component", "left_anti").select("a_ord", "b_ord", F.lit(True).alias("accepted"))
        decided = stored(plain.unionByName(ruled), "decisions")
        placed = connected_components(decided.where("accepted"), "a_ord", "b_ord")
    placed = stored(placed.select("node", "component"), "clusters")
    out = matches.join(decided, ["a_ord", "b_ord"], "left")
    for x in ("a", "b"):
        of = placed.select(F.col("node").alias(f"{x}_ord"), F.col("component").alias(f"{x}_cluster"))
        out = out.join(of, f"{x}_ord", "left").withColumn(f"{x}_cluster", F.when(F.col("accepted").isNotNull(), F.coalesce(f"{x}_cluster", f"{x}_ord")))
    refused = F.col("confident") & ~F.col("accepted")
    return out.withColumns({"reason": F.when(refused, F.lit(REFUSED)).otherwise(F.col("reason")), "accepted": F.coalesce("accepted", F.lit(False)), "confident": F.col("confident") & F.coalesce("accepted", F.lit(False))})


def group_rows(records: DataFrame, matches: DataFrame, schema: Schema, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(groups, membership) of clustered matches.

    groups: group_id, master_id, member_ids, reason, similarity, merged. membership: record_id, group, cluster, place (0 for the
    master) for clusters; for possible pairs the group alone. Clusters are numbered by their first match, then come
    the possible pairs in order.
    """
    sure = matches.where("accepted")
    clusters = sure.groupBy(F.col("a_cluster").alias("cluster")).agg(
        F.min("edge_ord").alias("first"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("similarity").alias("similarity")
    )
    ends = sure.select(F.col("a_cluster").alias("cluster"), F.col("a_ord").alias("ord"), "edge_ord", F.lit(0).alias("side")).union(sure.select("b_cluster", "b_ord", "edge_ord", F.lit(1)))
    # stored, as three joins use it, and as Spark would take it for small by the files of the matches
    seen = stored(ends.groupBy("cluster", "ord").agg(F.min(F.struct("edge_ord", "side")).alias("seen")), "cluster-members")
    rated = seen.join(records.select("ord", "record_id", quality(schema).alias("quality")), "ord")
    best = Window.partitionBy("cluster").orderBy(F.desc("quality"), "seen")
    rated = rated.withColumn("place", F.row_number().over(best) - 1)
    lists = rated.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "record_id"))), lambda x: x["record_id"]).alias("member_ids"))
    of = lambda x: seen.select(F.col("ord").alias(f"{x}_ord"), F.col("cluster").alias(f"{x}_own"))
    possible = matches.where("not accepted").join(of("a"), "a_ord", "left").join(of("b"), "b_ord", "left").where("not coalesce(a_own = b_own, false)")
    pairs = possible.select(F.lit(None).cast("long").alias("cluster"), F.array("a", "b").alias("member_ids"), "reason", "similarity", F.col("edge_ord").alias("first"), F.lit(1).alias("part"))
    sets = clusters.join(lists, "cluster").select("cluster", "member_ids", F.array_join("reasons", "; ").alias("reason"), "similarity", "first", F.lit(0).alias("part"))
    groups = numbered(sets.unionByName(pairs), ["part", "first"])
    groups = stored(groups.withColumn("group_id", F.concat(F.lit("DUP-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0")))), "groups")
    shown = groups.select("group_id", F.col("member_ids")[0].alias("master_id"), "member_ids", "reason", "similarity", (F.lit(merge) & (F.col("part") == 0)).alias("merged"), "part", "number")
    exploded = groups.select("group_id", "part", "number", "reason", F.col("member_ids")[0].alias("master_id"), F.size("member_ids").alias("size"), F.posexplode("member_ids").alias("place", "record_id"))
    return shown, exploded


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``number`` from 1 by ``order``: rows are dealt out by ranges and numbered in them, after the counts of
    the ranges before."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "numbered")
    within = Window.partitionBy("__part").orderBy("__at")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn("number", F.col("__start") + F.row_number().over(within)).drop("__part", "__at", "__start")


def merge_cell(master: Column, other: Column, name: Column, cosmetic: Column) -> Column:
    """(cell, conflict) after ``other`` came to the cell ``master`` of the field ``name``."""
    c, o = master, other
    state = lambda cell, conflict: F.struct(cell.alias("cell"), conflict.alias("conflict"))
    none = F.lit(None).cast("string")
    same = F.lower(F.btrim(c["value"])) == F.lower(F.btrim(o["value"]))
    higher = rank(o["status"]) > rank(c["status"])
    two = (c["status"] == "unverified") & (o["status"] == "unverified") & (c["source"] != o["source"])
    equal = F.when(higher, changed(c, status=o["status"], note=o["note"], source=o["source"])).when(two, changed(c, status="verified", note=F.concat(F.lit("same value in "), c["source"], F.lit(" and "), o["source"]))).otherwise(c)
    won = lambda a: with_candidates(set_value(a, o["value"], o["source"], o["status"], o["note"]), F.array(a["value"]))
    text = lambda b: F.concat(b["value"], F.lit(" vs "), o["value"])
    clash = lambda b: state(changed(b, status="conflict", note=noted(b, F.concat(F.lit("differs between sources: "), text(b)))), F.concat(name, F.lit(": "), text(b)))
    differ = let(with_candidates(c, F.array(o["value"])), lambda a: F.when(cosmetic, state(a, none)).otherwise(let(F.when(higher, won(a)).otherwise(a), clash)))
    taken = set_value(c, o["value"], o["source"], o["status"], o["note"])
    return F.when(filled(o).isNull(), state(c, none)).when(filled(c).isNull(), state(taken, none)).when(same, state(equal, none)).otherwise(differ)


#: Conflicts of a cluster that its flag names.
NAMED_CONFLICTS = 4
#: Equal cells in a row that can still change a merged cell: it first differs, then is replaced, then takes the other's status, and stays so.
EFFECTIVE_RUN = 4


def effective_cells(each: DataFrame, block: int = 1000) -> DataFrame:
    """``each`` (group_id, k, place, cell) without the cells that change nothing: empty ones but the master's, and what goes on in a run of equal cells.
    Runs are looked for in blocks of places, so that no cluster is sorted in one place."""
    o = F.struct(*[F.col(f"cell.{c}") for c in ("value", "source", "status", "note")])
    own = each.where((F.col("place") == 0) | filled(F.col("cell")).isNotNull())
    order = Window.partitionBy("group_id", "k", F.floor(F.col("place") / block)).orderBy("place")
    repeated = F.lit(True)
    for n in range(1, EFFECTIVE_RUN + 1):
        repeated = repeated & F.coalesce(F.lag(F.struct("place", o.alias("o")), n).over(order)["o"].eqNullSafe(o), F.lit(False))
    return own.withColumn("__repeated", repeated).where("not __repeated or place = 0").drop("__repeated")


def merge_fields(records: DataFrame, membership: DataFrame, schema: Schema, block: int = 1000) -> DataFrame:
    """One row per cluster: record_id of the master, its merged cells, and merge_flags.

    The members' cells are merged into the master's in order, field by field: a row is a field of a cluster with the cells that change it, not
    the cluster's records. Flags are those of the members, each once, where it comes first.
    """
    cells, names = [f.column for f in schema.fields], [f.name for f in schema.fields]
    clusters = membership.where("part = 0")
    rows = clusters.select("group_id", "place", "record_id").join(records.select("record_id", "flags", *cells), "record_id")
    empty = F.lit(None).cast("string")
    blank = lambda c: F.coalesce(c, F.struct(empty.alias("value"), F.lit("").alias("source"), F.lit("missing").alias("status"), F.lit("").alias("note"), strings().alias("candidates")))
    spread_out = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("cell")) for k, c in enumerate(cells)])).alias("x")
    each = rows.select("group_id", "place", spread_out).select("group_id", "place", "x.k", blank(F.col("x.cell")).alias("cell"))
    gathered = effective_cells(each, block).groupBy("group_id", "k").agg(F.array_sort(F.collect_list(F.struct("place", "cell"))).alias("rows"))
    gathered = stored(gathered.withColumns({"name": F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1), "cosmetic": F.col("k").isin([k for k, n in enumerate(names) if n in COSMETIC])}), "merged-runs")
    no_conflicts = F.array().cast("array<struct<place:int,k:int,text:string>>")

    def fold(state: Column, row: Column) -> Column:
        def took(new: Column) -> Column:
            more = (new["conflict"].isNotNull()) & (F.size(state["conflicts"]) < NAMED_CONFLICTS)
            found = F.when(more, F.array(F.struct(row["place"].cast("int").alias("place"), F.col("k").alias("k"), new["conflict"].alias("text")))).otherwise(no_conflicts)
            return F.struct(new["cell"].alias("cell"), F.concat(state["conflicts"], found).alias("conflicts"))

        return let(merge_cell(state["cell"], row["cell"], F.col("name"), F.col("cosmetic")), took)

    start = F.struct(F.col("rows")[0]["cell"].alias("cell"), no_conflicts.alias("conflicts"))
    merged = stored(gathered.select("group_id", "k", F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), start, fold).alias("m")).select("group_id", "k", "m.*"), "merged-cells")
    own = lambda k, c: F.first(F.when((F.col("k") == k) & (filled(F.col("cell")).isNotNull() | (F.col("cell.status") != "missing")), F.col("cell")), ignorenulls=True).alias(c)
    wide = merged.groupBy("group_id").agg(*[own(k, c) for k, c in enumerate(cells)], F.slice(F.array_sort(F.flatten(F.collect_list("conflicts"))), 1, NAMED_CONFLICTS).alias("conflicts"))
    first = rows.select("group_id", "place", F.posexplode("flags").alias("at", "flag")).where((F.col("place") == 0) | ~F.col("flag").startswith("missing")).groupBy("group_id", "flag").agg(F.min(F.struct("place", "at")).alias("seen"))
    said = first.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "flag"))), lambda x: x["flag"]).alias("own_flags"))
    base = clusters.where("place = 0").select("group_id", F.col("master_id").alias("record_id"), "reason", F.col("size").alias("members"))
    conflicts = F.transform("conflicts", lambda x: x["text"])
    note = F.concat(F.lit("note: merged "), (F.col("members") - 1).cast("string"), F.lit(" duplicate record(s) - "), F.col("reason"))
    clash = F.when(F.size("conflicts") > 0, F.concat(F.lit("merged duplicates disagree on: "), F.array_join(conflicts, "; "), F.lit(" - review")))
    flags = F.array_distinct(F.concat(F.coalesce("own_flags", strings()), strings(note, clash)))
    return base.join(wide, "group_id").join(said, "group_id", "left").select("record_id", flags.alias("merge_flags"), *cells)


def dedupe(records: DataFrame, schema: Schema, threshold: int = 90, merge: bool = True, pair_budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, groups): records with duplicate_group, duplicate_of and flags; with ``merge`` the masters hold merged cells."""
    records = stored(records, "records")
    rows = stored(features(records, schema), "features")
    matches = stored(cluster(rows, stored(score_pairs(rows, block_pairs(rows, pair_budget, threshold=threshold), threshold), "matches")), "clustered")
    groups, membership = group_rows(records, matches, schema, merge)
    membership = stored(membership, "membership")
    text = F.when(F.col("part") == 0, F.concat(F.lit("duplicate group "), F.col("group_id"), F.lit(": "), F.col("reason"), F.lit(" - review"))).otherwise(
        F.concat(F.lit("possible duplicate ("), F.col("group_id"), F.lit("): "), F.regexp_replace("reason", " - review$", ""), F.lit(" - review"))
    )
    keep_text = F.lit(not merge) | (F.col("part") == 1)
    of = membership.groupBy("record_id").agg(
        F.min_by("group_id", "number").alias("duplicate_group"),
        F.max(F.when((F.col("part") == 0) & (F.col("place") > 0) & F.lit(merge), F.col("master_id"))).alias("duplicate_of"),
        F.transform(F.array_sort(F.collect_list(F.when(keep_text, F.struct("number", text.alias("text"))))), lambda x: x["text"]).alias("group_flags"),
    )
    out = records.drop("duplicate_group", "duplicate_of").join(of, "record_id", "left")
    out = out.withColumns({"duplicate_group": F.coalesce("duplicate_group", F.lit("")), "duplicate_of": F.coalesce("duplicate_of", F.lit(""))})
    if merge:
        cells = [f.column for f in schema.fields]
        merged = merge_fields(records, membership, schema)
        merged = merged.select("record_id", "merge_flags", *[F.col(c).alias(f"{c}__m") for c in cells])
        out = out.join(merged, "record_id", "left")
        is_master = F.col("merge_flags").isNotNull()
        out = out.withColumns({c: F.when(is_master, F.col(f"{c}__m")).otherwise(F.col(c)) for c in cells})
        away = F.when(F.col("duplicate_of") != "", F.concat(F.lit("duplicate of "), F.col("duplicate_of"), F.lit(" (merged)")))
        out = flag(out.withColumn("flags", F.coalesce("merge_flags", "flags")), away).drop("merge_flags", *[f"{c}__m" for c in cells])
    out = out.withColumn("flags", F.array_distinct(F.concat("flags", F.coalesce("group_flags", strings())))).drop("group_flags")
    return out.withColumn("completeness", completeness(schema)), groups


def duplicates_table(groups: DataFrame, records: DataFrame, schema: Schema) -> DataFrame:
    """One row per group: what was done, the kept record and the others, the reason and the similarity."""
    names = records.select("record_id", value(schema.name_field).alias("name"))
    parts = groups.select("group_id", "merged", "reason", "similarity", "master_id", F.posexplode("member_ids").alias("place", "record_id")).join(names, "record_id", "left")
    rest = lambda what: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("place", "record_id", F.coalesce("name", F.lit("")).alias("name")))), lambda x: x["place"] > 0), lambda x: x[what])
    out = parts.groupBy("group_id", "merged", "reason", "similarity", "master_id").agg(F.max(F.when(F.col("place") == 0, F.col("name"))).alias("kept_name"), F.array_join(rest("record_id"), ", ").alias("other_ids"), F.array_join(rest("name"), "\n").alias("other_names"))
    action = F.when(F.col("merged"), "merged automatically").otherwise("POSSIBLE duplicate - decide")
    return out.select("group_id", action.alias("action"), F.col("master_id").alias("kept_id"), "kept_name", "other_ids", "other_names", "reason", F.bround("similarity", 0).cast("int").alias("similarity"))


