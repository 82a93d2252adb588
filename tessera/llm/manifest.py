"""Merkle dataset manifest (11): trees of digests over the documents of each source, and a proof for each document.

A leaf is the digest of a document's fields. Per source, leaves stand in order of doc_id; runs of ``FAN`` consecutive nodes
become a node of the next level, until one node, the source's subroot, remains. The subroots, in order of their sources, are
the leaves of one more tree, which ends in the root. All nodes of all levels are written to one table.

A proof looks nodes up by coordinates (tree, level, index), which follow from a leaf's index and the number of leaves of its
source. What the leaves of a run have in common is asked for once: each run explodes the coordinates of its members and of the
siblings above them, up to level ``NEAR``; each block of FAN ** NEAR leaves those of the levels above and of the tree of sources.
So a node is asked for by at most FAN ** NEAR runs of its block, however many leaves its tree has, and no key of the joins is
hot: above, a node is asked for once for each block. Found nodes are put in order, concatenated, and folded with the leaf.

Everything is done with Spark's own functions. A null doc_id comes first; documents of one doc_id stand in order of their
digests; repeated rows are leaves of their own; a null source is a source like others, and comes first; null fields count as
``-``; an empty table gives no rows. Long texts are hashed where they are read and never shuffled. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut
from tessera.sources.edges import in_ranges

FAN, NEAR = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**instead: Column) -> Column:
    """The digest of a document's fields, some of them replaced."""
    return digest(*[_field(instead.get(c, F.col(c))) for c in FIELDS])


def tampered() -> Column:
    """Is the document one of those whose text is changed for the check?"""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def levels(n: Column) -> Column:
    """How many levels lie above n leaves."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: (n > F.pow(F.lit(float(FAN)), k - 1)).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _at(n: Column, level: Column) -> Column:
    """How many nodes a level has, of n leaves."""
    return F.ceil(n / F.pow(F.lit(float(FAN)), level)).cast("long")


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """Add tree (its source's number), index and n, the leaves of the source: counted by ranges, a source may be in any number of them."""
    ranged = in_ranges(leaves, "source", "doc_id", "leaf")
    counts = ranged.groupBy("source", "__part").agg(F.count("*").alias("__own"))
    own, before = Window.partitionBy("source"), Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("__source"), F.col("__part").alias("__p"), F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__before"), F.sum("__own").over(own).alias("n"))
    names = counts.groupBy("__source").agg(F.first("n").alias("__n"))
    listed = in_ranges(names, "__source")  # sources' numbers, the same way
    parts = listed.groupBy("__part").count()
    offsets = parts.select(F.col("__part"), F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    trees = listed.join(offsets, "__part").select(F.col("__source").alias("__name"), (F.row_number().over(Window.partitionBy("__part").orderBy("__source")) - 1 + F.col("__first")).alias("tree"))
    counts = cut(counts.join(trees, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name"))
    both = ranged.join(counts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__p")))
    place = F.row_number().over(Window.partitionBy("source", "__part").orderBy("doc_id", "leaf")) - 1 + F.col("__before")
    return both.withColumn("index", place.cast("long")).drop("__source", "__part", "__p", "__before")


def nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """tree, level, index, n (leaves of the tree), node: written, level by level, for ``depth`` levels above the leaves."""
    found = cut(leaves.select("tree", F.lit(0).alias("level"), "index", "n", F.col("leaf").alias("node")))
    whole = found
    for level in range(1, depth + 1):
        below = found.where(F.col("n") > FAN ** (level - 1))  # more than one node remains
        run = F.floor(F.col("index") / FAN)
        members = F.transform(F.sort_array(F.collect_list(F.struct("index", "node"))), lambda x: x["node"])
        up = below.groupBy("tree", run.alias("run"), "n").agg(members.alias("members"))
        found = cut(up.select("tree", F.lit(level).alias("level"), F.col("run").alias("index"), "n", digest(F.concat_ws("", "members")).alias("node")))
        whole = whole.union(found)
    return whole


def siblings(tree: Column, first: Column, from_level: Column, to_level: Column, n: Column, base: int) -> Column:
    """Coordinates of the siblings on the way up from node ``first`` of level ``base``: for each level from ``from_level`` until before ``to_level``.

    tree, level, index and side: 0 before, 1 behind the node on the way.
    """

    def of(level: Column) -> Column:
        own = F.floor(first / F.pow(F.lit(float(FAN)), level - base)).cast("long")
        low = own - own % FAN
        every = F.sequence(low, F.least(low + FAN - 1, _at(n, level) - 1))
        others = F.filter(every, lambda i: i != own)
        return F.transform(others, lambda i: F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), i.alias("index"), (i > own).cast("int").alias("side")))

    wanted = F.when(from_level < to_level, F.sequence(from_level, to_level - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(wanted, of))


def looked_up(units: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """keys and ``found``: the nodes at the units' coordinates (``wanted``), in order of tree, level and index; units without any have no row."""
    each = units.select(*keys, F.explode("wanted").alias("c")).select(*keys, F.col("c.tree").alias("at"), F.col("c.level").alias("level"), F.col("c.index").alias("i"), F.col("c.side").alias("side"))
    met = each.join(table.select(F.col("tree").alias("at"), "level", F.col("index").alias("i"), "node"), ["at", "level", "i"])
    order = F.struct(F.when(F.col("at") == -1, 1).otherwise(0).alias("last"), "level", "i", "side", "node")
    return met.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("found"))


def steps(found: Column, last: int, from_level: Column, to_level: Column) -> Column:
    """For each level what stands before the node on the way, and what behind it."""

    def of(level: Column) -> Column:
        part = lambda side: F.concat_ws("", F.transform(F.filter(found, lambda x: (x["last"] == last) & (x["level"] == level) & (x["side"] == side)), lambda x: x["node"]))
        return F.struct(part(0).alias("before"), part(1).alias("behind"))

    empty = F.array().cast("array<struct<before:string,behind:string>>")
    return F.when(from_level < to_level, F.transform(F.sequence(from_level, to_level - 1), of)).otherwise(empty)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of documents (doc_id, source, lang, n_chars, text)."""
    changed = F.when(tampered(), leaf_digest(text=F.translate(F.col("text"), UPPER, LOWER))).otherwise(F.col("leaf"))
    leaves = docs.select(*FIELDS, leaf_digest().alias("leaf")).select("doc_id", "source", "leaf", changed.alias("folded"))
    placed = cut(numbered_leaves(leaves).drop("source"))
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        return placed.select("doc_id", "leaf", *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))
    depth = _levels(most)
    table = nodes(placed, depth)
    subroots = table.where(F.col("level") == levels(F.col("n"))).select("tree", F.col("node").alias("subroot"))
    trees = subroots.count()
    above = nodes(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(trees).cast("long").alias("n"), F.col("subroot").alias("leaf")), _levels(trees))
    root = above.where(F.col("level") == _levels(trees)).select("node").first()[0]
    every = cut(table.drop("n").union(above.drop("n")))

    own = levels(F.col("n"))
    near = F.least(F.lit(NEAR), own)
    block, run = F.floor(F.col("index") / FAN**NEAR), F.floor(F.col("index") / FAN)
    # the first leaf of a block and of a run stands for all of it
    firsts = table.where("level = 0").select("tree", "index", "n")
    blocks = firsts.where(F.col("index") % FAN**NEAR == 0).select("tree", block.alias("block"), "n")
    up = siblings(F.col("tree"), F.col("block"), F.lit(NEAR), own, F.col("n"), NEAR)
    over = siblings(F.lit(-1), F.col("tree"), F.lit(0), F.lit(_levels(trees)), F.lit(trees), 0)
    asked = blocks.select("tree", "block", F.concat(up, over).alias("wanted"))
    far = blocks.join(looked_up(asked, ["tree", "block"], every), ["tree", "block"], "left").join(subroots, "tree")
    far = far.select("tree", "block", "subroot", F.concat(steps(F.col("found"), 0, F.lit(NEAR), own), steps(F.col("found"), 1, F.lit(0), F.lit(_levels(trees)))).alias("far"))
    far = cut(far)

    runs = firsts.where(F.col("index") % FAN == 0).select("tree", run.alias("run"), "n")
    members = F.when(own > 0, F.transform(F.sequence(F.col("run") * FAN, F.least(F.col("run") * FAN + FAN - 1, F.col("n") - 1)), lambda i: F.struct(F.col("tree").cast("long").alias("tree"), F.lit(0).alias("level"), i.alias("index"), F.lit(0).alias("side"))))
    asked = runs.select("tree", "run", F.concat(F.coalesce(members, F.array()), siblings(F.col("tree"), F.col("run"), F.lit(1), near, F.col("n"), 1)).alias("wanted"))
    close = runs.join(looked_up(asked, ["tree", "run"], every), ["tree", "run"], "left")
    close = close.select("tree", "run", F.floor(F.col("run") / FAN ** (NEAR - 1)).alias("block"), F.transform(F.filter("found", lambda x: x["level"] == 0), lambda x: x["node"]).alias("members"), steps(F.col("found"), 0, F.lit(1), near).alias("close"))
    proofs = close.join(far, ["tree", "block"]).drop("block")

    leaf = placed.withColumn("run", run).join(proofs, ["tree", "run"])
    at = (F.col("index") % FAN).cast("int")
    side = lambda start, n: F.concat_ws("", F.slice("members", start, n))
    first = F.when(own > 0, F.array(F.struct(side(F.lit(1), at).alias("before"), side(at + 2, F.lit(FAN)).alias("behind")))).otherwise(F.array())
    leaf = leaf.withColumn("way", F.concat(first, "close", "far"))
    folded = F.aggregate("way", F.col("folded"), lambda h, s: digest(s["before"], h, s["behind"]))
    proof = digest(F.concat_ws("", F.transform("way", lambda s: F.concat(s["before"], s["behind"]))))
    found = leaf.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(n: int) -> int:
    found = 0
    while n > 1:
        n, found = -(-n // FAN), found + 1
    return found
