"""Merkle manifest of a dataset, kept as concatenated-level strings.

A node's digest is 64 hex characters, and a level of an aligned block of nodes is one string of them. The
parents of a level are the digests of its fixed-width substrings of eight nodes; what stands left and right
of a node inside its run is its sibling segment on that level. A block holds ``RUN ** HEIGHT`` nodes and
climbs ``HEIGHT`` levels in one expression; the blocks' roots are the nodes of the next round, until every
tree has one node. The trees' roots are the nodes of a last tree. Proofs go the other way: a node's
segments are those inside its block followed by the segments of the block's root.

Nodes are placed by range partitions (``positions``), so a language of any size spreads over tasks, and
only digests and sibling segments of block roots are shuffled; a document's proof is folded where its
block lies. Only SQL functions are used.

Defined results: a null value is written ``-``; rows without doc_id come first in their language; rows that
repeat a doc_id are ordered by leaf and each have a leaf; rows without lang form the first tree. An empty
table has no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import LOWER, UPPER, positions, stage

# Nodes per run, hex characters per digest, fields of a leaf in their order.
RUN, WIDTH = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 3  # levels that a block climbs
_BITS = 3  # a run's nodes differ in so many bits of their place


def _digest(data: Column) -> Column:
    return F.sha2(data, 256)


def leaf(text: Column) -> Column:
    """Digest of the fields, each as its byte count, a colon and the value."""
    parts = [(text if c == "text" else F.col(c)).cast("string") for c in FIELDS]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def tampered_text() -> Column:
    """The text as tampering leaves it: A-Z lower-cased where 3 divides crc32 of the doc_id as text."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def levels_over(n: Column) -> Column:
    """Number of levels from ``n`` nodes to one: the octal digits of n - 1, none for a lone node."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, RUN)))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (RUN * WIDTH)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: _digest(F.substring(level, i * (RUN * WIDTH) + 1, F.lit(RUN * WIDTH)))), "").cast("binary")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, block, height, members, level0 ..): the blocks of ``nodes`` (tree, pos, hash, height) and their levels."""
    block = F.shiftright("pos", _BITS * HEIGHT).alias("block")
    found = nodes.groupBy("tree", block).agg(F.min("height").alias("height"), F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("members"))
    found = found.withColumn("level0", F.array_join("members.hash", "").cast("binary"))
    for k in range(HEIGHT):
        climbed = F.when(F.col("height") > k, _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}"))
        found = found.withColumn(f"level{k + 1}", climbed)
    members = F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in ("pos", *carried)]))
    return found.withColumn("members", members)


def _segments(place: Column, upper: Column) -> Column:
    """Sibling segments (pre, post) of the member at ``place`` of its block, then those of the block's root."""
    found = []
    for k in range(HEIGHT):
        own = F.shiftright(place, _BITS * k)
        first = F.shiftleft(F.shiftright(own, _BITS), _BITS)
        pre = F.substring(F.col(f"level{k}"), first * WIDTH + 1, (own - first) * WIDTH)
        post = F.substring(F.col(f"level{k}"), (own + 1) * WIDTH + 1, (first + RUN - 1 - own) * WIDTH)
        found.append(F.struct(pre.alias("pre"), post.alias("post")))
    return F.concat(F.slice(F.array(*found), 1, F.least(F.col("height"), F.lit(HEIGHT))), upper)


def climb(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of every round, and (tree, hash) of the trees' roots.

    ``nodes``: tree, pos, hash and the carried columns; places of a tree run from 0 without gaps.
    """
    sizes = stage(nodes.groupBy("tree").agg(levels_over(F.count("*")).alias("height")))
    highest = sizes.agg(F.max("height")).first()[0] or 0
    nodes, rounds, roots = nodes.join(sizes, "tree"), [], []
    for number in range(max(1, -(-highest // HEIGHT))):
        blocks = stage(_blocks(nodes, carried if not number else []))
        root = blocks.select("tree", F.col("block").alias("pos"), F.col(f"level{HEIGHT}").cast("string").alias("hash"), "height")
        rounds.append(blocks)
        roots.append(root.filter(F.col("height") <= HEIGHT).select("tree", "hash"))
        nodes = root.filter(F.col("height") > HEIGHT).withColumn("height", F.col("height") - HEIGHT)
    return rounds, reduce(DataFrame.unionByName, roots)


def with_segments(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The first round's blocks with ``upper``, the segments of each block's root; ``outer`` has (tree, upper) of the trees' roots."""
    above = None
    for blocks in reversed(rounds):
        done = blocks.filter(F.col("height") <= HEIGHT).join(outer, "tree")
        blocks = done if above is None else done.unionByName(blocks.filter(F.col("height") > HEIGHT).join(above, ["tree", "block"]))
        each = F.transform("members", lambda m: F.struct(m["pos"].alias("block"), _segments(_inside(m["pos"]), F.col("upper")).alias("upper")))
        above = blocks.select("tree", F.inline(each))
    return blocks


def _inside(pos: Column) -> Column:
    return F.pmod(pos, F.lit(RUN**HEIGHT)).cast("int")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = docs.select(*FIELDS)
    changed = leaf(tampered_text())
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree")
    rows = rows.select(tree, F.col("doc_id").cast("long"), leaf(F.col("text")).alias("hash"), changed.alias("changed"))
    rows = stage(rows.withColumn("changed", F.when(F.col("changed") != F.col("hash"), F.col("changed"))))
    rounds, subroots = climb(positions(rows, ["tree"], ["doc_id", "hash"]), ["doc_id", "changed"])
    subroots = stage(subroots)
    tops = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["tree"], ["name"])
    top_rounds, root = climb(tops, ["name"])
    none = F.array().cast("array<struct<pre:binary,post:binary>>")
    over = with_segments(top_rounds, root.select("tree", none.alias("upper")))
    each = F.transform("members", lambda m: F.struct(m["name"].alias("name"), _segments(_inside(m["pos"]), F.col("upper")).alias("upper")))
    over = over.select("tree", F.inline(each)).join(root.withColumnRenamed("hash", "root"), "tree").drop("tree")
    trees = stage(over.withColumnRenamed("name", "tree").join(subroots.withColumnRenamed("hash", "subroot"), "tree"))
    blocks = with_segments(rounds, trees.select("tree", "upper")).join(trees.select("tree", "subroot", "root"), "tree")

    own = F.transform(
        "members",
        lambda m: F.struct(
            m["doc_id"].alias("doc_id"),
            F.substring(F.col("level0"), _inside(m["pos"]) * WIDTH + 1, F.lit(WIDTH)).alias("leaf"),
            m["changed"].alias("changed"),
            _segments(_inside(m["pos"]), F.col("upper")).alias("segments"),
        ),
    )

    def result(m: Column) -> Column:
        proof = F.aggregate(m["segments"], F.lit("").cast("binary"), lambda s, x: F.concat(s, x["pre"], x["post"]))
        start = F.coalesce(m["changed"].cast("binary"), m["leaf"])
        folded = F.aggregate(m["segments"], start, lambda s, x: _digest(F.concat(x["pre"], s, x["post"])).cast("binary"))
        return F.struct(m["doc_id"].alias("doc_id"), m["leaf"].cast("string").alias("leaf"), _digest(proof).alias("proof_sha256"), folded.cast("string").alias("folded_root"))

    out = blocks.select("subroot", "root", F.inline(F.transform(own, result)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
