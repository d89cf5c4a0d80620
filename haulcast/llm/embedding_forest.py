"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Equal vectors are one class first (told apart by 128 hash bits), so a vector of any multiplicity is
compared once. A tree splits recursively: a node projects its vectors on a random direction and cuts at
their median; vectors close to the cut go to both sides (spill). The upper levels of every tree are
fitted on a bounded sample (``max_sample`` vectors), only as far down as nodes hold more than
``node_rows`` vectors, and are plain thresholds; every vector of the table goes down all trees. Nodes that
still get more are fitted further, each on a sample of its own, so a task holds a bounded number; it goes
on splitting by the same rule on the vectors themselves. Spill at the upper levels copies vectors through
the shuffle and is narrow (``spill``); inside a task it is wider (``local_spill``). Vectors travel as they
are stored, a few trees per round. Inside leaves of up to ``leaf`` vectors all pairs are compared in
double precision; pairs of several trees are kept once, and linked classes are joined to components.

A group of near copies lies inside the spill and does not split. Such a crowded leaf is dealt out as
pairs of row blocks, one task each. Of two vectors that share crowded leaves the first such leaf alone
counts the link; a task returns link counts per vector and a spanning forest, never the pairs.

Defined results: vectors that are null, zero, or hold a null, NaN or infinity link with nothing;
vectors of different lengths never link; a row without vec_id links with nothing and has no
component; rows that repeat a vec_id count as vectors of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import components, local_roots, stage
from haulcast.llm.texthash import mix

TREES = 8
ROUND_TREES = 4  # trees whose nodes are shuffled together
LEAF = 128
SPILL = 0.01  # cosine-scale distance from the cut inside which a vector goes to both sides
LOCAL_SPILL = 0.015  # the same at the levels below, which a task splits itself
MAX_SAMPLE = 16384
SAMPLE_LEAF = 32  # sample vectors of a node under which the fitted levels end
MAX_DEPTH = 40
NODE_ROWS = 8192  # vectors that a task gathers before it splits them itself
FIT_ROWS = 1024  # vectors on which an over-full node is fitted further
LAST_NODE = 1 << 60
SPLITS = 0.7  # share of a node's vectors on its larger side from which it counts as not split; beyond, copies outgrow what a split saves
BLOCK = 4096  # vectors of a crowded leaf on either side of one task
TILE = 1024


def _direction(seed: int, tree: int, node: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([seed, tree, node % (1 << 62), dim]).normal(size=dim)
    return v / np.linalg.norm(v)


def fit_tree(sample: np.ndarray, tree: int, seed: int, least: int = SAMPLE_LEAF, spill: float = SPILL, node: int = 1) -> dict[int, float]:
    """Cut of every inner node of a tree's fitted levels; node k has children 2k and 2k + 1."""
    cuts, open_nodes = {}, [(node, sample)]
    while open_nodes:
        node, rows = open_nodes.pop()
        if len(rows) < 2 * least or node >= LAST_NODE:
            continue
        at = rows @ _direction(seed, tree, node, sample.shape[1])
        cut = float(np.median(at))
        if not (at < cut).any() or max((at < cut + spill).sum(), (at >= cut - spill).sum()) >= SPLITS * len(rows):
            continue
        cuts[node] = cut
        open_nodes += [(2 * node, rows[at < cut]), (2 * node + 1, rows[at >= cut])]
    return cuts


def descend(rows: np.ndarray, cuts: dict[int, float], tree: int, seed: int, spill: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions) of the rows that reach it; rows near a cut reach both sides."""
    open_nodes = [(1, np.arange(len(rows)))]
    while open_nodes:
        node, own = open_nodes.pop()
        if node not in cuts or not len(own):
            if len(own):
                yield node, own
            continue
        at = rows[own] @ _direction(seed, tree, node, rows.shape[1])
        open_nodes += [(2 * node, own[at < cuts[node] + spill]), (2 * node + 1, own[at >= cuts[node] - spill])]


def leaves(rows: np.ndarray, node: int, tree: int, seed: int, leaf: int, spill: float) -> Iterator[tuple[int, np.ndarray]]:
    """(node, positions) of a node split down to leaves of ``leaf`` vectors, or of more where it does not split."""
    open_nodes = [(node, np.arange(len(rows)), 0)]
    while open_nodes:
        at_node, own, depth = open_nodes.pop()
        if len(own) > leaf and depth < MAX_DEPTH:
            at = rows[own] @ _direction(seed, tree, at_node, rows.shape[1])
            cut = np.median(at)
            low, high = own[at < cut + spill], own[at >= cut - spill]
            if max(len(low), len(high)) < SPLITS * len(own):
                open_nodes += [(2 * at_node, low, depth + 1), (2 * at_node + 1, high, depth + 1)]
                continue
        yield at_node, own


def leaf_id(tree: int, node: int, dim: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{dim}/{tree}/{node}".encode(), digest_size=8).digest(), "big") >> 1


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as stored to unit vectors in double precision."""
    return _unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Scaled by a power of two first, so squares neither overflow nor vanish."""
    if len(rows):
        rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows


def _named(batches):
    """Rows with two hashes of their unit vector; those that link with nothing lose their vector."""
    for batch in batches:
        column = batch.column("v")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
        start = np.cumsum(lengths) - lengths
        good, names = np.zeros(len(lengths), dtype=bool), np.zeros((2, len(lengths)), dtype=np.uint64)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == dim)
            rows = values[start[own][:, None] + np.arange(dim)]
            fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            own, bits = own[fine], (_unit(rows[fine]) + 0.0).view(np.uint64)
            good[own] = True
            for k in range(2):
                names[k, own] = mix(bits + mix(np.arange(dim, dtype=np.uint64), 300 + k), 400 + k).sum(axis=1, dtype=np.uint64)
        good &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        kept = pa.array(good)
        hashes = [pa.array(x.view(np.int64), mask=~good) for x in names]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), *hashes, pc.if_else(kept, column, pa.scalar(None, column.type))], names=["vec_id", "row", "u1", "u2", "v"])


def _counter(forest, dim, seed, spill):
    """Vectors per node, of one batch."""

    def run(batches):
        for batch in batches:
            rows = _units(batch.column("v"), dim)
            found = [(tree, node, len(own)) for tree, cuts in enumerate(forest) for node, own in descend(rows, cuts, tree, seed, spill)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))], names=["tree", "node", "n"])

    return run


def _descender(forest, dim, seed, spill, shares=None, closed=frozenset(), trees=None):
    """Vectors at the nodes they reach: at all that are not closed, or the given share at the nodes of ``shares``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _units(batch.column("v"), dim)
            draw = mix(batch.column("rep").to_numpy().astype(np.uint64), seed) / 2.0**64
            for tree in range(len(forest)) if trees is None else trees:
                for node, own in descend(rows, forest[tree], tree, seed, spill):
                    if shares is not None:
                        own = own[draw[own] < shares.get((tree, node), 0)]
                    if (tree, node) in closed or not len(own):
                        continue
                    at = pa.array(own)
                    columns = [pa.array(np.full(len(own), tree, np.int32)), pa.array(np.full(len(own), node)), batch.column("rep").take(at), batch.column("v").take(at)]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "rep", "v"])

    return run


def _fitter(dim, seed, spill):
    def run(table: pa.Table) -> pa.Table:
        tree, node = int(table["tree"][0].as_py()), int(table["node"][0].as_py())
        cuts = fit_tree(_units(table["v"].combine_chunks(), dim), tree, seed, spill=spill, node=node) or {node: float("nan")}
        return pa.table({"tree": pa.array([tree] * len(cuts), pa.int32()), "node": list(cuts), "cut": list(cuts.values())})

    return run


def _at_node(own: DataFrame) -> str:
    return f"tree int, node long, rep long, v {own.schema['v'].dataType.simpleString()}"


def grow(own: DataFrame, forest: list[dict[int, float]], dim: int, seed: int, spill: float, node_rows: int) -> set[tuple[int, int]]:
    """Fits over-full nodes further, in place, until each holds ``node_rows`` vectors; returns those that do not split."""
    closed, rounds = set(), 0
    while True:
        counts = own.mapInArrow(_counter(forest, dim, seed, spill), "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
        full = {(t, k): n for t, k, n in counts.filter(F.col("n") > node_rows).collect() if (t, k) not in closed}
        rounds += 1
        closed |= {key for key in full if rounds > MAX_DEPTH}
        if not full or rounds > MAX_DEPTH:
            return closed
        shares = {key: FIT_ROWS / n for key, n in full.items()}
        drawn = own.mapInArrow(_descender(forest, dim, seed, spill, shares), _at_node(own))
        for tree, node, cut in drawn.groupBy("tree", "node").applyInArrow(_fitter(dim, seed, spill), "tree int, node long, cut double").collect():
            if cut == cut:
                forest[tree][node] = cut
            else:
                closed.add((tree, node))


def _leaf(dim, seed, cosine, leaf, spill):
    """Linked pairs (a, b) of a node's small leaves, and the vectors (a) of its crowded ones."""

    def run(table: pa.Table) -> pa.Table:
        rows = _units(table["v"].combine_chunks(), dim)
        ids = table["rep"].to_numpy()
        node, tree = int(table["node"][0].as_py()), int(table["tree"][0].as_py())
        found, crowded = [np.zeros((2, 0), dtype=np.int64)], [np.zeros((2, 0), dtype=np.int64)]
        for at_node, own in leaves(rows, node, tree, seed, leaf, spill):
            if len(own) > leaf:
                crowded.append(np.stack([ids[own], np.full(len(own), leaf_id(tree, at_node, dim))]))
                continue
            a, b = np.nonzero(np.triu(rows[own] @ rows[own].T >= cosine, 1))
            if len(a):
                found.append(np.sort(np.stack([ids[own[a]], ids[own[b]]]), axis=0))
        pairs, members = np.unique(np.concatenate(found, axis=1), axis=1), np.concatenate(crowded, axis=1)
        n, m = pairs.shape[1], members.shape[1]
        b, at = np.append(pairs[1], np.zeros(m, np.int64)), np.append(np.zeros(n, np.int64), members[1])
        kind = np.arange(n + m) >= n
        return pa.table({"a": np.append(pairs[0], members[0]), "b": pa.array(b, mask=kind), "leaf": pa.array(at, mask=~kind)})

    return run


def _block_links(cosine):
    """Links (a, links) that a pair of blocks of a crowded leaf counts, and edges (a, b) of their spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        here = int(table["leaf"][0].as_py())
        parts, earlier = [], {}
        for side in (0, 1):
            part = table.filter(pa.array(table["side"].to_numpy() == side))
            lists = [[x for x in own if x < here] for own in part["leaves"].to_pylist()]
            for own in lists:
                for x in own:
                    earlier.setdefault(x, len(earlier))
            unit = part["v"].combine_chunks()
            rows = _units(unit, len(unit[0]) if len(unit) else 1)
            parts.append((rows, part["rep"].to_numpy(), part["copies"].to_numpy(), lists))
        same = table["i"][0].as_py() == table["j"][0].as_py()
        if same:
            parts[1] = parts[0]
        (x, ids_x, copies_x, lists_x), (y, ids_y, copies_y, lists_y) = parts

        def marks(lists):
            out = np.zeros((len(lists), len(earlier)), np.float32)
            for k, own in enumerate(lists):
                out[k, [earlier[v] for v in own]] = 1
            return out

        links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        edges = [np.zeros((2, 0), dtype=np.int64)]
        for i in range(0, len(x), TILE):
            marks_x = marks(lists_x[i : i + TILE])
            for j in range(i if same else 0, len(y), TILE):
                owned = (x[i : i + TILE] @ y[j : j + TILE].T >= cosine) & ~(marks_x @ marks(lists_y[j : j + TILE]).T > 0)
                if same and i == j:
                    owned = np.triu(owned, 1)
                links_x[i : i + TILE] += owned @ copies_y[j : j + TILE]
                links_y[j : j + TILE] += owned.T @ copies_x[i : i + TILE]
                a, b = np.nonzero(owned)
                if len(a):
                    node, root = local_roots(ids_x[i + a], ids_y[j + b])
                    edges.append(np.stack([node, root])[:, node != root])
        edges = np.concatenate(edges, axis=1)
        if edges.shape[1]:
            node, root = local_roots(*edges)
            edges = np.stack([root, node])[:, node != root]
        ids, links = np.append(ids_x, ids_y), np.append(links_x, links_y)
        ids, links = ids[links > 0], links[links > 0]
        kind = np.arange(edges.shape[1] + len(ids)) >= edges.shape[1]
        b, n = np.append(edges[1], np.zeros(len(ids), np.int64)), np.append(np.zeros(edges.shape[1], np.int64), links)
        return pa.table({"a": np.append(edges[0], ids), "b": pa.array(b, mask=kind), "links": pa.array(n, mask=~kind)})

    return run


def crowded_links(crowded: DataFrame, lists: DataFrame, classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(a, b, links) of the crowded leaves' members (rep, leaf): link counts per vector and edges of spanning forests."""
    first = F.col("leaves")[0]
    placed = crowded.join(lists, "rep")
    # vectors that meet in the same earlier leaf already need not meet again: where many do, they get blocks of their own
    sizes = placed.groupBy("leaf", first.alias("first")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("part", F.when((F.col("first") == F.col("leaf")) | (F.col("n") >= block), F.col("first")).otherwise(-1))
    total = sizes.groupBy("leaf", "part").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    sizes = stage(sizes.join(total, ["leaf", "part"]).select("leaf", "first", "part", "blocks"))
    placed = placed.withColumn("first", first).join(sizes, ["leaf", "first"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    placed = placed.select("leaf", "part", "block", "rep", "leaves").join(classes, "rep")
    blocks = sizes.select("leaf", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).distinct()
    name = F.struct("part", "block")
    left, right = (blocks.select("leaf", name.alias(side)) for side in "ij")
    met = stage(left.join(right, "leaf").filter("i <= j and (i.part <> j.part or i.part = leaf or i.part = -1)"))
    sides = [placed.withColumn(s, name).join(met if s == "i" else met.filter("i <> j"), ["leaf", s]).select("leaf", "i", "j", F.lit(k).alias("side"), "rep", "copies", "leaves", "v") for k, s in enumerate("ij")]
    return sides[0].unionByName(sides[1]).groupBy("leaf", "i", "j").applyInArrow(_block_links(cosine), "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.9,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    local_spill: float = LOCAL_SPILL,
    max_sample: int = MAX_SAMPLE,
    seed: int = 11,
    node_rows: int = NODE_ROWS,
    block: int = BLOCK,
    round_trees: int = ROUND_TREES,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("embedding").alias("v"))
    rows = stage(rows.mapInArrow(_named, f"vec_id long, row long, u1 long, u2 long, v {rows.schema['v'].dataType.simpleString()}"))
    equal = rows.filter("v is not null").groupBy("u1", "u2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    equal = stage(equal)
    classes = rows.join(equal.select(F.col("rep").alias("row"), "rep", "copies"), "row").select("rep", "copies", "v")
    classes = stage(classes)
    members = rows.select("vec_id", "row", "u1", "u2").join(equal, ["u1", "u2"], "left").select("vec_id", "row", "copies", F.coalesce("rep", "row").alias("rep"))
    found = spark.createDataFrame([], "a long, b long, leaf long")
    for (dim,) in classes.select(F.size("v")).distinct().collect():
        own = classes.filter(F.size("v") == dim)
        n = own.count()
        draw = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_sample / n))
        sample = own.filter(draw).select("v").orderBy("v").collect()
        sample = _units(pa.array([r[0] for r in sample], pa.list_(pa.float64())), dim)
        # a node is split where it is to hold more than three quarters of what a task may gather
        least = max(SAMPLE_LEAF, -(-3 * node_rows * len(sample) // (8 * n)))
        forest = [fit_tree(sample, t, seed, least, spill) for t in range(trees)]
        dealt = own.select("rep", "v").repartition("rep")
        closed = grow(own, forest, dim, seed, spill, node_rows) if n > node_rows else set()
        if closed:
            inside = dealt.mapInArrow(_descender(forest, dim, seed, spill, dict.fromkeys(closed, 2.0)), _at_node(own))
            named = spark.createDataFrame([(t, k, leaf_id(t, k, dim)) for t, k in sorted(closed)], "tree int, node long, leaf long")
            inside = inside.drop("v").join(named, ["tree", "node"])
            found = found.unionByName(stage(inside.select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "leaf")))
        for first in range(0, trees, round_trees):
            own_trees = range(first, min(trees, first + round_trees))
            spread = dealt.mapInArrow(_descender(forest, dim, seed, spill, closed=closed, trees=own_trees), _at_node(own))
            met = spread.groupBy("tree", "node").applyInArrow(_leaf(dim, seed, cosine, leaf, local_spill), "a long, b long, leaf long")
            found = found.unionByName(stage(met.distinct()))
    found = stage(found.distinct())
    pairs, crowded = found.filter("leaf is null").select("a", "b"), found.filter("leaf is not null").select(F.col("a").alias("rep"), "leaf")
    counted = spark.createDataFrame([], "a long, b long, links long")
    if not crowded.isEmpty():
        lists = stage(crowded.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")))
        ends = [lists.select(F.col("rep").alias(c), F.col("leaves").alias(f"{c}_leaves")) for c in "ab"]
        # the link of vectors that share a crowded leaf is counted there
        pairs = stage(pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(~F.coalesce(F.arrays_overlap("a_leaves", "b_leaves"), F.lit(False))).select("a", "b"))
        counted = stage(crowded_links(crowded, lists, classes, cosine, block))
    roots = components(pairs.union(counted.filter("links is null").select("a", "b")))
    weight = classes.select(F.col("rep").alias("other"), F.col("copies").alias("weight"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    links = both.join(weight, "other").select("rep", "weight").union(counted.filter("links is not null").select("a", "links"))
    links = links.groupBy("rep").agg(F.sum("weight").alias("others"))
    joined = members.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.withColumn("root", F.coalesce("root", "rep"))
    joined = joined.withColumn("n_links", F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0)))
    smallest = joined.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(smallest, "root").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
