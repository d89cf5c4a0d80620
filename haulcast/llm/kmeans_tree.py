"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

Equal vectors are one class first, with its smallest vec_ids, so that a vector of any multiplicity is indexed
once. The tree's upper levels are fitted by k-means on a bounded sample (``max_sample`` classes); leaves that
get too many of the table's vectors are fitted further, each on a sample of its own (``fit_rows``), until a
leaf holds about ``leaf_rows``, or more once there are ``max_leaves`` leaves (the tree, at most that many
centres, is the one thing that is broadcast). Every vector of the table goes to a leaf.

A query walks the tree with a priority queue: it goes down to the nearest child, keeps the others by their
distance, and continues with the nearest kept one, leaf after leaf. How many leaves it opens is calibrated:
for a bounded number of the queries the true neighbours are found by comparison with every row, and
the visits are widened until the leaves opened hold the share ``recall`` of those neighbours; a query goes on
until its leaves hold enough vectors to answer. Neighbouring leaves share a task; a query is sent once
to a task, with the leaves it opens there. Large leaves and groups with many queries are dealt in blocks.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or infinity, and rows without vec_id,
take no part; vectors are compared with those of their own length; rows that repeat a vec_id are
rows of their own (a query's own row is left out, its repeats are not). Other columns are not read. Classes
are told apart by 128 hash bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.common import drop_staged, stage

BRANCH = 16
LEAF_ROWS = 256
MAX_SAMPLE = 16384
FIT_ROWS = 2048
MAX_LEAVES = 1 << 16
LLOYD = 8  # k-means rounds per node
CALIBRATE = 256  # queries whose neighbours are found by comparison with every row
RECALL = 0.97
GROUP_ROWS = 1 << 14  # vectors that a task gathers
PART_QUERIES = 1 << 15  # queries that a task gathers
TILE = 1024
SPARE = 4  # classes kept beyond those asked for, as products are rounded before they are compared exactly


class Tree:
    """Centres and children of the nodes; node 0 is the root, and leaves lie in the order of a walk."""

    def __init__(self, dim: int):
        self.dim, self.centres, self.children = dim, [np.zeros(dim)], {}

    def grow(self, node: int, rows: np.ndarray, target: float, rng) -> None:
        """Splits a node by k-means on ``rows`` until a leaf holds at most ``target`` of them."""
        todo = [(node, rows)]
        while todo:
            at, own = todo.pop()
            if len(own) <= max(target, 2):
                continue
            label, centres = kmeans(own, min(BRANCH, max(2, int(np.ceil(len(own) / max(target, 1))))), rng)
            if len(centres) < 2:
                continue
            self.children[at] = np.arange(len(self.centres), len(self.centres) + len(centres))
            self.centres.extend(centres)
            todo += [(int(child), own[label == k]) for k, child in enumerate(self.children[at])]

    def freeze(self) -> Tree:
        self.table = np.array(self.centres)
        self.square = (self.table**2).sum(1)
        return self

    def __getstate__(self) -> dict:
        """Without the list of centres, which only growing needs."""
        return {name: value for name, value in self.__dict__.items() if name != "centres"}

    def walk(self) -> list[int]:
        """Leaves in the order of a depth-first walk."""
        found, todo = [], [0]
        while todo:
            node = todo.pop()
            if node in self.children:
                todo.extend(self.children[node][::-1].tolist())
            else:
                found.append(node)
        return found

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row goes down to."""
        out, todo = np.zeros(len(rows), dtype=np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node not in self.children:
                out[own] = node
                continue
            kids = self.children[node]
            best = np.argmin(self.square[kids] - 2 * (rows[own] @ self.table[kids].T), axis=1)
            todo += [(int(kid), own[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def best_bins(self, row: np.ndarray) -> Iterator[int]:
        """Leaves, the nearest kept node first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while node in self.children:
                kids = self.children[node]
                away = self.square[kids] - 2 * (self.table[kids] @ row)
                nearest = int(np.argmin(away))
                for k, kid in enumerate(kids.tolist()):
                    if k != nearest:
                        heapq.heappush(queue, (float(away[k]), kid))
                node = int(kids[nearest])
            yield node


def kmeans(rows: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(label per row, centres) of at most ``k`` clusters, none of them empty."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(LLOYD):
        label = np.argmin((centres**2).sum(1) - 2 * (rows @ centres.T), axis=1)
        size = np.bincount(label, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, label, rows)
        centres = total[size > 0] / size[size > 0, None]
        label = (np.cumsum(size > 0) - 1)[label]
    return label, centres


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows by a power of two that brings their largest component near one, which changes no digit of a cosine."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None]) if len(rows) else rows


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows give equal results wherever they stand."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: components that are numbers, not all zero."""
    value = vector.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(value, lambda x: x != 0), F.lit(False))


def _with_leaf(tree, dim):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("leaf", pa.array(tree.value.leaf_of(_unit(_matrix(batch.column("v"), dim)))))

    return run


def _fitter(dim, target, seed):
    """Children of one over-full leaf, numbered within it: (leaf, at, up, centre), the leaf itself being 0."""

    def run(table: pa.Table) -> pa.Table:
        leaf, total = int(table["leaf"][0].as_py()), int(table["n"][0].as_py())
        sub = Tree(dim)
        rows = table.sort_by([("k1", "ascending"), ("k2", "ascending")])
        sub.grow(0, _unit(_matrix(rows["v"], dim)), target * len(table) / total, np.random.default_rng([seed, leaf]))
        at, up = np.concatenate(list(sub.children.values())) if sub.children else np.zeros(0, np.int64), np.repeat(list(sub.children), [len(c) for c in sub.children.values()]).astype(np.int64)
        return pa.table({"leaf": pa.array([leaf] * len(at), pa.int64()), "at": pa.array(at), "up": pa.array(up), "centre": pa.array([sub.centres[int(k)].tolist() for k in at], pa.list_(pa.float64()))})

    return run


def build(classes: DataFrame, dim: int, leaf_rows: int, max_sample: int, fit_rows: int, max_leaves: int, seed: int):
    """(tree as a broadcast, classes with their leaf, {leaf: classes in it})."""
    spark = classes.sparkSession
    n = classes.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(1 << 30))
    drawn = classes.filter(share < int((1 << 30) * min(1.0, max_sample / n))).select("k1", "k2", "v").collect()
    sample = _unit(np.array([r["v"] for r in sorted(drawn, key=lambda r: (r["k1"], r["k2"]))], dtype=np.float64).reshape(-1, dim))
    target = max(leaf_rows, n / max_leaves)
    tree, closed, index = Tree(dim), set(), None
    tree.grow(0, sample, max(target * len(sample) / n, 2), np.random.default_rng([seed, dim]))
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    while True:
        shared = spark.sparkContext.broadcast(tree.freeze())
        drop_staged(spark, *([index] if index is not None else []))
        index = stage(classes.mapInArrow(_with_leaf(shared, dim), f"{carried}, leaf long"))
        sizes = {leaf: rows for leaf, rows in index.groupBy("leaf").count().collect()}  # one row per leaf
        full = {k: m for k, m in sizes.items() if m > 4 * target and k not in closed}
        if not full or len(sizes) + BRANCH * len(full) > 2 * max_leaves:
            return shared, index, sizes
        over = spark.createDataFrame(list(full.items()), "leaf long, n long")
        own = index.join(over, "leaf").filter(share < F.lit(fit_rows << 30) / F.col("n"))
        closed |= set(full)
        for leaf, rows in _by_leaf(own.groupBy("leaf").applyInArrow(_fitter(dim, target, seed), "leaf long, at long, up long, centre array<double>").collect()):
            number = {0: leaf}
            for row in sorted(rows, key=lambda r: r["at"]):
                number[row["at"]] = len(tree.centres)
                tree.centres.append(np.array(row["centre"]))
                up = number[row["up"]]
                tree.children[up] = np.append(tree.children.get(up, np.zeros(0, np.int64)), number[row["at"]])


def _by_leaf(rows) -> list[tuple[int, list]]:
    found = {}
    for row in rows:
        found.setdefault(row["leaf"], []).append(row)
    return sorted(found.items())


def _exact(queries: np.ndarray, dim: int, keep: int):
    """The best classes of a partition for each calibration query: (query, score, leaf)."""

    def run(batches):
        best = np.full((len(queries), keep), -np.inf)
        at = np.zeros((len(queries), keep), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, leaf = _unit(_matrix(batch.column("v"), dim)), batch.column("leaf").to_numpy()
            for i in range(0, len(rows), 4 * TILE):
                score = np.concatenate([best, queries @ rows[i : i + 4 * TILE].T], axis=1)
                place = np.concatenate([at, np.broadcast_to(leaf[i : i + 4 * TILE], (len(queries), score.shape[1] - keep))], axis=1)
                top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                best, at = np.take_along_axis(score, top, 1), np.take_along_axis(place, top, 1)
        q, k = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, k]), pa.array(at[q, k])], names=["query", "score", "leaf"])

    return run


def calibrated_visits(tree: Tree, index: DataFrame, queries: DataFrame, dim: int, keep: int, recall: float, calibrate: int, seed: int) -> int:
    """Leaves to open so that a drawn set of queries finds the share ``recall`` of its true neighbours."""
    n = queries.count()
    share = F.pmod(F.xxhash64(F.lit(seed + 1), "k1", "k2"), F.lit(1 << 30))
    rows = np.array([r[0] for r in queries.filter(share < int((1 << 30) * min(1.0, calibrate / n))).select("v").collect()], dtype=np.float64)
    rows = _unit(rows.reshape(-1, dim)) if len(rows) else rows.reshape(-1, dim)
    if not len(rows):
        rows = _unit(np.array([queries.select("v").first()[0]], dtype=np.float64))
    near = index.select("v", "leaf").mapInArrow(_exact(rows, dim, keep), "query long, score double, leaf long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "leaf")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("query", "leaf").collect()
    wanted = [[] for _ in rows]
    for query, leaf in near:
        wanted[query].append(leaf)
    walks, opened, visits = [tree.best_bins(row) for row in rows], [set() for _ in rows], 0
    leaves = len(tree.walk())
    while visits < leaves:
        step = max(1, visits // 4)  # widened by a quarter at a time
        for walk, seen in zip(walks, opened):
            seen.update(leaf for _, leaf in zip(range(step), walk))
        visits += step
        hits = sum(leaf in seen for seen, own in zip(opened, wanted) for leaf in own)
        if hits >= recall * sum(map(len, wanted)):
            break
    return min(visits, leaves)


def _groups(order: list[int], sizes: dict[int, int], group_rows: int) -> dict[int, tuple[int, int]]:
    """{leaf: (group, blocks)}: neighbouring leaves share a group of about ``group_rows``; larger leaves have blocks."""
    found, group, held = {}, 0, 0
    for leaf in order:
        n = sizes.get(leaf, 0)
        if not n:
            continue
        if held and held + n > group_rows:
            group, held = group + 1, 0
        found[leaf] = (group, max(1, -(-n // group_rows)))
        held += n
    return found


def _router(tree, dim, visits, sizes, place, keep):
    """The groups a query goes to and the leaves it opens there."""

    def run(batches):
        for batch in batches:
            out, at = {"group": [], "block": [], "leaves": []}, []
            for i, row in enumerate(_unit(_matrix(batch.column("v"), dim))):
                opened, rows, own = 0, 0, {}
                for leaf in tree.value.best_bins(row):
                    if opened >= visits and rows >= keep:
                        break
                    opened += 1
                    if leaf in place:
                        rows += sizes[leaf]
                        own.setdefault(place[leaf][0], []).append(leaf)
                for group, leaves in own.items():
                    for block in range(max(place[leaf][1] for leaf in leaves)):
                        at.append(i)
                        for name, value in zip(out, (group, block, leaves)):
                            out[name].append(value)
            take = pa.array(at, pa.int64())
            columns = [pa.array(out["group"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["leaves"], pa.list_(pa.int64())), *(batch.column(c).take(take) for c in ("k1", "k2", "v"))]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "block", "leaves", "k1", "k2", "v"])

    return run


def _searcher(dim, keep):
    """A task's best classes for each of its queries: (q1, q2, k1, k2, ids, score)."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        kept = {"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)}
        if index.num_rows and queries.num_rows:
            index = index.sort_by("leaf")
            original, asked = _matrix(index["v"], dim), _matrix(queries["v"], dim)
            rows, wanted, leaf = _unit(original), _unit(asked), index["leaf"].to_numpy()
            opened = queries["leaves"].combine_chunks()
            owner = np.repeat(np.arange(queries.num_rows), opened.value_lengths().to_numpy())
            flat = opened.flatten().to_numpy()
            width = keep + SPARE
            best, at = np.full((queries.num_rows, width), -np.inf), np.zeros((queries.num_rows, width), dtype=np.int64)
            for k in np.unique(leaf):
                low, high = np.searchsorted(leaf, [k, k + 1])
                visitors = owner[flat == k]
                for i in range(0, len(visitors), TILE):
                    q = visitors[i : i + TILE]
                    for j in range(low, high, 4 * TILE):
                        own = np.arange(j, min(high, j + 4 * TILE))
                        score = np.concatenate([best[q], wanted[q] @ rows[own].T], axis=1)
                        place = np.concatenate([at[q], np.broadcast_to(own, (len(q), len(own)))], axis=1)
                        top = np.argpartition(-score, width - 1, axis=1)[:, :width]
                        best[q], at[q] = np.take_along_axis(score, top, 1), np.take_along_axis(place, top, 1)
            q, k = np.nonzero(best > -np.inf)
            kept = {"q": q, "c": at[q, k]}
            score = cosines(asked[q], original[kept["c"]])
        else:
            score = np.zeros(0)
        own, other = queries.take(pa.array(kept["q"])), index.take(pa.array(kept["c"]))
        return pa.table({"q1": own["k1"], "q2": own["k2"], "k1": other["k1"], "k2": other["k2"], "ids": other["ids"], "score": score})

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    recall: float = RECALL,
    leaf_rows: int = LEAF_ROWS,
    max_sample: int = MAX_SAMPLE,
    fit_rows: int = FIT_ROWS,
    max_leaves: int = MAX_LEAVES,
    calibrate: int = CALIBRATE,
    group_rows: int = GROUP_ROWS,
    part_queries: int = PART_QUERIES,
    seed: int = 7,
) -> DataFrame:
    """Per query row (``is_query``, of vec_id) its ``k`` nearest rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = stage(rows.select("vec_id", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"), "v"))
    keep = k + 1  # a query's own row may be among them
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= keep)
    classes = stage(few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    asking = stage(rows.filter(is_query).select("vec_id", "k1", "k2"))
    wanted = classes.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v")
    wanted = stage(wanted)
    found = []
    for (dim,) in wanted.select(F.size("v")).distinct().collect():
        own, queries = (t.filter(F.size("v") == dim) for t in (classes, wanted))
        tree, index, sizes = build(own, dim, leaf_rows, max_sample, fit_rows, max_leaves, seed)
        visits = calibrated_visits(tree.value, index, queries, dim, keep, recall, calibrate, seed)
        groups = _groups(tree.value.walk(), sizes, group_rows)
        kind = queries.schema["v"].dataType.simpleString()
        routed = stage(queries.mapInArrow(_router(tree, dim, visits, sizes, groups, keep), f"group long, block long, leaves array<long>, k1 long, k2 long, v {kind}"))
        parts = stage(routed.groupBy("group", "block").agg(F.ceil(F.count("*") / part_queries).alias("parts")))
        leaves = spark.createDataFrame([(leaf, *at) for leaf, at in groups.items()], "leaf long, group long, blocks long")
        dealt = index.join(leaves, "leaf").withColumn("block", F.pmod("k1", "blocks")).join(parts, ["group", "block"])
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        routed = routed.join(parts, ["group", "block"]).withColumn("part", F.pmod("k2", "parts"))
        key = ["group", "block", "part"]
        sides = dealt.select(*key, "leaf", "k1", "k2", "ids", "v").groupBy(*key).cogroup(routed.select(*key, "leaves", "k1", "k2", "v").groupBy(*key))
        schema = "q1 long, q2 long, k1 long, k2 long, ids array<long>, score double"
        found.append(sides.applyInArrow(_searcher(dim, keep), schema))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = found[0]
    for other in found[1:]:
        near = near.unionByName(other)
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0], "k1", "k2")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    same = (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id"), same.alias("own")))
    near = stage(near.groupBy("q1", "q2").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("near")))
    rows = asking.join(near, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")))
    itself = F.array_position(F.transform("near", lambda x: x["own"] & (x["id"] == F.col("vec_id"))), True)
    rows = rows.select(F.col("vec_id").alias("query_id"), "near", itself.alias("itself"))
    rows = rows.select("query_id", F.slice(F.filter("near", lambda x, i: i + 1 != F.col("itself")), 1, k).alias("near"))
    rows = rows.select("query_id", F.posexplode("near").alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
