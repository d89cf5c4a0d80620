"""Density clusters of positions (DBSCAN), exact, on a grid of cells.

Points at one place become one weighted location first, so a place that holds a third of all
points is one row. The grid's cells are a little smaller than eps / sqrt(2): two locations of a cell
are neighbours, and neighbours are at most two cells apart. Hence

* all locations of a cell of at least ``min_points`` points are core;
* the others are fewer than ``min_points`` to a cell; only they are compared with the locations
  around them, which are dealt over blocks where a cell is full;
* core locations of a cell belong together, so components are sought over cells. Whether two cells
  touch is decided by boxes that are halved level by level: a pair of boxes entirely within eps
  links its cells, one entirely beyond it goes, the rest is halved again. No two full cells are
  compared location by location.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.session import cut_lineage

CELL_SHARE = 0.7  # cell side over eps: below 1 / sqrt(2) by more than rounding can undo
REACH = 2  # cells between neighbours, in either direction
BLOCK = 4096  # locations of a cell that one block compares
FINEST = 20  # halvings of a cell; box pairs still open after them are compared location by location


def _cell(eps: float) -> Column:
    side = eps * CELL_SHARE
    return F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))


def _around() -> Column:
    offsets = [(dx, dy) for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1)]
    return F.array(*[F.struct((F.col("cell.cx") + dx).alias("cx"), (F.col("cell.cy") + dy).alias("cy")) for dx, dy in offsets])


def _within(eps: float, a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return dx * dx + dy * dy <= F.lit(eps * eps)


def neighbours_of(sparse: DataFrame, dense: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """Pairs ``a`` of ``sparse`` and ``b`` of ``dense`` within eps, both as structs of their columns.

    Both sides have x, y and cell. A row of ``sparse`` is sent to every block of the cells around
    it; a cell has one block per ``block`` of its rows in ``dense``.
    """
    blocks = dense.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    dealt = dense.join(blocks, "cell").select(
        "cell",
        F.pmod(F.xxhash64("x", "y"), F.col("_blocks")).alias("_block"),
        F.struct(*[F.col(c) for c in dense.columns]).alias("b"),
    )
    asked = (
        sparse.select(F.struct(*[F.col(c) for c in sparse.columns]).alias("a"), F.explode(_around()).alias("cell"))
        .join(blocks, "cell")
        .select("a", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    )
    return asked.join(dealt, ["cell", "_block"]).where(_within(eps, "a", "b")).select("a", "b")


def locations(points: DataFrame, eps: float) -> DataFrame:
    """One row per place (x, y, cell): its points and the smallest id; impossible places are left out."""
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(math.inf)) & ~F.isnan(c) for c in ("x", "y")]
    # adding zero makes the two zeros one place
    places = points.where(finite[0] & finite[1]).select((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), "id")
    grouped = places.groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))
    return grouped.withColumn("cell", _cell(eps))


def core_locations(places: DataFrame, eps: float, min_points: int, block: int = BLOCK) -> DataFrame:
    """``places`` with a flag ``is_core``: at least ``min_points`` points within eps, its own included."""
    weights = places.groupBy("cell").agg(F.sum("weight").alias("_cell_weight"))
    known = places.join(weights, "cell").withColumn("_full", F.col("_cell_weight") >= min_points)
    sparse = known.where(~F.col("_full")).select("x", "y", "cell")
    counted = (
        neighbours_of(sparse, places.select("x", "y", "cell", "weight"), eps, block)
        .groupBy(F.col("a.x").alias("x"), F.col("a.y").alias("y"))
        .agg(F.sum("b.weight").alias("_around"))
    )
    return known.join(counted, ["x", "y"], "left").select(
        "x",
        "y",
        "cell",
        "weight",
        "first_id",
        (F.col("_full") | (F.coalesce(F.col("_around"), F.lit(0)) >= min_points)).alias("is_core"),
    )


def _numbered(core: DataFrame, eps: float, level: int) -> DataFrame:
    """Core locations with the number (px, py) of their box within the cell after ``level`` halvings.

    All levels are shifts of one integer grid, so a box lies in exactly one box of the level above.
    """

    def part(at: str, cell: str) -> Column:
        fine = F.floor(F.col(at) / (eps * CELL_SHARE) * float(1 << FINEST))
        return F.shiftright(fine, FINEST - level) - F.shiftleft(F.col(f"cell.{cell}"), level)

    return core.select("cell", "x", "y", part("x", "cx").alias("px"), part("y", "cy").alias("py"))


def _boxes(core: DataFrame, eps: float, level: int) -> DataFrame:
    """Tight boxes of the core locations at one level; past the finest one each location is a box."""
    if level > FINEST:
        ends = [F.col(c[0]).alias(c) for c in ("x0", "x1", "y0", "y1")]
        return _numbered(core, eps, FINEST).select("cell", "px", "py", *ends)
    return _numbered(core, eps, level).groupBy("cell", "px", "py").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def _side(box: DataFrame, name: str) -> DataFrame:
    fields = F.struct("px", "py", "x0", "x1", "y0", "y1").alias(name)
    return box.select(F.col("cell").alias(f"cell_{name}"), fields)


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Box pairs that may hold neighbours, with a flag for those that surely do."""

    def gap(low: str, high: str) -> Column:
        apart = F.greatest(F.col(f"b.{low}") - F.col(f"a.{high}"), F.col(f"a.{low}") - F.col(f"b.{high}"))
        return F.greatest(apart, F.lit(0.0))

    def span(low: str, high: str) -> Column:
        return F.greatest(F.col(f"b.{high}") - F.col(f"a.{low}"), F.col(f"a.{high}") - F.col(f"b.{low}"))

    limit = F.lit(eps * eps)
    near = gap("x0", "x1") * gap("x0", "x1") + gap("y0", "y1") * gap("y0", "y1") <= limit
    far = span("x0", "x1") * span("x0", "x1") + span("y0", "y1") * span("y0", "y1") <= limit
    return pairs.where(near).withColumn("linked", far)


def cell_links(core: DataFrame, eps: float) -> DataFrame:
    """Pairs (cell_a < cell_b) of cells that hold two core locations within eps of each other."""
    whole = _boxes(core, eps, 0)
    other = _side(whole, "b").withColumnRenamed("cell_b", "_other")
    met = (
        _side(whole, "a")
        .withColumn("cell", F.col("cell_a"))
        .withColumn("_other", F.explode(_around()))
        .where(F.col("_other") > F.col("cell_a"))
        .join(other, "_other")
        .select("cell_a", F.col("_other").alias("cell_b"), "a", "b")
    )
    judged = cut_lineage(_judged(met, eps))
    links = judged.where("linked").select("cell_a", "cell_b")
    pending = judged.where(~F.col("linked"))
    level = 0
    while not pending.isEmpty():
        level += 1
        near_cells = pending.select(F.explode(F.array("cell_a", "cell_b")).alias("cell")).distinct()
        fine = _boxes(core, eps, level).join(near_cells, "cell", "left_semi")
        up = 1 if level <= FINEST else 0

        def parts(name: str, of: DataFrame, up: int) -> DataFrame:
            keys = [F.shiftright(F.col(f"{name}.{k}"), up).alias(f"{k}_{name}") for k in ("px", "py")]
            return of.select("*", *keys)

        parents = parts("b", parts("a", pending, 0), 0).drop("a", "b", "linked")
        halves = parents.join(parts("a", _side(fine, "a"), up), ["cell_a", "px_a", "py_a"]).join(
            parts("b", _side(fine, "b"), up), ["cell_b", "px_b", "py_b"]
        )
        judged = cut_lineage(_judged(halves.select("cell_a", "cell_b", "a", "b"), eps))
        found = judged.where("linked").select("cell_a", "cell_b").distinct()
        links = links.unionByName(found)
        pending = judged.where(~F.col("linked")).join(found, ["cell_a", "cell_b"], "left_anti")
    return links


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and the smallest node reachable over ``links`` (a, b) as ``root``; ``nodes`` has one column.

    Large-star and small-star steps in turn: every node points to the smallest neighbour it knows
    until only stars are left, in a number of rounds that grows with the logarithm of a chain.
    """
    name = nodes.columns[0]
    edges = cut_lineage(links.toDF("a", "b").where(F.col("a") != F.col("b")).distinct())
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where(F.col("a") != F.col("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = cut_lineage(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    roots = edges.groupBy(F.col("a").alias(name)).agg(F.min("b").alias("_root"))
    return nodes.join(roots, name, "left").select(name, F.coalesce("_root", name).alias("root"))


def density_clusters(points: DataFrame, eps: float, min_points: int, block: int = BLOCK) -> DataFrame:
    """``id``, ``cluster_id`` and ``is_core`` of every row of ``points`` (id, x, y).

    A cluster is named by the smallest id among its core points. A border point within eps of
    several clusters goes to the one with the smallest name. Noise, and points without finite
    coordinates, have no cluster. Distances are plane ones: project positions before.
    """
    if eps <= 0 or min_points < 1:
        raise ValueError("eps must be positive and min_points at least one")
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = cut_lineage(core_locations(cut_lineage(locations(points, eps)), eps, min_points, block))
    core = places.where("is_core")
    cells = core.groupBy("cell").agg(F.min("first_id").alias("_first"))
    rooted = components(cells.select("cell"), cell_links(core, eps)).join(cells, "cell")
    names = rooted.groupBy("root").agg(F.min("_first").alias("cluster_id"))
    named = cut_lineage(rooted.join(names, "root").select("cell", "cluster_id"))
    core_named = core.join(named, "cell").select("x", "y", "cell", "cluster_id")
    border = (
        neighbours_of(places.where(~F.col("is_core")).select("x", "y", "cell"), core_named, eps, block)
        .groupBy(F.col("a.x").alias("x"), F.col("a.y").alias("y"))
        .agg(F.min("b.cluster_id").alias("cluster_id"))
    )
    labels = core_named.select("x", "y", "cluster_id", F.lit(True).alias("is_core")).unionByName(
        border.withColumn("is_core", F.lit(False))
    )
    labels = labels.withColumnsRenamed({"x": "_x", "y": "_y"})
    same = ((F.col("x") + 0.0) == F.col("_x")) & ((F.col("y") + 0.0) == F.col("_y"))
    return points.join(labels, same, "left").select(
        "id", "cluster_id", F.coalesce("is_core", F.lit(False)).alias("is_core")
    )
