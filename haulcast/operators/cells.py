"""Hierarchical position cells: geohashes with parents and neighbours, densities at several levels.

A geohash of ``p`` characters names a cell of 5p bits, alternately of longitude and latitude. Its
prefix names the enclosing cell, so counts at a coarse level follow from those of a finer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.schema import STOP_SPEED_MPH

# The digits of a geohash, in order.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
MAX_PRECISION = 12


def axis_bits(precision: int) -> tuple[int, int]:
    """Bits of latitude and of longitude in a geohash of that many characters."""
    if not 1 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision must be within 1..{MAX_PRECISION}")
    return 5 * precision // 2, (5 * precision + 1) // 2


def _step(value: Column, low: float, span: float, bits: int) -> Column:
    """Number of the cell along one axis; the upper border belongs to the last cell."""
    number = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(1 << bits)))
    return F.least(number, F.lit((1 << bits) - 1).cast("long"))


def _encode(lat_step: Column, lon_step: Column, precision: int) -> Column:
    lat_bits, lon_bits = axis_bits(precision)
    digits = []
    for at in range(precision):
        digit = F.lit(0)
        for bit in range(5 * at, 5 * at + 5):
            step, left = (lon_step, lon_bits) if bit % 2 == 0 else (lat_step, lat_bits)
            one = F.shiftright(step, left - 1 - bit // 2).bitwiseAND(F.lit(1))
            digit = digit + one * F.lit(1 << (4 - bit % 5))
        digits.append(F.substring(F.lit(DIGITS), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Geohash of a position; null for missing, non-finite or impossible coordinates."""
    lat_bits, lon_bits = axis_bits(precision)
    valid = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(valid, _encode(_step(lat, -90.0, 180.0, lat_bits), _step(lon, -180.0, 360.0, lon_bits), precision))


def parent(cell: Column, precision: int) -> Column:
    """The enclosing cell of that many characters; null if the cell has fewer."""
    return F.when(F.length(cell) >= precision, F.substring(cell, 1, precision))


def _axis_steps(cell: Column, precision: int) -> tuple[Column, Column]:
    lat, lon = F.lit(0).cast("long"), F.lit(0).cast("long")
    for at in range(precision):
        digit = F.instr(F.lit(DIGITS), F.substring(cell, at + 1, 1)) - 1
        for bit in range(5 * at, 5 * at + 5):
            one = F.shiftright(digit, 4 - bit % 5).bitwiseAND(F.lit(1)).cast("long")
            if bit % 2 == 0:
                lon = F.shiftleft(lon, 1).bitwiseOR(one)
            else:
                lat = F.shiftleft(lat, 1).bitwiseOR(one)
    return lat, lon


def neighbours(cell: Column, precision: int) -> Column:
    """The up to eight cells around one, as a sorted array; longitudes wrap, the poles are borders."""
    lat_bits, lon_bits = axis_bits(precision)
    lat, lon = _axis_steps(cell, precision)
    last, width = F.lit((1 << lat_bits) - 1).cast("long"), F.lit(1 << lon_bits).cast("long")
    offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    steps = F.array(*[F.struct((lat + dy).alias("y"), F.pmod(lon + dx, width).alias("x")) for dy, dx in offsets])
    inside = F.filter(steps, lambda s: s["y"].between(0, last))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda s: _encode(s["y"], s["x"], precision))))


def cell_density(pings: DataFrame, finest: int = 5, coarsest: int = 1) -> DataFrame:
    """Pings, mean speed and standing share per cell at every level from finest to coarsest.

    Pings are grouped once, by their finest cell and combined map-side; the levels above add up
    those sums, so their cost follows the number of cells. Missing speeds count as standing still.
    """
    if finest < coarsest:
        raise ValueError("the finest level has at least as many characters as the coarsest")
    speed = F.coalesce(F.col("Speed"), F.lit(0.0))
    cells = (
        pings.select(geohash(F.col("Latitude"), F.col("Longitude"), finest).alias("_cell"), speed.alias("_speed"))
        .where(F.col("_cell").isNotNull())
        .groupBy("_cell")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_speed").alias("_sum"),
            F.count_if(F.col("_speed") < STOP_SPEED_MPH).alias("_standing"),
        )
    )
    levels = F.sequence(F.lit(coarsest), F.lit(finest))
    return (
        cells.withColumn("level", F.explode(levels))
        .groupBy("level", F.substring("_cell", F.lit(1), F.col("level")).alias("cell"))
        .agg(F.sum("_n").alias("pings"), F.sum("_sum").alias("_sum"), F.sum("_standing").alias("_standing"))
        .select(
            "level",
            "cell",
            "pings",
            (F.col("_sum") / F.col("pings")).alias("mean_speed"),
            (F.col("_standing") / F.col("pings")).alias("standing_share"),
        )
    )
