"""Exact order statistics and quantiles of unbounded columns.

``percentile`` keeps every distinct value of a group in one place, which does not scale.
Here an approximate quantile sketch brackets each wanted rank, one counting pass checks the
brackets, and only the few values inside them are sorted. Brackets that are still too full are
narrowed again, so the result is exact for any amount of data. Only counts, bracket ends and the
results reach the driver. Every step is a pass over the input, so an expensive input should be
written once first (``session.cut_lineage``).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SORT_LIMIT

SKETCH_ACCURACY = 10_000


@dataclass
class _Target:
    value: Column  # null for rows that do not take part
    rank: int  # wanted 0-based rank among the non-null values
    size: int  # values inside the bracket
    below: int = 0  # values under the bracket
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    def inside(self) -> Column:
        if self.low is None:
            return self.value.isNotNull()
        return (self.value >= self.low) & (self.value <= self.high)


def order_statistics(
    df: DataFrame, wanted: list[tuple[Column, list[int]]], sort_limit: int = SORT_LIMIT
) -> list[dict[int, float]]:
    """For each ``(value column, ranks)`` the exact values at those 0-based ranks.

    Null values take no part. Ranks past the end are left out of the result.
    """
    if not wanted:
        return []
    sizes = df.agg(*[F.count(value).alias(f"n{i}") for i, (value, _) in enumerate(wanted)]).first()
    targets: list[tuple[int, _Target]] = [
        (i, _Target(value, rank, sizes[i]))
        for i, (value, ranks) in enumerate(wanted)
        for rank in sorted(set(ranks))
        if 0 <= rank < sizes[i]
    ]
    while open_targets := [t for _, t in targets if t.answer is None]:
        small = [t for t in open_targets if t.size <= sort_limit]
        large = [t for t in open_targets if t.size > sort_limit]
        if small:
            _sort_small(df, small)
        if large:
            _narrow(df, large)
    results: list[dict[int, float]] = [{} for _ in wanted]
    for i, t in targets:
        results[i][t.rank] = t.answer
    return results


def _sort_small(df: DataFrame, targets: list[_Target]) -> None:
    """Sort the bracket of each target (at most the sort limit of values) and pick its rank."""
    picks = df.agg(
        *[
            F.get(
                F.sort_array(F.collect_list(F.when(t.inside(), t.value))), F.lit(t.rank - t.below)
            ).alias(f"v{i}")
            for i, t in enumerate(targets)
        ]
    ).first()
    for t, value in zip(targets, picks):
        t.answer = value


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """Replace each bracket by the smallest sketch bracket around its rank, then recount."""
    slack = 2.0 / SKETCH_ACCURACY
    probes = []
    for i, t in enumerate(targets):
        q = (t.rank - t.below) / max(t.size - 1, 1)
        points = [max(q - slack, 0.0), min(q + slack, 1.0)]
        probes.append(
            F.percentile_approx(F.when(t.inside(), t.value), points, SKETCH_ACCURACY).alias(f"b{i}")
        )
    ends = df.agg(*probes).first()
    counts = []
    for i, (t, (low, high)) in enumerate(zip(targets, ends)):
        inside = t.inside()
        counts += [
            F.count_if(inside & (t.value < low)).alias(f"l{i}"),
            F.count_if(inside & (t.value == low)).alias(f"a{i}"),
            F.count_if(inside & (t.value > low) & (t.value < high)).alias(f"m{i}"),
            F.count_if(inside & (t.value == high)).alias(f"z{i}"),
            F.min(F.when(inside & (t.value > low), t.value)).alias(f"u{i}"),
            F.max(F.when(inside & (t.value < high), t.value)).alias(f"d{i}"),
            F.min(F.when(inside, t.value)).alias(f"lo{i}"),
            F.max(F.when(inside, t.value)).alias(f"hi{i}"),
            F.max(F.when(inside & (t.value < low), t.value)).alias(f"ul{i}"),
            F.min(F.when(inside & (t.value > high), t.value)).alias(f"ah{i}"),
        ]
    row = df.agg(*counts).first()
    for i, (t, (low, high)) in enumerate(zip(targets, ends)):
        r = t.rank - t.below
        under, at_low, middle = row[f"l{i}"], row[f"a{i}"], row[f"m{i}"]
        at_high = row[f"z{i}"] if high > low else 0
        upto = under + at_low + middle + at_high
        if r < under:  # the sketch overshot: what lies below the bracket
            t.low, t.high, t.size = row[f"lo{i}"], row[f"ul{i}"], under
        elif r < under + at_low:
            t.answer = low
        elif r < under + at_low + middle:
            t.low, t.high = row[f"u{i}"], row[f"d{i}"]
            t.below, t.size = t.below + under + at_low, middle
        elif r < upto:
            t.answer = high
        else:  # the sketch undershot: what lies above the bracket
            t.low, t.high = row[f"ah{i}"], row[f"hi{i}"]
            t.below, t.size = t.below + upto, t.size - upto


def quantiles_higher(
    df: DataFrame, wanted: dict[str, tuple[Column, float]], sort_limit: int = SORT_LIMIT
) -> dict[str, float | None]:
    """For each name, the order statistic at rank ceil(q * (n - 1)) of its column; None if empty."""
    if not wanted:
        return {}
    sizes = df.agg(*[F.count(value).alias(f"n{i}") for i, (value, _) in enumerate(wanted.values())]).first()
    ranks = [
        # the product can end a hair above a whole number
        ceil(round(q * (n - 1), 9)) if n else 0
        for n, (_, q) in zip(sizes, wanted.values())
    ]
    found = order_statistics(
        df, [(value, [rank]) for rank, (value, _) in zip(ranks, wanted.values())], sort_limit
    )
    return {name: f.get(rank) for name, rank, f in zip(wanted, ranks, found)}


def quantile_higher(df: DataFrame, value: Column | str, q: float, **options) -> float | None:
    value = F.col(value) if isinstance(value, str) else value
    return quantiles_higher(df, {"q": (value, q)}, **options)["q"]


def linear_quantiles(
    df: DataFrame, value: Column | str, qs: list[float], sort_limit: int = SORT_LIMIT
) -> list[float]:
    """Quantiles with linear interpolation between neighbouring order statistics."""
    value = F.col(value) if isinstance(value, str) else value
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return []
    places = [q * (n - 1) for q in qs]
    ranks = sorted({r for h in places for r in (floor(h), min(floor(h) + 1, n - 1))})
    found = order_statistics(df, [(value, ranks)], sort_limit)[0]
    out = []
    for h in places:
        low = floor(h)
        a, b = found[low], found[min(low + 1, n - 1)]
        out.append(a + (b - a) * (h - low))
    return out
