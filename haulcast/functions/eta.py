"""Arrival-time arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    DAYS_PER_MONTH,
    KM_PER_MILE,
    LOCAL_ETA_WEIGHT,
    METHOD_BLEND,
    METHOD_LOCAL,
    ROUTE_CALLS_PER_MINUTE,
    ROUTE_ETA_WEIGHT,
)
from .text import parse_number


def naive_eta_min(distance_km: Column, speed_mph: Column) -> Column:
    """Minutes to cover a distance at the current speed, counted as at least 1 mph."""
    mph = F.greatest(F.coalesce(speed_mph, F.lit(0.0)), F.lit(1.0))
    return distance_km / (mph * KM_PER_MILE) * 60.0


def to_minutes(seconds: Column) -> Column:
    return seconds / 60.0


def blended_eta_min(local: Column, route: Column) -> Column:
    """Weighted mean of the local and the route estimate; the local one where no route is known."""
    return F.when(route.isNotNull(), local * LOCAL_ETA_WEIGHT + route * ROUTE_ETA_WEIGHT).otherwise(
        local
    )


def eta_method(route: Column) -> Column:
    return F.when(route.isNotNull(), METHOD_BLEND).otherwise(METHOD_LOCAL)


def route_duration_min(response: Column) -> Column:
    """Minutes from a stored route response ``{"routes": [{"duration": "123.4s"}]}``."""
    text = F.get_json_object(response, "$.routes[0].duration")
    return duration_text_min(text)


def duration_text_min(text: Column) -> Column:
    """Minutes from text like ``123.4s``; null without the trailing s or a number before it."""
    return F.when(text.endswith("s"), parse_number(F.regexp_replace(text, "s$", "")) / 60.0)


def eta_status(p50: Column) -> Column:
    return (
        F.when(p50 <= 30, "On Schedule").when(p50 <= 60, "Check Progress").otherwise("Behind Schedule")
    )


def band_half_width(p10: Column, p50: Column, p90: Column) -> Column:
    return F.greatest(p90 - p50, p50 - p10)


def scaled_interval(p10: Column, p90: Column, scale) -> tuple[Column, Column]:
    """The interval widened (or narrowed) around its middle."""
    scale = F.lit(scale) if not isinstance(scale, Column) else scale
    mid, half = (p10 + p90) * 0.5, (p90 - p10) * 0.5
    return mid - scale * half, mid + scale * half


def bucket_index(value: Column, edges: Sequence[float]) -> Column:
    """Number of inner ``edges`` not above the value."""
    inner = list(edges)[1:-1]
    if not inner:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in inner]), lambda e: e <= value))


def near_arrival_weight(minutes: Column) -> Column:
    """Training weight of a row by its remaining minutes."""
    return (
        F.when(minutes <= 60.0, 16.0)
        .when(minutes <= 120.0, 8.0)
        .when(minutes <= 180.0, 4.0)
        .otherwise(1.0)
    )


def near_blend(p50: Column, other: Column, naive: Column, threshold, weight) -> Column:
    """Blend ``other`` into ``p50`` where the naive estimate is at most ``threshold``."""
    return F.when(naive <= threshold, p50 * (F.lit(1.0) - weight) + other * weight).otherwise(p50)


def budget_columns(
    trucks: Column,
    interval_s: Column,
    active_hours: Column,
    refresh_ratio: Column,
    price_per_1000: Column,
    monthly_budget: Column,
) -> dict[str, Column]:
    """Monthly route-service volume, quota use and cost of a fleet."""
    per_day = trucks * (active_hours * 3600.0 / interval_s)
    pings = per_day * DAYS_PER_MONTH
    calls = pings * refresh_ratio
    minutes = active_hours * 60.0 * DAYS_PER_MONTH
    per_minute = calls / F.greatest(minutes, F.lit(1.0))
    cost = calls / 1000.0 * price_per_1000
    return {
        "pings_per_month": pings,
        "calls_per_month": calls,
        "calls_per_minute": per_minute,
        "quota_pct": per_minute / ROUTE_CALLS_PER_MINUTE * 100.0,
        "monthly_cost": cost,
        "budget_pct": cost / F.greatest(monthly_budget, F.lit(1e-9)) * 100.0,
        "quota_ok": per_minute <= ROUTE_CALLS_PER_MINUTE,
        "budget_ok": cost <= monthly_budget,
    }


def max_trucks(interval_s: Column) -> Column:
    """Fleet size at which one route call per ping reaches the per-minute quota."""
    return F.lit(ROUTE_CALLS_PER_MINUTE) * interval_s / 60.0
