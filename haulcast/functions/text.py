"""Reading numbers and times out of text, and formatting them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted spellings -----------------------------------------------------
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"
TIME_PATTERN = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"


def clean(c: Column | str) -> Column:
    """Trimmed text, empty when absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def parse_number(text: Column) -> Column:
    """Double value of a decimal, ``inf`` or ``nan`` spelling; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"(?<=\d)_(?=\d)", "")
    return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast("double"))


def parse_time(text: Column) -> Column:
    """Timestamp of ``Y-m-d H:M:S`` text; null for anything else."""
    spaced = F.regexp_replace(text, r"\s+", " ")
    return F.when(
        text.rlike(TIME_PATTERN), F.try_to_timestamp(spaced, F.lit("yyyy-M-d H:m:s"))
    )


def outside(value: Column, low: float, high: float) -> Column:
    """True for a value missing or out of range; NaN compares false and is not outside."""
    beyond = (value < low) | (~F.isnan(value) & (value > high))
    return F.coalesce(beyond, F.lit(True))


def round_half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def format_hhmm(minutes: Column) -> Column:
    """``HH:MM`` of a duration in minutes, ``N/A`` when missing or negative."""
    missing = minutes.isNull() | F.isnan(minutes) | (minutes < 0)
    return F.when(missing, F.lit("N/A")).otherwise(
        F.format_string("%02d:%02d", F.floor(minutes / 60), F.floor(minutes % 60))
    )


def shorten(text: Column, limit: int = 20) -> Column:
    """Text cut to ``limit`` characters, marked with dots where cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
