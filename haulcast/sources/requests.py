"""Prediction requests: reading, checking and rejecting JSON request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_number
from ..schema import REQUEST_FIELDS, REQUEST_NUMBERS

ERROR_JSON = "Invalid JSON"
ERROR_MISSING = "Missing fields: "
ERROR_NUMBER = "latitude/longitude/speed_mph must be numeric"
ERROR_EMPTY = "Request body is required"


def parse_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Add the typed request fields, ``use_route`` and ``error`` (null for a usable request).

    A key that is present with a null value is not missing; a null number is not numeric. Columns
    of ``bodies`` named like a request field give way to it.
    """
    taken = {*REQUEST_FIELDS, "use_route", "error"}
    body = F.col(column)
    # the map keeps every key with its JSON text, so absent and null keys differ
    fields = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    empty = body.isNull() | (F.length(F.trim(body)) == 0)
    df = bodies.withColumn("_f", fields)
    present = {name: F.map_contains_key("_f", F.lit(name)) for name in REQUEST_FIELDS}
    missing = F.array_compact(
        F.array(*[F.when(~present[name], F.lit(name)) for name in REQUEST_FIELDS])
    )
    numbers = {name: parse_number(F.col("_f")[name]) for name in REQUEST_NUMBERS}
    not_numeric = None
    for value in numbers.values():
        not_numeric = value.isNull() if not_numeric is None else not_numeric | value.isNull()
    error = (
        F.when(empty, ERROR_EMPTY)
        .when(F.col("_f").isNull(), ERROR_JSON)
        .when(F.size("_missing") > 0, F.concat(F.lit(ERROR_MISSING), F.array_join("_missing", ", ")))
        .when(not_numeric, ERROR_NUMBER)
    )
    flag = F.lower(F.coalesce(F.col("_f")["use_google_routes"], F.lit("false")))
    return (
        df.withColumn("_missing", missing)
        .withColumn("error", error)
        .select(
            *[c for c in bodies.columns if c.lower() not in taken],
            F.col("_f")["vin"].alias("vin"),
            F.col("_f")["trip_id"].alias("trip_id"),
            *[value.alias(name) for name, value in numbers.items()],
            (~flag.isin("false", "0", "0.0", "null", "", "[]", "{}")).alias("use_route"),
            "error",
        )
    )


def split_requests(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) requests."""
    return parsed.where(F.col("error").isNull()), parsed.where(F.col("error").isNotNull())
