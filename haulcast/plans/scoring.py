"""Batch scoring of prediction requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.eta import blended_eta_min, eta_method, naive_eta_min
from ..functions.geo import haversine_km
from ..functions.text import round_half_up
from ..sources.requests import parse_requests, split_requests


def score_requests(
    requests: DataFrame, route_eta: Column | None = None, as_of: Column | None = None
) -> DataFrame:
    """The response columns of usable requests.

    ``route_eta`` (minutes, null where unknown) counts only for requests that ask for it;
    ``as_of`` defaults to the request's own ``as_of`` column, or null.
    """
    distance = haversine_km("latitude", "longitude", "destination_latitude", "destination_longitude")
    route = F.when(F.col("use_route"), route_eta) if route_eta is not None else F.lit(None).cast("double")
    if as_of is None:
        as_of = F.col("as_of") if "as_of" in requests.columns else F.lit(None).cast("timestamp")
    df = requests.withColumn("_km", distance).withColumn("_route", route)
    df = df.withColumn("_local", naive_eta_min(F.col("_km"), F.col("speed_mph")))
    return df.select(
        F.col("vin").cast("string").alias("vin"),
        F.col("trip_id").cast("string").alias("trip_id"),
        round_half_up(F.col("_km"), 3).alias("distance_remaining_km"),
        round_half_up(F.col("_local"), 3).alias("eta_remaining_min"),
        round_half_up(F.col("_route"), 3).alias("google_route_eta_min"),
        round_half_up(blended_eta_min(F.col("_local"), F.col("_route")), 3).alias("blended_eta_min"),
        eta_method(F.col("_route")).alias("method"),
        as_of.alias("as_of"),
    )


def response_json(responses: DataFrame) -> Column:
    """The response as a JSON object; unknown values are written as null."""
    return F.to_json(F.struct(*responses.columns), {"ignoreNullFields": "false"})


def batch_predict(
    bodies: DataFrame, route_eta: Column | None = None, as_of: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(responses, rejected requests) of a table of JSON request bodies."""
    usable, rejected = split_requests(parse_requests(bodies))
    return score_requests(usable, route_eta, as_of), rejected
