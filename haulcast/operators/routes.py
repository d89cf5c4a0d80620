"""Route estimates and destinations attached to pings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.eta import duration_text_min
from ..schema import CHUNK_SECONDS
from ..session import cut_lineage

ROUTE_TTL_MINUTES = 15


def route_asof(
    pings: DataFrame,
    routes: DataFrame,
    ttl_minutes: float = ROUTE_TTL_MINUTES,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add the vehicle's latest route estimate not older than ``ttl_minutes`` at each ping.

    ``routes`` has VIN, route_ts and duration text. Pings and routes are stacked and the last
    route seen is carried forward, one sort instead of a range join. An estimate serves at most
    one lifetime, so it is placed in its own time chunk and in the later ones its lifetime
    reaches; a chunk then needs nothing from outside and a hot vehicle is split by time. A
    ping sees routes of its own instant; of several at one instant the longest counts.
    """
    ttl = int(ttl_minutes * 60_000_000)
    width = int(chunk_seconds) * 1_000_000
    offers = routes.select(
        "VIN",
        F.unix_micros("route_ts").alias("_t"),
        duration_text_min(F.col("duration")).alias("_route"),
    ).where(F.col("_route").isNotNull() & F.col("_t").isNotNull())
    offers = offers.select(
        "VIN",
        "_t",
        F.explode(F.sequence(F.expr(f"_t div {width}L"), F.expr(f"(_t + {ttl}L) div {width}L"))).alias("_c"),
        F.struct(F.col("_t").alias("at"), F.col("_route").alias("minutes")).alias("_offer"),
    )
    left = pings.withColumn("_t", F.unix_micros("Timestamp"))
    stacked = left.withColumn("_c", F.expr(f"_t div {width}L")).unionByName(offers, allowMissingColumns=True)
    is_ping = F.col("_offer").isNull()
    w = (
        Window.partitionBy("VIN", "_c")
        .orderBy("_t", is_ping, F.col("_offer.minutes"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = F.last("_offer", True).over(w)
    fresh = F.col("_t") - F.col("_found.at") <= ttl
    return (
        stacked.withColumn("_found", found)
        .where(is_ping)
        .select(
            *pings.columns,
            F.when(fresh, F.col("_found.minutes")).alias("route_eta_min"),
        )
    )


PLACE_DIGITS = 2  # of a degree, to which origin and destination are rounded
REFRESH_KEY = ("VIN", "trip_local", "_from_lat", "_from_lon", "_to_lat", "_to_lon")


def _at(micros: Column, id_: Column) -> Column:
    return F.struct(micros.alias("t"), id_.alias("id"))


def next_refreshes(calls: DataFrame, ttl: int, width: int) -> DataFrame:
    """(id, next): for every ping the first one of its key that is ``ttl`` or more later.

    ``calls`` has the key, _t and id. Pings and the times asked for are stacked by time chunk; a time that
    finds nothing in its chunk takes the first ping of the key's next chunk, from one row per chunk.
    """
    key = list(REFRESH_KEY)
    asked = calls.select(*key, "id", (F.col("_t") + ttl).alias("_t"), F.lit(0).alias("_ping"))
    stacked = calls.select(*key, "id", "_t", F.lit(1).alias("_ping")).unionByName(asked)
    stacked = stacked.withColumn("_c", F.expr(f"_t div {width}L"))
    here = F.when(F.col("_ping") == 1, _at(F.col("_t"), F.col("id")))
    heads = stacked.groupBy(*key, "_c").agg(F.min(here).alias("_head"))
    later = Window.partitionBy(*key).orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.select(*key, "_c", F.first("_head", True).over(later)["id"].alias("_after"))
    inside = Window.partitionBy(*key, "_c").orderBy("_t", "_ping", "id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = stacked.withColumn("_found", F.first(here, True).over(inside)["id"]).where("_ping = 0")
    return found.join(heads, [*key, "_c"]).select("id", F.coalesce("_found", "_after").alias("next"))


def chain_members(starts: DataFrame, links: DataFrame) -> DataFrame:
    """All ids reached from ``starts`` (id) along ``links`` (id, next), by pointer jumping.

    After k rounds the first 2**k members of every chain are known, and the links jump 2**k members
    ahead, so the longest chain takes the logarithm of its length in rounds.
    """
    members, jump = cut_lineage(starts.select("id")), cut_lineage(links.where(F.col("next").isNotNull()))
    while not jump.isEmpty():
        ahead = members.join(jump, "id").select(F.col("next").alias("id"))
        members = cut_lineage(members.unionByName(ahead))
        further = jump.select(F.col("id").alias("next"), F.col("next").alias("_then"))
        jump = cut_lineage(jump.join(further, "next").select("id", F.col("_then").alias("next")))
    return members


def route_refreshes(
    pings: DataFrame,
    ttl_minutes: float = ROUTE_TTL_MINUTES,
    digits: int = PLACE_DIGITS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add ``refresh`` (the ping asks the route service) and ``served_by`` (the ping whose estimate it uses).

    An estimate is kept per trip, rounded origin and rounded destination and serves ``ttl_minutes``: the
    first ping of such a key asks, and then always the first that comes at least so much later.
    Who asks is a greedy chain; it is followed by pointer jumping, so neither a trip nor a vehicle is
    worked in sequence. Pings without a time or a place neither ask nor are served. ``pings`` carries
    destination_latitude and destination_longitude; event_seq tells its rows apart.
    """
    ttl, width = int(ttl_minutes * 60_000_000), int(chunk_seconds) * 1_000_000
    places = ("Latitude", "Longitude", "destination_latitude", "destination_longitude")
    named = [F.round(c, digits).alias(k) for c, k in zip(places, REFRESH_KEY[2:])]
    key = list(REFRESH_KEY)
    calls = pings.select("VIN", "trip_local", *named, F.unix_micros("Timestamp").alias("_t"), F.col("event_seq").alias("id"))
    calls = cut_lineage(calls.dropna())
    starts = calls.groupBy(*key).agg(F.min(_at(F.col("_t"), F.col("id")))["id"].alias("id"))
    asking = chain_members(starts, next_refreshes(calls, ttl, width)).withColumn("refresh", F.lit(True))
    marked = calls.join(asking, "id", "left")
    # an estimate is copied into the chunks that its lifetime reaches
    offers = marked.where("refresh").select(
        *key, F.explode(F.sequence(F.expr(f"_t div {width}L"), F.expr(f"(_t + {ttl}L) div {width}L"))).alias("_c"), "_t", F.col("id").alias("_offer")
    )
    stacked = marked.withColumn("_c", F.expr(f"_t div {width}L")).unionByName(offers, allowMissingColumns=True)
    seen = Window.partitionBy(*key, "_c").orderBy("_t", F.coalesce("_offer", "id"), F.col("_offer").isNull())
    seen = seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = stacked.withColumn("served_by", F.last("_offer", True).over(seen)).where(F.col("id").isNotNull())
    served = served.select(F.col("id").alias("event_seq"), F.coalesce("refresh", F.lit(False)).alias("refresh"), "served_by")
    out = pings.join(served, "event_seq", "left")
    return out.select(*pings.columns, F.coalesce("refresh", F.lit(False)).alias("refresh"), "served_by")


def join_destinations(requests: DataFrame, destinations: DataFrame) -> DataFrame:
    """Add the destination of each request's trip; requests without one keep nulls.

    Destinations (one row per trip) grow with the fleet, so the join's form is left to the planner,
    which broadcasts only what it finds to be small.
    """
    return requests.join(destinations, ["VIN", "trip_local"], "left")
