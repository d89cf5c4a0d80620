"""Estimates for vehicles with little or no history, backed off to their device type and the fleet.

Each level's mean is drawn towards the level above as if that had been seen ``strength`` times:
a vehicle without rows gets its device type's estimate, one with many rows its own mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _shrunk(total: Column, n: Column, above: Column, strength: float) -> Column:
    return (total + F.lit(float(strength)) * above) / (n + F.lit(float(strength)))


def backoff_table(rows: DataFrame, value: str, strength: float = 20.0) -> DataFrame:
    """One row per (Device_Type, VIN), per Device_Type (VIN null) and for the fleet (both null).

    ``level`` is 0, 1 and 2 in that order, ``n`` counts the rows with a value, ``estimate`` is the
    shrunk mean. Null and NaN values are left out; null devices and vehicles are unknown ones and
    count for the levels above only. Rows are grouped once, by vehicle; the rest works on that.
    """
    if strength <= 0:
        raise ValueError("strength must be positive")
    known = rows.select("Device_Type", "VIN", F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v"))
    vehicles = (
        known.where(F.col("_v").isNotNull()).groupBy("Device_Type", "VIN").agg(F.count("_v").alias("n"), F.sum("_v").alias("_t"))
    )
    devices = vehicles.groupBy("Device_Type").agg(F.sum("n").alias("_dn"), F.sum("_t").alias("_dt"))
    fleet = devices.agg(F.sum("_dn").alias("_fn"), (F.sum("_dt") / F.sum("_dn")).alias("_fleet"))
    # the fleet's single row is joined to one row per device type
    devices = devices.withColumn("_one", F.lit(1)).join(fleet.withColumn("_one", F.lit(1)), "_one").drop("_one")
    devices = devices.withColumn("_device", _shrunk(F.col("_dt"), F.col("_dn"), F.col("_fleet"), strength))
    above = devices.select(F.col("Device_Type").alias("_type"), "_device")
    per_vehicle = (
        vehicles.where(F.col("Device_Type").isNotNull() & F.col("VIN").isNotNull())
        .join(above, F.col("Device_Type") == F.col("_type"))
        .select(
            F.lit(0).alias("level"), "Device_Type", "VIN", "n",
            _shrunk(F.col("_t"), F.col("n"), F.col("_device"), strength).alias("estimate"),
        )
    )
    nothing = F.lit(None).cast("string")
    per_device = devices.where(F.col("Device_Type").isNotNull()).select(
        F.lit(1).alias("level"), "Device_Type", nothing.alias("VIN"), F.col("_dn").alias("n"), F.col("_device").alias("estimate")
    )
    whole = fleet.where(F.col("_fn") > 0).select(
        F.lit(2).alias("level"), nothing.alias("Device_Type"), nothing.alias("VIN"), F.col("_fn").alias("n"), F.col("_fleet").alias("estimate")
    )
    return per_vehicle.unionByName(per_device).unionByName(whole)


def with_backoff(rows: DataFrame, table: DataFrame, name: str = "estimate") -> DataFrame:
    """``rows`` with the estimate of the finest level that knows them, and that ``<name>_level``.

    The joins are left to the adaptive planner, which splits a vehicle of many rows.
    """
    def level(number: int, *keys: str) -> DataFrame:
        return table.where(F.col("level") == number).select(*[F.col(k).alias(f"_{k}{number}") for k in keys], F.col("estimate").alias(f"_e{number}"))

    out = (
        rows.join(level(0, "Device_Type", "VIN"), (F.col("Device_Type") == F.col("_Device_Type0")) & (F.col("VIN") == F.col("_VIN0")), "left")
        .join(level(1, "Device_Type"), F.col("Device_Type") == F.col("_Device_Type1"), "left")
        .withColumn("_all", F.lit(2))
        .join(level(2).withColumn("_all", F.lit(2)), "_all", "left")
    )
    chosen = F.coalesce("_e0", "_e1", "_e2")
    finest = F.when(F.col("_e0").isNotNull(), 0).when(F.col("_e1").isNotNull(), 1).when(F.col("_e2").isNotNull(), 2)
    return out.select(*rows.columns, chosen.alias(name), finest.alias(f"{name}_level"))


def silent_spells(pings: DataFrame, longer_than_s: float = 300.0) -> DataFrame:
    """Spells without a ping of a vehicle longer than that: the pings around it and its length.

    The order is by time and ``event_seq``; pings without a vehicle or time are left out. A vehicle's
    pings are cut into days; only the last ping of a day is looked at from the next one.
    """
    at = F.struct(F.unix_micros("Timestamp").alias("us"), "event_seq")
    rows = pings.where(F.col("VIN").isNotNull() & F.col("Timestamp").isNotNull()).select(
        "VIN", "event_seq", F.to_date("Timestamp").alias("_day"), at.alias("_at")
    )
    ends = rows.groupBy("VIN", "_day").agg(F.max("_at").alias("_end"))
    carried = ends.select("VIN", "_day", F.lag("_end").over(Window.partitionBy("VIN").orderBy("_day")).alias("_carried"))
    before = F.lag("_at").over(Window.partitionBy("VIN", "_day").orderBy("_at"))
    placed = rows.withColumn("_before", before).join(carried, ["VIN", "_day"])
    last = F.coalesce("_before", "_carried")
    return (
        placed.select("VIN", "event_seq", last.alias("_last"), ((F.col("_at.us") - last["us"]) / F.lit(1e6)).alias("silent_s"))
        .where(F.col("silent_s") > F.lit(float(longer_than_s)))
        .select("VIN", F.col("_last.event_seq").alias("last_seq"), F.col("event_seq").alias("next_seq"), "silent_s")
    )
