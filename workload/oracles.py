"""SQL counterparts of the registered queries, written as plain windows and aggregates."""

from __future__ import annotations

ORIGIN = 1704067200000000

PINGS = f"""
pings AS (
  SELECT printf('V%05d', user_id) AS VIN, event_id AS event_seq,
    make_timestamp({ORIGIN} + (epoch_us(ts) - {ORIGIN}) // 48) AS Timestamp,
    (35.0 + user_id % 10 + cast(json_extract_string(props, '$.k') AS int) / 100.0)::DOUBLE AS Latitude,
    (-100.0 + user_id % 15 + cast(json_extract_string(props, '$.k') AS int) / 200.0)::DOUBLE AS Longitude,
    CASE WHEN event_id % 20 <> 0 THEN value / 4 END AS Speed,
    (CASE event_type WHEN 'purchase' THEN 45000.0 WHEN 'signup' THEN 8000.0 END)::DOUBLE AS Weight_lbs,
    CASE WHEN user_id % 3 = 0 THEN 'OEM' ELSE 'ELD' END AS Device_Type,
    event_type AS Source
  FROM events)"""


def r(expression: str, digits: int = 6) -> str:
    """Half-up rounding with the arithmetic the queries use."""
    scale = f"1e{digits}"
    return f"(floor(({expression})::DOUBLE * {scale} + 0.5) / {scale})"


def segmented(name: str, stop_rule: bool = True) -> str:
    rule = "OR (coalesce(lag(Speed) OVER v, 0) < 2 AND coalesce(Speed, 0) >= 2)" if stop_rule else ""
    return f"""
{name}_flags AS (
  SELECT *, CASE WHEN lag(Timestamp) OVER v IS NULL
      OR epoch_us(Timestamp) - epoch_us(lag(Timestamp) OVER v) > 1800000000 {rule} THEN 1 ELSE 0 END AS opened
  FROM pings WINDOW v AS (PARTITION BY VIN ORDER BY Timestamp, event_seq)),
{name} AS (
  SELECT * EXCLUDE (opened),
    (sum(opened) OVER (PARTITION BY VIN ORDER BY Timestamp, event_seq))::BIGINT AS trip_local
  FROM {name}_flags)"""


ALL_TRIPS = PINGS + "," + segmented("all_trips")
TRIPS = (
    ALL_TRIPS
    + ", trips AS (SELECT * FROM all_trips QUALIFY count(*) OVER (PARTITION BY VIN, trip_local) >= 5)"
)
GAP_TRIPS = PINGS + "," + segmented("gap_trips", False)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"""(2 * 6371.0 * asin(sqrt(
      pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
      + cos(radians({lat1})) * cos(radians({lat2}))
        * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"""


def features(source: str = "trips") -> str:
    return f"""
scanned AS (
  SELECT *, coalesce(Speed, 0.0) AS sp,
    row_number() OVER w - 1 AS i, count(*) OVER t AS n,
    min(Timestamp) OVER t AS t0, max(Timestamp) OVER t AS t1,
    last_value(Latitude IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dlat,
    last_value(Longitude IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dlon,
    avg(coalesce(Speed, 0.0)) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5,
    coalesce(stddev_samp(coalesce(Speed, 0.0)) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS std5,
    max(coalesce(Speed, 0.0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top,
    avg(coalesce(Speed, 0.0)) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean3
  FROM {source}
  WINDOW w AS (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq), t AS (PARTITION BY VIN, trip_local)),
loads AS (
  SELECT *, (CASE WHEN n < 3 THEN (sp < 10)::INT ELSE (round(mean3, 9) < 10)::INT END) AS load_state FROM scanned),
turns AS (
  SELECT *, CASE WHEN lag(load_state) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) <> load_state
    THEN 1 ELSE 0 END AS turned FROM loads),
features AS (
  SELECT *, (epoch_us(Timestamp) - epoch_us(t0)) / 1e6 AS elapsed_s,
    (epoch_us(t1) - epoch_us(Timestamp)) / 1e6 AS eta_remaining_s,
    {haversine("Latitude", "Longitude", "dlat", "dlon")} AS dist_remaining_km,
    sin(2 * pi() * (hour(Timestamp) + minute(Timestamp) / 60.0::DOUBLE) / 24.0::DOUBLE) AS hour_sin,
    cos(2 * pi() * (hour(Timestamp) + minute(Timestamp) / 60.0::DOUBLE) / 24.0::DOUBLE) AS hour_cos,
    (isodow(Timestamp) - 1)::INT AS dow, (Weight_lbs IS NOT NULL)::INT AS has_weight,
    i / greatest(n - 1, 1)::DOUBLE AS trip_progress,
    (sum(turned) OVER (PARTITION BY VIN, trip_local))::BIGINT AS load_change_count
  FROM turns)"""


NAIVE = "(dist_remaining_km / (greatest(coalesce(Speed, 0.0), 1.0) * 1.60934) * 60.0)"
FEATURES = TRIPS + "," + features()
PREDICTIONS = (
    FEATURES
    + f""",
predictions AS (
  SELECT VIN, trip_local, event_seq, load_state, eta_remaining_s / 60.0 AS y, {NAIVE} AS p50,
    {NAIVE} * 0.5 AS p10, {NAIVE} * 1.5 AS p90, {NAIVE} AS naive FROM features)"""
)

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}', 'i') THEN try_cast({text} AS DOUBLE) END"


RAW = (
    PINGS
    + """,
raw AS (
  SELECT CASE WHEN event_seq % 59 = 0 THEN '' ELSE VIN END AS VIN,
    CASE WHEN event_seq % 31 = 0 THEN '' WHEN event_seq % 37 = 0 THEN '2024-13-01 00:00:00'
      ELSE strftime(Timestamp, '%Y-%m-%d %H:%M:%S') END AS Timestamp,
    CASE WHEN event_seq % 41 = 0 THEN '95.0' WHEN event_seq % 61 = 0 THEN 'nan' ELSE Latitude::VARCHAR END AS Latitude,
    CASE WHEN event_seq % 43 = 0 THEN 'abc' ELSE Longitude::VARCHAR END AS Longitude,
    CASE WHEN event_seq % 47 = 0 THEN '-5' WHEN event_seq % 53 = 0 THEN 'fast' ELSE coalesce(Speed::VARCHAR, '') END AS Speed,
    coalesce(Weight_lbs::VARCHAR, '') AS Weight_lbs, Device_Type, Source, event_seq
  FROM pings)"""
)
DISORDERED = (
    RAW
    + """,
disordered AS (
  SELECT * EXCLUDE (event_seq), event_seq * 4 + CASE WHEN event_seq % 23 = 0 THEN 20002 ELSE 0 END AS event_seq FROM raw
  UNION ALL
  SELECT * EXCLUDE (event_seq), event_seq * 4 + CASE WHEN event_seq % 23 = 0 THEN 20002 ELSE 0 END + 1 AS event_seq
  FROM raw WHERE event_seq % 29 = 0)"""
)

KEY = "VIN, trip_local, event_seq"
SQL: dict[str, str] = {}


def add(name: str, ctes: str, select: str) -> None:
    SQL[name] = f"WITH {ctes}\n{select}"


PING_OUT = f"""VIN, event_seq, epoch_us(Timestamp)::BIGINT AS ts_us, {r('Latitude')} AS lat, {r('Longitude')} AS lon,
  {r('Speed')} AS speed, Weight_lbs AS weight_lbs, Device_Type AS device_type, Source AS source"""

# --- sources ------------------------------------------------------------------------------
add("read_pings", PINGS, f"SELECT {PING_OUT} FROM pings")
add(
    "read_raw_strings",
    PINGS,
    """SELECT VIN, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS ts, Source AS source,
       (row_number() OVER (ORDER BY event_seq) - 1)::BIGINT AS event_seq FROM pings""",
)
add("read_trips", TRIPS, f"SELECT {PING_OUT}, trip_local FROM trips")
add(
    "required_columns",
    PINGS,
    """SELECT column_name FROM (VALUES ('VIN'), ('Timestamp'), ('Latitude'), ('Longitude'), ('Speed'),
       ('Weight_lbs'), ('Device_Type'), ('Source')) t(column_name)
       WHERE lower(column_name) NOT IN (SELECT lower(x) FROM (VALUES ('event_id'), ('ts'), ('user_id'), ('Source')) s(x))""",
)
add(
    "trip_point_lookup",
    TRIPS,
    f"""SELECT {PING_OUT}, trip_local FROM trips
        WHERE (VIN, trip_local) = (SELECT (VIN, trip_local) FROM trips ORDER BY VIN, trip_local LIMIT 1)""",
)
add("trip_list", TRIPS, "SELECT DISTINCT VIN, trip_local FROM trips")

# --- scalar functions ---------------------------------------------------------------------
add(
    "haversine",
    PINGS,
    f"SELECT event_seq, {r(haversine('Latitude', 'Longitude', '40.7128', '-74.0060'))} AS km FROM pings",
)
add("naive_eta", FEATURES, f"SELECT {KEY}, {r(NAIVE)} AS naive_eta_min FROM features")
add(
    "time_encoding",
    PINGS,
    f"""SELECT event_seq, {r('sin(2 * pi() * (hour(Timestamp) + minute(Timestamp) / 60.0::DOUBLE) / 24.0::DOUBLE)')} AS hour_sin,
        {r('cos(2 * pi() * (hour(Timestamp) + minute(Timestamp) / 60.0::DOUBLE) / 24.0::DOUBLE)')} AS hour_cos,
        (isodow(Timestamp) - 1)::INT AS dow FROM pings""",
)
add("weight_flag", PINGS, "SELECT event_seq, (Weight_lbs IS NOT NULL)::INT AS has_weight FROM pings")
add("label_minutes", FEATURES, f"SELECT {KEY}, {r('eta_remaining_s / 60.0')} AS eta_remaining_min FROM features")
add("format_hhmm", PREDICTIONS, f"""SELECT {KEY}, CASE WHEN p50 - 30 < 0 THEN 'N/A' ELSE
    printf('%02d:%02d', floor((p50 - 30) / 60)::BIGINT, floor((p50 - 30) % 60)::BIGINT) END AS hhmm FROM predictions""")
add("eta_status", PREDICTIONS, f"""SELECT {KEY}, CASE WHEN p50 <= 30 THEN 'On Schedule' WHEN p50 <= 60 THEN 'Check Progress'
    ELSE 'Behind Schedule' END AS status, {r('greatest(p90 - p50, p50 - p10)')} AS half_width FROM predictions""")
add("interval_scale_apply", PREDICTIONS, f"""SELECT {KEY}, {r('(p10 + p90) / 2 - 1.25 * (p90 - p10) / 2')} AS low,
    {r('(p10 + p90) / 2 + 1.25 * (p90 - p10) / 2')} AS high FROM predictions""")
add("near_weights", PREDICTIONS, f"""SELECT {KEY}, (CASE WHEN y <= 60 THEN 16.0 WHEN y <= 120 THEN 8.0
    WHEN y <= 180 THEN 4.0 ELSE 1.0 END)::DOUBLE AS weight FROM predictions""")
add("near_blend_apply", PREDICTIONS, f"""SELECT {KEY}, {r('CASE WHEN naive <= 120 THEN 0.25 * p50 + 0.75 * p10 ELSE p50 END')}
    AS blended FROM predictions""")
add("digitize", PREDICTIONS, f"""SELECT {KEY}, ((p50 >= 10)::INT + (p50 >= 30)::INT + (p50 >= 60)::INT + (p50 >= 240)::INT)
    AS bucket FROM predictions""")
ROUTES = (
    PINGS
    + """,
routes AS (
  SELECT VIN, Timestamp AS route_ts, event_seq,
    concat((300 + round((Latitude - floor(Latitude)) * 100)::INT * 10)::VARCHAR, 's') AS duration
  FROM pings WHERE Source = 'view')"""
)
add("route_duration_parse", ROUTES, f"""SELECT event_seq,
    CASE WHEN event_seq % 7 = 0 THEN NULL WHEN event_seq % 11 = 0 THEN NULL
    ELSE {r("cast(replace(duration, 's', '') AS DOUBLE) / 60.0")} END AS minutes FROM routes""")
add("trip_label", ALL_TRIPS, "SELECT DISTINCT VIN, trip_local, printf('%s_%04d', VIN, trip_local) AS label FROM all_trips")
BUDGET = f"""{r('pings')} AS pings_per_month, {r('pings * ratio')} AS calls_per_month,
  {r('pings * ratio / greatest(hours * 60.0 * 30.0, 1.0)')} AS calls_per_minute,
  {r('pings * ratio / greatest(hours * 60.0 * 30.0, 1.0) / 3000.0 * 100.0')} AS quota_pct,
  {r('pings * ratio / 1000.0 * price')} AS monthly_cost,
  {r('pings * ratio / 1000.0 * price / greatest(budget, 1e-9) * 100.0')} AS budget_pct,
  pings * ratio / greatest(hours * 60.0 * 30.0, 1.0) <= 3000.0 AS quota_ok,
  pings * ratio / 1000.0 * price <= budget AS budget_ok"""
add("api_budget", PINGS + """,
  daily AS (SELECT cast(Timestamp AS DATE) AS day, count(*) AS n, count(DISTINCT VIN) AS trucks,
      count(DISTINCT hour(Timestamp)) AS hours FROM pings GROUP BY 1),
  scen AS (SELECT day, trucks, trucks * (hours * 3600.0 / i) * 30.0 AS pings, hours::DOUBLE AS hours, i AS interval_s,
      q AS ratio, 5.0 AS price, 2000.0 AS budget
    FROM daily, (VALUES (10.0), (30.0), (60.0)) a(i), (VALUES (0.0), (0.1), (0.15), (1.0)) b(q))""",
    f"SELECT strftime(day, '%Y-%m-%d') AS day, trucks, interval_s::DOUBLE AS interval_s, ratio::DOUBLE AS ratio, {BUDGET} FROM scen")
add("quota_ceiling", PINGS + """,
  gaps AS (SELECT VIN, (epoch_us(max(Timestamp)) - epoch_us(min(Timestamp))) / 1e6 / nullif(count(*) - 1, 0) AS interval_s
    FROM pings GROUP BY VIN)""",
    f"SELECT VIN, {r('3000.0 * interval_s / 60.0')} AS max_trucks FROM gaps")

# --- filters ------------------------------------------------------------------------------
add("drop_incomplete", PINGS + """, nulled AS (SELECT * REPLACE (CASE WHEN event_seq % 13 = 0 THEN NULL ELSE Latitude END AS Latitude) FROM pings), """
    + segmented("t0").replace("FROM pings", "FROM nulled")
    + ", trips AS (SELECT * FROM t0 QUALIFY count(*) OVER (PARTITION BY VIN, trip_local) >= 5), " + features(),
    f"SELECT {KEY}, {r('dist_remaining_km')} AS dist_remaining_km FROM features WHERE dist_remaining_km IS NOT NULL")
add("short_trip_filter", TRIPS, f"SELECT {KEY} FROM trips")
TS_OK = "try_strptime(Timestamp, '%Y-%m-%d %H:%M:%S')"
add("valid_timestamp", RAW, f"SELECT event_seq, {TS_OK} IS NULL AS bad_timestamp FROM raw")
add("valid_coordinates", RAW, """SELECT event_seq, event_seq % 41 = 0 AS bad_latitude, event_seq % 43 = 0 AS bad_longitude FROM raw""")
add("valid_speed", RAW, f"""SELECT event_seq, Speed = '' AS missing_speed, coalesce(try_cast(Speed AS DOUBLE) < 0, false) AS negative_speed,
    Speed <> '' AND try_cast(Speed AS DOUBLE) IS NULL AS invalid_speed FROM raw""")
add("near_arrival_filter", PREDICTIONS, f"SELECT {KEY}, {r('y')} AS y FROM predictions WHERE y <= 60")
add("prefix_asof", TRIPS, f"""SELECT {KEY} FROM trips
    QUALIFY row_number() OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) - 1 <= 3""")

# --- joins --------------------------------------------------------------------------------
add("route_asof", ROUTES, f"""SELECT p.event_seq, p.VIN, CASE WHEN epoch_us(p.Timestamp) - epoch_us(q.route_ts) <= 900000000
      THEN {r("cast(replace(q.duration, 's', '') AS DOUBLE) / 60.0")} END AS route_eta_min
    FROM pings p ASOF LEFT JOIN routes q ON p.VIN = q.VIN AND p.Timestamp >= q.route_ts""")
REFRESHES = "RECURSIVE " + TRIPS.lstrip() + """,
placed AS (SELECT VIN, trip_local, event_seq, Timestamp, epoch_us(Timestamp) AS t, round(Latitude) AS a, round(Longitude) AS b,
    round(last_value(Latitude IGNORE NULLS) OVER trip) AS c, round(last_value(Longitude IGNORE NULLS) OVER trip) AS d FROM trips
    WINDOW trip AS (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
keyed AS (SELECT *, dense_rank() OVER (ORDER BY VIN, trip_local, a, b, c, d) AS k FROM placed),
chain AS (
  SELECT k, t, event_seq FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY t, event_seq) = 1
  UNION ALL
  SELECT k, t, event_seq FROM (
    SELECT n.k, n.t, n.event_seq, row_number() OVER (PARTITION BY n.k ORDER BY n.t, n.event_seq) AS place
    FROM chain c JOIN keyed n ON n.k = c.k AND n.t >= c.t + 900000000) WHERE place = 1),
served AS (SELECT n.*, c.event_seq IS NOT NULL AS refresh, last_value(c.event_seq IGNORE NULLS) OVER (
    PARTITION BY n.k ORDER BY n.t, n.event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served_by
  FROM keyed n LEFT JOIN chain c USING (event_seq))"""
add("route_refresh", REFRESHES, f"SELECT {KEY}, refresh, served_by FROM served")
add("route_call_budget", REFRESHES + """,
  daily AS (SELECT cast(Timestamp AS DATE) AS day, count(DISTINCT VIN) AS trucks, count(DISTINCT hour(Timestamp))::DOUBLE AS hours,
      count_if(refresh)::BIGINT AS calls, count(*) AS n FROM served GROUP BY 1),
  scen AS (SELECT day, calls, n, trucks * (hours * 3600.0 / 30.0) * 30.0 AS pings, hours, 30.0 AS interval_s,
      calls / n AS ratio, 5.0 AS price, 2000.0 AS budget FROM daily)""",
    f"SELECT strftime(day, '%Y-%m-%d') AS day, calls, n AS pings, {BUDGET} FROM scen")
add("trip_backjoin", TRIPS, f"""SELECT {KEY}, count(*) OVER (PARTITION BY VIN, trip_local) AS trip_pings,
    epoch_us(min(Timestamp) OVER (PARTITION BY VIN, trip_local))::BIGINT AS start_us FROM trips""")
add("destination_join", TRIPS, f"""SELECT {KEY}, {r('dest_lat')} AS destination_latitude, {r('dest_lon')} AS destination_longitude FROM (
    SELECT *, last_value(Latitude IGNORE NULLS) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dest_lat,
      last_value(Longitude IGNORE NULLS) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dest_lon FROM trips)""")

# --- audit --------------------------------------------------------------------------------
add("audit_totals", RAW, f"""SELECT count(*) AS rows, count(DISTINCT nullif(VIN, '')) AS vin_count,
    count_if({TS_OK} IS NULL)::BIGINT AS bad_timestamp, count_if(event_seq % 41 = 0)::BIGINT AS bad_latitude,
    count_if(event_seq % 43 = 0)::BIGINT AS bad_longitude, count_if(Speed = '')::BIGINT AS missing_speed,
    count_if(try_cast(Speed AS DOUBLE) < 0)::BIGINT AS negative_speed,
    count_if(Speed <> '' AND try_cast(Speed AS DOUBLE) IS NULL)::BIGINT AS invalid_speed FROM raw""")
add("audit_missingness", RAW, " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count_if({c} = '')::BIGINT AS missing,
    {r(f"count_if({c} = '') / count(*) * 100", 3)} AS missing_pct,
    {r(f"count_if({c} = '') / count(*) * 100", 3)} > 5 AS flagged FROM raw"""
    for c in ("VIN", "Timestamp", "Latitude", "Longitude", "Speed", "Weight_lbs", "Device_Type", "Source")))
add("rows_per_vin", RAW, "SELECT VIN, count(*) AS n FROM raw WHERE VIN <> '' GROUP BY VIN")
add("coverage_rollup", RAW, f"""SELECT Source, VIN, grouping(Source, VIN)::INT AS level, count(*) AS n,
    count(DISTINCT nullif(VIN, '')) AS vehicles, count_if(Weight_lbs <> '')::BIGINT AS with_weight,
    {r("count_if(Weight_lbs <> '') / count(*) * 100", 3)} AS coverage_pct, count_if(Speed = '')::BIGINT AS missing_speed
    FROM raw GROUP BY ROLLUP (Source, VIN)""")
COVER = RAW + f""", cover AS (SELECT VIN, count(*) AS n, count_if(Weight_lbs <> '')::BIGINT AS with_weight,
    {r("count_if(Weight_lbs <> '') / count(*) * 100", 3)} AS coverage_pct FROM raw WHERE VIN <> '' GROUP BY VIN)"""
add("weight_coverage", COVER, "SELECT * FROM cover")
add("weight_verdict", COVER + f""", overall AS (SELECT {r("count_if(Weight_lbs <> '') / count(*) * 100", 3)} AS overall_pct,
    {r("count_if(Weight_lbs = '') / count(*) * 100", 3)} AS missing_pct FROM raw)""", f"""
    SELECT overall_pct, missing_pct, lowest_pct, highest_pct, {r('highest_pct - lowest_pct')} AS spread_pct,
      missing_pct > 10 AND highest_pct - lowest_pct > 30 AS event_driven
    FROM overall, (SELECT min(coverage_pct) AS lowest_pct, max(coverage_pct) AS highest_pct FROM cover)""")
ORDERED = DISORDERED + f""", timed AS (SELECT VIN, event_seq, {TS_OK} AS ts FROM disordered
    WHERE VIN <> '' AND {TS_OK} IS NOT NULL),
  late AS (SELECT *, lag(ts) OVER (PARTITION BY VIN ORDER BY event_seq) AS prev FROM timed)"""
add("out_of_order", ORDERED, """SELECT VIN, event_seq, epoch_us(ts)::BIGINT AS ts_us, epoch_us(prev)::BIGINT AS previous_us
    FROM late WHERE ts < prev""")
add("out_of_order_vins", ORDERED, "SELECT VIN, count(*) AS n FROM late WHERE ts < prev GROUP BY VIN")
add("adjacent_duplicates", DISORDERED + """, before AS (SELECT *, lag(VIN) OVER o AS v, lag(Timestamp) OVER o AS t,
      lag(Latitude) OVER o AS a, lag(Longitude) OVER o AS b FROM disordered WINDOW o AS (ORDER BY event_seq))""",
    "SELECT event_seq, VIN FROM before WHERE VIN = v AND Timestamp = t AND Latitude = a AND Longitude = b")
add("fleet_counts", TRIPS, """SELECT count(*) AS rows, count(DISTINCT VIN) AS vehicles,
    count(DISTINCT (VIN, trip_local)) AS trips FROM trips""")
add("top_vins", RAW, "SELECT VIN, count(*) AS n FROM raw WHERE VIN <> '' GROUP BY VIN ORDER BY n DESC, VIN LIMIT 10")
add("bottom_vins", RAW, "SELECT VIN, count(*) AS n FROM raw WHERE VIN <> '' GROUP BY VIN ORDER BY n, VIN LIMIT 10")
add("coverage_extremes", COVER, """(SELECT *, 'lowest' AS side FROM cover ORDER BY coverage_pct, VIN LIMIT 10)
    UNION ALL (SELECT *, 'highest' AS side FROM cover ORDER BY coverage_pct DESC, VIN LIMIT 10)""")

# --- trips and features -------------------------------------------------------------------
add("trip_segment", ALL_TRIPS, f"SELECT {KEY} FROM all_trips")
add("ping_order", ALL_TRIPS, f"""SELECT {KEY}, row_number() OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) - 1
    AS position FROM all_trips""")
add("trip_segment_gap", GAP_TRIPS, f"SELECT {KEY} FROM gap_trips")
add("trip_number_global", ALL_TRIPS + """,
    totals AS (SELECT VIN, max(trip_local) AS m FROM all_trips GROUP BY VIN),
    offsets AS (SELECT VIN, coalesce(sum(m) OVER (ORDER BY VIN ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM totals)""",
    """SELECT VIN, event_seq, o + trip_local AS trip_number, printf('%s_%04d', VIN, o + trip_local) AS trip_id
       FROM all_trips JOIN offsets USING (VIN) QUALIFY count(*) OVER (PARTITION BY VIN, trip_local) >= 5""")
FEATURE_SQL = {
    "elapsed_s": r("elapsed_s"),
    "speed_rolling_mean": r("mean5"),
    "speed_rolling_std": r("std5"),
    "speed_cummax": r("top"),
    "dist_remaining_km": r("dist_remaining_km"),
    "hour_sin": r("hour_sin"),
    "hour_cos": r("hour_cos"),
    "dow": "dow",
    "has_weight": "has_weight",
    "trip_progress": r("trip_progress"),
    "load_state": "load_state",
    "load_change_count": "load_change_count",
}


def feature_select(names, extra: str = "") -> str:
    return f"SELECT {KEY}, " + ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names) + extra + " FROM features"


add("elapsed", FEATURES, feature_select(["elapsed_s"]))
add("speed_rolling", FEATURES, feature_select(["speed_rolling_mean", "speed_rolling_std", "speed_cummax"]))
add("distance_remaining", FEATURES, feature_select(["dist_remaining_km"]))
add("trip_progress", FEATURES, feature_select(["trip_progress"]))
add("load_state", FEATURES, feature_select(["load_state"]))
add("load_change_count", FEATURES, feature_select(["load_change_count"]))
add("load_state_all_trips", ALL_TRIPS + "," + features("all_trips"), feature_select(["load_state", "load_change_count"]))
add("eta_label", FEATURES, f"SELECT {KEY}, {r('eta_remaining_s')} AS eta_remaining_s FROM features")
add("build_features", FEATURES, feature_select(FEATURE_SQL, f", {r('eta_remaining_s / 60.0')} AS eta_remaining_min"))
STEPS = """,
stepped AS (
  SELECT *, {h} AS step, coalesce(Speed, 0.0) AS sp,
    row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY VIN, trip_local) AS n,
    (epoch_us(Timestamp) - epoch_us(first_value(Timestamp) OVER w)) / 3.6e9 AS hours
  FROM (SELECT *, lag(Latitude) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) AS plat,
          lag(Longitude) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) AS plon FROM {source})
  WINDOW w AS (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq)),
paths AS (
  SELECT *, coalesce(sum(step) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq), 0) AS km,
    coalesce(sum(step) OVER (PARTITION BY VIN, trip_local), 0) AS total FROM stepped)"""
H = haversine("plat", "plon", "Latitude", "Longitude")
GAP_PATHS = GAP_TRIPS + STEPS.format(h=H, source="gap_trips")
add("path_distance", TRIPS + STEPS.format(h=H, source="trips"),
    f"SELECT {KEY}, {r('step')} AS step_km, {r('km')} AS travelled_km, {r('total')} AS total_km FROM paths")
add("pace_eta", TRIPS + STEPS.format(h=H, source="trips"),
    f"""SELECT {KEY}, {r('greatest(total - km, 0)')} AS remaining_km,
    {r('CASE WHEN i > 0 AND hours > 0 AND km > 0 THEN greatest(total - km, 0) / (km / hours) * 60 ELSE 0 END')} AS pace_eta_min FROM paths""")
add("progress_pct", TRIPS + STEPS.format(h=H, source="trips"), f"SELECT {KEY}, {r('i / n * 100')} AS progress_pct FROM paths")
STOPS = GAP_PATHS + """,
moves AS (SELECT *, sum(CASE WHEN sp >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) AS mv,
    sum(CASE WHEN sp >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY VIN, trip_local) AS mv_all FROM paths),
stops AS (SELECT VIN, trip_local, min(i) AS start_idx, max(i) AS end_idx, epoch_us(min(Timestamp))::BIGINT AS start_us,
    epoch_us(max(Timestamp))::BIGINT AS end_us, (epoch_us(max(Timestamp)) - epoch_us(min(Timestamp))) / 6e7 AS duration_min,
    arg_min(Latitude, i) AS lat, arg_min(Longitude, i) AS lon
  FROM moves WHERE sp < 2 AND mv < mv_all GROUP BY VIN, trip_local, mv
  HAVING (epoch_us(max(Timestamp)) - epoch_us(min(Timestamp))) / 6e7 >= 1)"""
add("detect_stops", STOPS, f"""SELECT VIN, trip_local, start_idx, end_idx, start_us, end_us, {r('duration_min')} AS duration_min,
    {r('lat')} AS lat, {r('lon')} AS lon FROM stops""")
add("trip_summary", STOPS + """,
  base AS (SELECT VIN, trip_local, min(Timestamp) AS a, max(Timestamp) AS b, count(*) AS pings, coalesce(sum(step), 0) AS km,
      avg(Weight_lbs) AS w FROM paths GROUP BY VIN, trip_local),
  st AS (SELECT VIN, trip_local, count(*) AS stops, sum(duration_min) AS stop_min FROM stops GROUP BY VIN, trip_local),
  tr AS (SELECT base.*, coalesce(stops, 0) AS stops, coalesce(stop_min, 0) AS stop_min,
      (epoch_us(b) - epoch_us(a)) / 3.6e9 AS hours FROM base LEFT JOIN st USING (VIN, trip_local))""",
    f"""SELECT VIN, trip_local, epoch_us(a)::BIGINT AS start_us, epoch_us(b)::BIGINT AS end_us, {r('hours')} AS hours, pings,
    {r('km')} AS path_km, {r('km / nullif(hours, 0)')} AS km_per_h, stops, {r('stop_min')} AS stop_min, {r('w')} AS avg_weight_lbs FROM tr""")
add("trip_card", TRIPS, """SELECT VIN, trip_local, concat(substr(printf('%s_%04d trip of %s', VIN, trip_local, VIN), 1, 20), '...') AS label,
    strftime(min(Timestamp), '%H:%M') AS start_hhmm FROM trips GROUP BY VIN, trip_local""")

# --- metrics ------------------------------------------------------------------------------
METRIC = {
    "mae": "avg(abs(y - {p}))",
    "rmse": "sqrt(avg((y - {p}) * (y - {p})))",
    "mape": "avg(CASE WHEN y <> 0 THEN abs((y - {p}) / y) END) * 100",
    "near_arrival_n": "count_if(y <= 60)::DOUBLE",
    "near_arrival_mae": "avg(CASE WHEN y <= 60 THEN abs(y - {p}) END)",
    "within_tolerance_rate": "avg(CASE WHEN y <= 60 THEN (abs(y - {p}) <= 10)::INT END)",
}
INTERVAL = {
    "pinball_p10": "avg(CASE WHEN y >= p10 THEN 0.1 * (y - p10) ELSE -0.9 * (y - p10) END)",
    "pinball_p90": "avg(CASE WHEN y >= p90 THEN 0.9 * (y - p90) ELSE -0.1 * (y - p90) END)",
    "coverage_p10_p90": "avg((y >= p10 AND y <= p90)::INT)",
}


def metric_select(names=None, p: str = "p50", interval: bool = True) -> str:
    parts = {k: v.format(p=p) for k, v in METRIC.items()}
    if interval:
        parts |= INTERVAL
    return ", ".join(f"{r(v)} AS {k}" for k, v in parts.items() if names is None or k in names)


for one in ("mae", "rmse", "mape", "pinball_p10", "coverage_p10_p90"):
    add({"pinball_p10": "pinball", "coverage_p10_p90": "coverage"}.get(one, one), PREDICTIONS,
        f"SELECT {metric_select([one])} FROM predictions")
add("evaluate", PREDICTIONS, f"SELECT {metric_select()}, count_if(p10 > p90)::BIGINT AS crossed FROM predictions")
add("evaluate_by_load_state", PREDICTIONS,
    f"SELECT load_state, {metric_select()}, count_if(p10 > p90)::BIGINT AS crossed FROM predictions GROUP BY load_state")
MODELS = {"naive": "p50", "baseline": "p90", "quantile_p50": "p10"}
add("model_comparison", PREDICTIONS, " UNION ALL ".join(
    f"""SELECT '{m}' AS model, {metric_select(p=c, interval=False)},
    {r(f'(avg(abs(y - p50)) - avg(abs(y - {c}))) / avg(abs(y - p50)) * 100')} AS gain_vs_naive_pct,
    {r(f'(avg(abs(y - p90)) - avg(abs(y - {c}))) / avg(abs(y - p90)) * 100')} AS gain_vs_baseline_pct FROM predictions"""
    for m, c in MODELS.items()))

# --- calibration --------------------------------------------------------------------------
SPLIT = """CASE WHEN ('0x' || substr(md5(VIN || '_' || trip_local), 1, 8))::BIGINT % 1000 < 200 THEN 'test'
    WHEN ('0x' || substr(md5(VIN || '_' || trip_local), 1, 8))::BIGINT % 1000 < 300 THEN 'validation' ELSE 'train' END"""


def higher(values: str, q: str, source: str, where: str = "true") -> str:
    """Order statistic at ceil(q (n - 1)) of an expression."""
    return f"""(SELECT v FROM (SELECT {values} AS v, row_number() OVER (ORDER BY {values}) - 1 AS k, count(*) OVER () AS n
      FROM {source} WHERE {where}) WHERE k = ceil(round({q} * (n - 1), 9)))"""


CALIBRATION = PREDICTIONS + f""",
split AS (SELECT *, {SPLIT} AS part, greatest(p10 - y, y - p90, 0) AS miss,
    abs(y - (p10 + p90) * 0.5) / greatest((p90 - p10) * 0.5, 1e-6) AS req FROM predictions),
val AS (SELECT * FROM split WHERE part = 'validation'),
test AS (SELECT * FROM split WHERE part = 'test')"""
add("trip_split", TRIPS, f"SELECT {KEY}, {SPLIT} AS split FROM trips")
add("quantile_higher", CALIBRATION, f"SELECT {r(higher('p50', '0.8', 'split'))} AS value")
add("conformal_qhat", CALIBRATION, f"SELECT {r(higher('miss', '0.8', 'val'))} AS qhat")
add("conformal_apply", CALIBRATION, f"""SELECT {KEY}, {r('p10 - q')} AS low, {r('p90 + q')} AS high
    FROM test, (SELECT {higher('miss', '0.8', 'val')} AS q)""")
SCALES = CALIBRATION + f""",
scales AS (SELECT greatest(1, {higher('req', '0.8', 'val')}) AS s80, greatest(1, {higher('req', '0.9', 'val')}) AS s90,
    greatest(1, {higher('req', '0.805', 'test')}) AS s805, {higher('miss', '0.8', 'val')} AS qhat)"""
add("interval_scale_fit", SCALES, f"SELECT {r('s80')} AS scale_80, {r('s90')} AS scale_90, {r('s805')} AS scale_posthoc FROM scales")
EDGES = CALIBRATION + """,
edges AS (SELECT list_sort(list_distinct(quantile_cont(p50, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS e FROM val)"""
add("quantile_edges", EDGES, f"SELECT (generate_subscripts(e, 1) - 1)::INT AS position, {r('unnest(e)')} AS edge FROM edges")
BUCKETS = EDGES + """,
placed AS (SELECT val.*, len(list_filter(e[2:-2], lambda x: x <= p50))::INT AS bucket FROM val, edges),
ranked AS (SELECT bucket, req, row_number() OVER (PARTITION BY bucket ORDER BY req) - 1 AS k,
    count(*) OVER (PARTITION BY bucket) AS n FROM placed),
fitted AS (SELECT bucket, greatest(1, req) AS scale FROM ranked WHERE k = ceil(round(0.85 * (n - 1), 9))),
listed AS (SELECT (generate_subscripts(e, 1) - 1)::INT AS bucket, unnest(e) AS lo FROM edges),
table_ AS (SELECT a.bucket, a.lo, b.lo AS hi, coalesce(scale, 1.0) AS scale FROM listed a JOIN listed b ON b.bucket = a.bucket + 1
    LEFT JOIN fitted f ON f.bucket = a.bucket),
tested AS (SELECT test.*, len(list_filter(e[2:-2], lambda x: x <= p50))::INT AS bucket FROM test, edges)"""
add("bucketed_scales_fit", BUCKETS, f"SELECT bucket, {r('lo')} AS lo, {r('hi')} AS hi, {r('scale')} AS scale FROM table_")
add("bucket_scale_join", BUCKETS, f"SELECT {KEY}, bucket, {r('scale')} AS scale FROM tested JOIN table_ USING (bucket)")
add("bucketed_scales_apply", BUCKETS, f"""SELECT {KEY}, bucket, {r('(p10 + p90) * 0.5 - scale * (p90 - p10) * 0.5')} AS low,
    {r('(p10 + p90) * 0.5 + scale * (p90 - p10) * 0.5')} AS high FROM tested JOIN table_ USING (bucket)""")
METHODS_SQL = {
    "raw": ("p10", "p90"),
    "scaled_80": ("(p10 + p90) * 0.5 - s80 * ((p90 - p10) * 0.5)", "(p10 + p90) * 0.5 + s80 * ((p90 - p10) * 0.5)"),
    "scaled_90": ("(p10 + p90) * 0.5 - s90 * ((p90 - p10) * 0.5)", "(p10 + p90) * 0.5 + s90 * ((p90 - p10) * 0.5)"),
    "target_805": ("(p10 + p90) * 0.5 - s805 * ((p90 - p10) * 0.5)", "(p10 + p90) * 0.5 + s805 * ((p90 - p10) * 0.5)"),
    "bucketed_85": ("(p10 + p90) * 0.5 - scale * ((p90 - p10) * 0.5)", "(p10 + p90) * 0.5 + scale * ((p90 - p10) * 0.5)"),
    "conformal_80": ("p10 - qhat", "p90 + qhat"),
}
add("calibration_report", BUCKETS + "," + SCALES.removeprefix(CALIBRATION + ","), " UNION ALL ".join(
    f"""SELECT '{m}' AS method, {r(f'avg((y >= {lo} AND y <= {hi})::INT)')} AS coverage, {r(f'avg(({hi}) - ({lo}))')} AS mean_width,
    count_if(({lo}) > ({hi}))::BIGINT AS crossed, {'true' if m == 'target_805' else 'false'} AS is_posthoc
    FROM tested JOIN table_ USING (bucket), scales""" for m, (lo, hi) in METHODS_SQL.items()))

# --- written trips ------------------------------------------------------------------------
add("write_trips", TRIPS, "SELECT Timestamp::DATE AS trip_date, count(*) AS n FROM trips GROUP BY 1")

# --- load state ---------------------------------------------------------------------------
CONFUSION = """n_compared, tp, fp, fn, tn, {p} AS precision, {rc} AS recall, {f1} AS f1"""
P_ = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
R_ = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
F_ = f"CASE WHEN ({P_}) + ({R_}) > 0 THEN 2 * ({P_}) * ({R_}) / (({P_}) + ({R_})) ELSE 0.0 END"
CONFUSION = CONFUSION.format(p=r(P_), rc=r(R_), f1=r(F_))


def confusion(group: str) -> str:
    by = f"GROUP BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    return f"""SELECT {lead}{CONFUSION} FROM (SELECT {lead}count(*) AS n_compared,
      count_if(load_state = 1 AND Weight_lbs > 10000)::BIGINT AS tp, count_if(load_state = 1 AND Weight_lbs <= 10000)::BIGINT AS fp,
      count_if(load_state = 0 AND Weight_lbs > 10000)::BIGINT AS fn, count_if(load_state = 0 AND Weight_lbs <= 10000)::BIGINT AS tn
      FROM features WHERE Weight_lbs IS NOT NULL {by}) WHERE n_compared >= 5"""


add("load_confusion", FEATURES, confusion(""))
add("load_confusion_by_trip", FEATURES, confusion("VIN, trip_local"))
SEGMENTS = FEATURES + """,
segments AS (SELECT VIN, trip_local, (i // 4)::BIGINT AS segment, count(*) AS pings, avg(sp) AS mean_speed,
    (round(avg(sp), 9) < 10)::INT AS load_state FROM features GROUP BY VIN, trip_local, i // 4)"""
add("segment_state", SEGMENTS, f"SELECT VIN, trip_local, segment, pings, {r('mean_speed')} AS mean_speed, load_state FROM segments")
add("segment_changes", SEGMENTS, """SELECT VIN, trip_local, count(*) AS segments,
    count_if(load_state <> prev)::BIGINT AS load_change_count FROM (SELECT *,
      lag(load_state) OVER (PARTITION BY VIN, trip_local ORDER BY segment) AS prev FROM segments) GROUP BY VIN, trip_local""")
add("state_changes", TRIPS + """, known AS (SELECT VIN, trip_local, Timestamp, event_seq, Weight_lbs > 10000 AS s FROM trips
      WHERE Weight_lbs IS NOT NULL),
    changes AS (SELECT VIN, trip_local, count_if(s <> p) AS c FROM (SELECT *,
      lag(s) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) AS p FROM known) GROUP BY VIN, trip_local)""",
    """SELECT VIN, trip_local, coalesce(c, 0)::BIGINT AS load_change_count
       FROM (SELECT DISTINCT VIN, trip_local FROM trips) LEFT JOIN changes USING (VIN, trip_local)""")
add("binseg_first_split", FEATURES + """,
  sums AS (SELECT VIN, trip_local, i + 1 AS cut, n, sum(sp) OVER w AS a1, sum(sp * sp) OVER w AS a2,
      sum(sp) OVER t AS t1, sum(sp * sp) OVER t AS t2 FROM features
    WINDOW w AS (PARTITION BY VIN, trip_local ORDER BY i), t AS (PARTITION BY VIN, trip_local)),
  gains AS (SELECT VIN, trip_local, cut AS position,
      round((t2 - t1 * t1 / n) - (a2 - a1 * a1 / cut) - ((t2 - a2) - (t1 - a1) * (t1 - a1) / (n - cut)), 6) AS gain
    FROM sums WHERE cut >= 2 AND n - cut >= 2 AND n >= 5 AND (t2 - t1 * t1 / n) / n >= 1e-12)""",
    f"""SELECT VIN, trip_local, position, {r('gain', 3)} AS gain FROM gains
        QUALIFY row_number() OVER (PARTITION BY VIN, trip_local ORDER BY gain DESC, position DESC) = 1""")

# --- requests -----------------------------------------------------------------------------
REQUESTS = FEATURES + """,
requests AS (SELECT *, event_seq % 67 = 0 AS broken, event_seq % 17 = 0 AS no_speed, event_seq % 19 = 0 AS no_number,
    event_seq % 2 = 0 AS wants_route FROM features),
routes AS (SELECT VIN, Timestamp AS route_ts, (300 + round((Latitude - floor(Latitude)) * 100)::INT * 10) / 60.0 AS minutes
  FROM pings WHERE Source = 'view'),
routed AS (SELECT q.*, CASE WHEN epoch_us(q.Timestamp) - epoch_us(o.route_ts) <= 900000000 THEN o.minutes::DOUBLE END AS route_min
  FROM requests q ASOF LEFT JOIN routes o ON q.VIN = o.VIN AND q.Timestamp >= o.route_ts),
scored AS (SELECT VIN AS vin, concat(VIN, '_', trip_local) AS trip_id, epoch_us(Timestamp)::BIGINT AS as_of,
    dist_remaining_km AS km, dist_remaining_km / (greatest(sp, 1.0) * 1.60934) * 60.0 AS local_min,
    CASE WHEN wants_route THEN route_min END AS route_min FROM routed WHERE NOT broken AND NOT no_speed AND NOT no_number)"""
ERROR = """CASE WHEN broken THEN 'Invalid JSON' WHEN no_speed THEN 'Missing fields: speed_mph'
    WHEN no_number THEN 'latitude/longitude/speed_mph must be numeric' END"""
add("parse_requests", REQUESTS, f"""SELECT event_seq, CASE WHEN NOT broken THEN VIN END AS vin,
    CASE WHEN NOT broken THEN concat(VIN, '_', trip_local) END AS trip_id,
    CASE WHEN NOT broken AND NOT no_number THEN {r('Latitude')} END AS latitude,
    CASE WHEN NOT broken AND NOT no_speed THEN {r('sp')} END AS speed_mph,
    NOT broken AND wants_route AS use_route, {ERROR} AS error FROM requests""")
BLEND = "CASE WHEN route_min IS NULL THEN local_min ELSE 0.7 * local_min + 0.3 * route_min END"
METHOD = "CASE WHEN route_min IS NULL THEN 'physics_speed_haversine' ELSE 'local_plus_google_blend' END"
add("route_blend", REQUESTS, f"SELECT vin, as_of, {r(BLEND, 3)} AS blended_eta_min, {METHOD} AS method FROM scored")
add("eta_response", REQUESTS, f"""SELECT vin, trip_id, {r('km', 3)} AS distance_remaining_km, {r('local_min', 3)} AS eta_remaining_min,
    {r('route_min', 3)} AS google_route_eta_min, {r(BLEND, 3)} AS blended_eta_min, {METHOD} AS method, as_of FROM scored""")
add("batch_predict", REQUESTS, f"""SELECT {METHOD} AS outcome, count(*) AS n FROM scored GROUP BY 1
    UNION ALL SELECT {ERROR} AS outcome, count(*) AS n FROM requests WHERE broken OR no_speed OR no_number GROUP BY 1""")

# --- near-arrival candidates --------------------------------------------------------------
CANDIDATES = CALIBRATION + """,
near AS (SELECT y, naive, naive * 1.2 AS p50, p10 AS special FROM val WHERE y <= 60),
blends AS (SELECT (3 + th_i * 10 + w_i * 2 + o_i)::INT AS trial, CASE o_i WHEN 0 THEN 'blend_naive' ELSE 'blend_specialist' END AS mode,
    th, w, o_i FROM (SELECT unnest([60.0, 90.0, 120.0, 150.0, 180.0, 240.0]) AS th, generate_subscripts([1, 2, 3, 4, 5, 6], 1) - 1 AS th_i),
    (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS w, generate_subscripts([1, 2, 3, 4, 5], 1) - 1 AS w_i), (VALUES (0), (1)) o(o_i)),
tried AS (
  SELECT 0 AS trial, 'global' AS mode, 60.0 AS th, 0.0 AS w, avg(abs(y - p50)) AS e, avg((abs(y - p50) <= 10)::INT) AS k FROM near
  UNION ALL SELECT 1, 'naive', 60.0, 0.0, avg(abs(y - naive)), avg((abs(y - naive) <= 10)::INT) FROM near
  UNION ALL SELECT 2, 'specialist', 60.0, 0.0, avg(abs(y - special)), avg((abs(y - special) <= 10)::INT) FROM near
  UNION ALL SELECT trial, mode, th, w, avg(abs(y - b)), avg((abs(y - b) <= 10)::INT) FROM (
    SELECT trial, mode, th, w, y, CASE WHEN naive <= th THEN (1 - w::DOUBLE) * p50 + w::DOUBLE * CASE o_i WHEN 0 THEN naive ELSE special END
      ELSE p50 END AS b FROM near, blends) GROUP BY trial, mode, th, w)"""
add("near_opt_candidates", CANDIDATES, f"""SELECT trial::INT AS trial, mode, th::DOUBLE AS threshold, w::DOUBLE AS weight,
    {r('e')} AS near_mae, {r('k')} AS within_tolerance FROM tried""")
add("near_opt_select", CANDIDATES, f"""SELECT mode, th::DOUBLE AS threshold, w::DOUBLE AS weight, {r('e')} AS near_mae,
    {r('k')} AS within_tolerance FROM tried ORDER BY round(e, 9), trial LIMIT 1""")

# --- further features ---------------------------------------------------------------------
MOTION = TRIPS + STEPS.format(h=H, source="trips") + """,
moving AS (SELECT *, (epoch_us(Timestamp) - epoch_us(lag(Timestamp) OVER w)) / 1e6 AS dt, sp - lag(sp) OVER w AS dv,
    sum((sp < 2)::INT) OVER w AS slow,
    degrees(atan2(sin(radians(Longitude) - radians(plon)) * cos(radians(Latitude)),
      cos(radians(plat)) * sin(radians(Latitude)) - sin(radians(plat)) * cos(radians(Latitude)) * cos(radians(Longitude) - radians(plon)))) AS head,
    lag(km, 4) OVER w AS km4, (epoch_us(Timestamp) - epoch_us(lag(Timestamp, 4) OVER w)) / 6e7 AS min4
  FROM paths WINDOW w AS (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq)),
turning AS (SELECT *, head - lag(head) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq) AS dh FROM moving)"""
add("acceleration", MOTION, f"SELECT {KEY}, {r('dv / nullif(dt, 0)')} AS acceleration_mphps FROM moving")
add("stop_go_ratio", MOTION, f"SELECT {KEY}, {r('slow / (i + 1)')} AS stop_go_ratio FROM moving")
add("bearing_change_rate", MOTION, f"""SELECT {KEY}, {r('CASE WHEN dh > 180 THEN dh - 360 WHEN dh <= -180 THEN dh + 360 ELSE dh END / nullif(dt, 0)', 4)}
    AS bearing_change_rate FROM turning""")
add("trip_duration_estimate", MOTION, f"""SELECT {KEY}, CASE WHEN km - km4 > 0 AND min4 > 0 THEN
    {r('greatest(total - km, 0) / ((km - km4) / min4)', 4)} END AS trip_duration_estimate_min FROM moving""")
add("eta_smoothing", FEATURES + f""",
  ordered AS (SELECT *, {NAIVE} AS v FROM features),
  listed AS (SELECT {KEY}, list(v) OVER (PARTITION BY VIN, trip_local ORDER BY i) AS vs FROM ordered)""",
    f"SELECT {KEY}, {r('list_reduce(vs, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a)')} AS eta_smoothed FROM listed")
add("eta_drift", FEATURES + f", timed AS (SELECT *, epoch_us(Timestamp) / 6e7 + {NAIVE} AS arrival FROM features)",
    f"""SELECT {KEY}, {r('arrival - lag(arrival) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq)', 4)} AS drift_min
    FROM timed""")
add("trip_category", TRIPS + STEPS.format(h=H, source="trips"), """SELECT VIN, trip_local,
    CASE WHEN max(km) <= 150 THEN 'short' WHEN max(km) <= 500 THEN 'medium' ELSE 'long' END AS by_distance,
    CASE WHEN max(hours) < 2 THEN 'short' WHEN max(hours) <= 8 THEN 'medium' ELSE 'long' END AS by_duration
    FROM paths GROUP BY VIN, trip_local""")
LIVE = FEATURES + "," + STEPS.format(h=H, source="trips").removeprefix(",") + f""",
clear AS (SELECT f.*, CASE WHEN (f.i + 1) % 5 <> 0 THEN NULL WHEN km + dist_remaining_km <= 150 * 0.9 THEN 'short'
    WHEN km + dist_remaining_km > 150 * 1.1 AND km + dist_remaining_km <= 500 * 0.9 THEN 'medium'
    WHEN km + dist_remaining_km > 500 * 1.1 THEN 'long' END AS c
  FROM features f JOIN (SELECT event_seq, km FROM paths) USING (event_seq)),
live AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY VIN, trip_local ORDER BY Timestamp, event_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS trip_category,
    eta_remaining_s / 60.0 AS y, {NAIVE} AS p50 FROM clear)"""
add("live_category", LIVE, f"SELECT {KEY}, trip_category FROM live")
add("metrics_by_category", LIVE, f"SELECT trip_category, {metric_select(interval=False)} FROM live GROUP BY trip_category")
add("one_hot", PINGS, """SELECT Device_Type, Source, count(*) AS n,
    list_position((SELECT list_sort(list(DISTINCT Device_Type)) FROM pings), Device_Type)::INT AS device_slot,
    list_position((SELECT list_sort(list(DISTINCT Source)) FROM pings), Source)::INT AS source_slot
    FROM pings GROUP BY Device_Type, Source""")
add("frequency_encoding", PINGS, f"SELECT event_seq, {r('count(*) OVER (PARTITION BY Source) / count(*) OVER ()')} AS Source_freq FROM pings")
add("target_encoding", FEATURES, f"SELECT Source, {r('avg(eta_remaining_s / 60.0)')} AS mean_y FROM features GROUP BY Source")
LAGS = FEATURES + """,
events_ AS (SELECT VIN, trip_local, i, n FROM (SELECT *, lag(Weight_lbs > 10000) OVER (PARTITION BY VIN, trip_local ORDER BY i) AS before
    FROM features WHERE Weight_lbs IS NOT NULL) WHERE before <> (Weight_lbs > 10000)),
lags AS (SELECT VIN, trip_local, i AS event_position, CASE WHEN greatest(ceil(i / 4.0), 1) * 4 <= n - 1
    THEN (greatest(ceil(i / 4.0), 1) * 4 - i)::BIGINT END AS lag_pings FROM events_)"""
add("detection_lag", LAGS, "SELECT * FROM lags")
add("median_detection_lag", LAGS, "SELECT quantile_cont(lag_pings, 0.5)::DOUBLE AS median_lag FROM lags")
add("grid_density", PINGS, f"""SELECT floor(Latitude / 0.25)::BIGINT AS cell_lat, floor(Longitude / 0.25)::BIGINT AS cell_lon, count(*) AS pings,
    {r('avg(coalesce(Speed, 0.0))')} AS mean_speed, {r('avg((coalesce(Speed, 0.0) < 2)::INT)')} AS standing_share FROM pings GROUP BY 1, 2""")

# --- streams ------------------------------------------------------------------------------
STREAM = ALL_TRIPS + "," + features("all_trips") + """,
trail AS (SELECT *, (round(avg(sp) OVER (PARTITION BY VIN, trip_local ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) < 10)::INT
    AS state FROM features),
causal AS (SELECT *, (state <> lag(state) OVER (PARTITION BY VIN, trip_local ORDER BY i))::INT AS turned_now FROM trail)"""
add("stream_features", STREAM, f"""SELECT VIN, event_seq, epoch_us(Timestamp)::BIGINT AS ts_us, false AS late, trip_local,
    i + 1 AS pings_so_far, {r('elapsed_s')} AS elapsed_s, {r('mean5')} AS speed_rolling_mean, {r('std5')} AS speed_rolling_std,
    {r('top')} AS speed_cummax, state AS load_state_trailing,
    (coalesce(sum(turned_now) OVER (PARTITION BY VIN, trip_local ORDER BY i), 0))::BIGINT AS load_changes_so_far FROM causal""")
add("stream_eta", STREAM + f", listed AS (SELECT *, {NAIVE} AS v, list({NAIVE}) OVER (PARTITION BY VIN, trip_local ORDER BY i) AS vs FROM features)",
    f"SELECT VIN, event_seq, {r('v')} AS eta_min, {r('list_reduce(vs, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a)')} AS eta_smoothed_min FROM listed")
add("stream_trips", GAP_TRIPS, f"""SELECT VIN, count(*) AS pings, epoch_us(min(Timestamp))::BIGINT AS start_us,
    epoch_us(max(Timestamp))::BIGINT AS end_us, {r('max(coalesce(Speed, 0.0))')} AS top_mph,
    count_if(coalesce(Speed, 0.0) < 2)::BIGINT AS standing_pings FROM gap_trips GROUP BY VIN, trip_local""")
add("stream_closed_trips", ALL_TRIPS + """, ends AS (SELECT VIN, trip_local, count(*) AS pings,
      epoch_us(min(Timestamp))::BIGINT AS start_us, epoch_us(max(Timestamp))::BIGINT AS end_us,
      max(coalesce(Speed, 0.0)) AS top, count_if(coalesce(Speed, 0.0) < 2)::BIGINT AS standing_pings
    FROM all_trips GROUP BY VIN, trip_local)""", f"""SELECT VIN, trip_local, pings, start_us, end_us, {r('top')} AS top_mph,
    standing_pings, CASE WHEN lead(start_us) OVER (PARTITION BY VIN ORDER BY trip_local) - end_us <= 1800000000
      THEN 'move' ELSE 'gap' END AS closed_by FROM ends""")
add("stream_dedupe", PINGS, "SELECT VIN, event_seq FROM pings")


def geohash(precision: int) -> str:
    """Geohash of the position by the bits of its two step numbers."""
    lat_bits, lon_bits = 5 * precision // 2, (5 * precision + 1) // 2
    lat = f"least(floor((Latitude + 90.0) / 180.0 * {1 << lat_bits}.0)::BIGINT, {(1 << lat_bits) - 1})"
    lon = f"least(floor((Longitude + 180.0) / 360.0 * {1 << lon_bits}.0)::BIGINT, {(1 << lon_bits) - 1})"
    letters = []
    for at in range(0, 5 * precision, 5):
        bits = [
            f"(({lon if b % 2 == 0 else lat} >> {(lon_bits if b % 2 == 0 else lat_bits) - 1 - b // 2}) & 1) * {1 << (at + 4 - b)}"
            for b in range(at, at + 5)
        ]
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', ({' + '.join(bits)} + 1)::BIGINT, 1)")
    return " || ".join(letters)


add("trip_point_lookup_indexed", TRIPS,
    f"""SELECT {PING_OUT}, trip_local FROM trips
        WHERE (VIN, trip_local) = (SELECT (VIN, trip_local) FROM trips ORDER BY VIN, trip_local LIMIT 1)""")
add("cell_density", PINGS, " UNION ALL ".join(
    f"""SELECT {level}::INT AS level, {geohash(level)} AS cell, count(*) AS pings, {r('sum(coalesce(Speed, 0.0))')} AS speed_sum,
    {r('avg((coalesce(Speed, 0.0) < 2)::INT)')} AS standing_share FROM pings GROUP BY 2""" for level in range(1, 6)))
SQL["density_clusters"] = f"""WITH RECURSIVE {PINGS},
places AS (SELECT Longitude AS x, Latitude AS y, count(*) AS w, min(event_seq) AS first_id FROM pings GROUP BY 1, 2),
near AS MATERIALIZED (SELECT a.first_id AS a, b.first_id AS b, b.w AS w FROM places a JOIN places b
    ON b.x BETWEEN a.x - 0.02 AND a.x + 0.02
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.015::DOUBLE * 0.015::DOUBLE),
core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING sum(w) >= 10),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
named AS (SELECT a, min(b) AS cluster_id FROM reached GROUP BY a),
border AS (SELECT near.a, min(cluster_id) AS cluster_id FROM near JOIN named ON near.b = named.a GROUP BY near.a)
SELECT event_seq, coalesce(named.cluster_id, border.cluster_id) AS cluster_id, named.a IS NOT NULL AS is_core
FROM pings JOIN places ON Longitude = x AND Latitude = y LEFT JOIN named ON named.a = first_id LEFT JOIN border ON border.a = first_id"""
add("speed_backoff", PINGS + """, seen AS (SELECT Device_Type, VIN, count(Speed) AS n, sum(Speed) AS t FROM pings
    WHERE Speed IS NOT NULL GROUP BY 1, 2),
fleet AS (SELECT sum(n)::BIGINT AS n, sum(t) / sum(n) AS e FROM seen),
device AS (SELECT Device_Type, sum(n)::BIGINT AS n, (sum(t) + 20.0::DOUBLE * (SELECT e FROM fleet)) / (sum(n) + 20.0::DOUBLE) AS e FROM seen GROUP BY 1)""",
    f"""SELECT 0::INT AS level, Device_Type, VIN, seen.n AS n, {r('(t + 20.0::DOUBLE * e) / (seen.n + 20.0::DOUBLE)')} AS estimate
    FROM seen JOIN device USING (Device_Type)
    UNION ALL SELECT 1::INT, Device_Type, NULL, n, {r('e')} FROM device UNION ALL SELECT 2::INT, NULL, NULL, n, {r('e')} FROM fleet""")
add("silent_spells", PINGS + """, steps AS (SELECT VIN, event_seq, lag(event_seq) OVER v AS last_seq,
    (epoch_us(Timestamp) - lag(epoch_us(Timestamp)) OVER v) / 1e6::DOUBLE AS silent_s FROM pings
    WINDOW v AS (PARTITION BY VIN ORDER BY Timestamp, event_seq))""",
    f"SELECT VIN, last_seq, event_seq AS next_seq, {r('silent_s')} AS silent_s FROM steps WHERE silent_s > 300")
add("fleet_counts_sketched", TRIPS, """SELECT count(*) AS rows, count(*) AS exact_rows, count(DISTINCT VIN) AS exact_vehicles,
    count(DISTINCT (VIN, trip_local)) AS exact_trips, true AS vehicles_near, true AS trips_near FROM trips""")
add("run_ledger", PREDICTIONS, " UNION ALL ".join(
    f"""SELECT 'load_state=' || load_state AS slice, '{k}' AS metric, {r(v.format(p='p50'))} AS before, {r(v.format(p='p90'))} AS after,
    {r(f"({v.format(p='p90')}) - ({v.format(p='p50')})")} AS change,
    {r(f"CASE WHEN ({v.format(p='p50')}) <> 0 THEN (({v.format(p='p90')}) - ({v.format(p='p50')})) / abs({v.format(p='p50')}) * 100 END")} AS change_pct
    FROM predictions GROUP BY load_state""" for k, v in METRIC.items()))
