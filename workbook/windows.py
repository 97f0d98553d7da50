"""Intervals, windows, gates, arrivals and station joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwave.functions.angles import azimuth_degrees, distance_degrees, ellipsoid_path
from quietwave.operators import intervals as I
from quietwave.operators import pairing as J
from quietwave.operators import quality as Q
from quietwave.plans.quiet_noise import quiet_window_statistics, station_noise
from workbook.registry import R, T0, T1, catalogue, ctes, degrees_sql, query, records, rnd, samples, stations, table, traces, travel_times, uniform_sql

MIN, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
LEN, STRIDE, BUF, PANE = 29 * MIN, 3 * MIN, 15 * MIN, MIN
LAT, LON = 35.0, -110.0

_SEL = f"""sel AS (SELECT *, {degrees_sql(str(LAT), str(LON), 'lat', 'lon')} AS degrees FROM catalogue WHERE ts BETWEEN {T0} AND {T1}),
chosen AS (SELECT *, 'far' AS part FROM sel WHERE degrees >= 15 AND mag >= 2.0 UNION ALL SELECT *, 'near' FROM sel WHERE degrees <= 15 AND mag >= 1.0)"""
_PAIR = f"""pairs AS (SELECT c.event_id, c.ts, s.station, {degrees_sql('c.lat', 'c.lon', 's.lat', 's.lon')} AS distance FROM chosen c CROSS JOIN stations s),
arr AS (SELECT p.*, a.first + (p.distance - floor(p.distance)) * (coalesce(b.first, a.first) - a.first) AS first,
 a.last + (p.distance - floor(p.distance)) * (coalesce(b.last, a.last) - a.last) AS last
 FROM pairs p JOIN travel a ON a.distance = floor(p.distance) LEFT JOIN travel b ON b.distance = floor(p.distance) + 1),
black AS (SELECT event_id, min(ts) + min(round(first * 1000000))::BIGINT AS s, min(ts) + max(round(last * 1000000))::BIGINT AS e FROM arr GROUP BY event_id)"""
_MARK = """marked AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM black),
numbered AS (SELECT s, e, before, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
islands AS (SELECT min(s) AS s, max(e) AS e FROM numbered GROUP BY k)"""
_REG = f"""edges AS (SELECT s, e, lag(e) OVER (ORDER BY s) AS p FROM islands),
raw_regions AS (SELECT coalesce(p, {T0}) AS s, s AS e FROM edges UNION ALL SELECT max(e), {T1} FROM islands),
regions AS (SELECT greatest(s, {T0}) AS s, least(e, {T1}) AS e FROM raw_regions WHERE greatest(s, {T0}) < least(e, {T1}))"""
_WIN = f"""grid AS (SELECT s, e, unnest(generate_series(s + {BUF}, e - {BUF}, {STRIDE})) AS ws FROM regions WHERE e - s > {2 * BUF}),
windows AS (SELECT s, e, ws, ws + {LEN} AS we FROM grid WHERE ws + {LEN} < e - {BUF})"""
BASE = ("catalogue", "stations", "travel")
_SEL_FULL = ctes(*BASE) + ", " + _SEL + ", " + _PAIR


def chosen(spark, sf_dir):
    return Q.select_catalogue(catalogue(spark, sf_dir), LAT, LON, T0, T1, 15, 2.0, 15, 1.0)


def pairs(spark, sf_dir):
    st = stations(spark, sf_dir).select("station", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    both = J.with_every(chosen(spark, sf_dir), st)
    return both.withColumn("distance", distance_degrees(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")))


def arrived(spark, sf_dir):
    return J.arrivals(pairs(spark, sf_dir), travel_times(spark), "distance")


def blackouts(spark, sf_dir):
    return I.blackout_per_event(arrived(spark, sf_dir), ["event_id"], "ts", "first", "last")


def regions(spark, sf_dir):
    return I.quiet_regions(blackouts(spark, sf_dir), T0, T1)


def windows(spark, sf_dir):
    return I.sliding_windows(regions(spark, sf_dir), LEN, BUF, STRIDE)


@query("catalogue_selection", ctes("catalogue") + ", " + _SEL + f" SELECT event_id, part, {R('degrees')} AS degrees, {R('mag')} AS mag FROM chosen")
def catalogue_selection(spark, sf_dir):
    return chosen(spark, sf_dir).select("event_id", "part", rnd("degrees").alias("degrees"), rnd("mag").alias("mag"))


@query("event_station_pairs", _SEL_FULL + f" SELECT event_id, station, {R('distance')} AS distance FROM pairs")
def event_station_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("event_id", "station", rnd("distance").alias("distance"))


@query("arrival_lookup", _SEL_FULL + f" SELECT event_id, station, {R('first', 4)} AS first_s, {R('last', 4)} AS last_s, {R('first + 60', 4)} AS station_arrival FROM arr")
def arrival_lookup(spark, sf_dir):
    return arrived(spark, sf_dir).select(
        "event_id", "station", rnd("first", 4).alias("first_s"), rnd("last", 4).alias("last_s"), rnd(J.station_arrival(), 4).alias("station_arrival"))


def phase_table(spark):
    """P and S on an irregular grid, closer at short distances, for three depth bins; P ends at 98 degrees, the table at 120."""
    k = F.col("id").cast("double")
    d = spark.range(0, 181).select((k * k / 270).alias("distance")).withColumn("depth_bin", F.explode(F.array(*[F.lit(b) for b in range(3)])))
    x, deep = F.col("distance"), F.col("depth_bin")
    return d.select("depth_bin", "distance", F.when(x <= 98, 10 * x - 0.02 * x * x - 3 * deep).alias("P"), (18 * x - 0.03 * x * x - 5 * deep).alias("S"))


_PHASES = _SEL_FULL + f""", pt AS (SELECT b AS depth_bin, k * k / 270.0::DOUBLE AS d FROM (SELECT k::DOUBLE AS k FROM generate_series(0, 180) q(k)) CROSS JOIN generate_series(0, 2) z(b)),
ph AS (SELECT *, CASE WHEN d <= 98 THEN 10 * d - 0.02::DOUBLE * d * d - 3 * depth_bin END AS p, 18 * d - 0.03::DOUBLE * d * d - 5 * depth_bin AS s FROM pt),
sg AS (SELECT *, lead(d) OVER w AS d1, lead(p) OVER w AS p1, lead(s) OVER w AS s1 FROM ph WINDOW w AS (PARTITION BY depth_bin ORDER BY d)),
dp AS (SELECT p.*, floor(c.depth / 3)::INTEGER AS depth_bin FROM pairs p JOIN catalogue c USING (event_id)),
iv AS (SELECT dp.event_id, dp.station, CASE WHEN d1 IS NULL THEN p ELSE p + (distance - d) / (d1 - d) * (p1 - p) END AS pt, CASE WHEN d1 IS NULL THEN s ELSE s + (distance - d) / (d1 - d) * (s1 - s) END AS st
 FROM dp LEFT JOIN sg ON dp.depth_bin = sg.depth_bin AND distance >= d AND (distance < d1 OR (d1 IS NULL AND distance = d)))"""


@query("arrival_lookup_depth", _PHASES + f" SELECT event_id, station, {R('least(pt, st)', 4)} AS first_s, {R('greatest(pt, st)', 4)} AS last_s, {R('pt', 4)} AS first_p FROM iv")
def arrival_lookup_depth(spark, sf_dir):
    """Depth bins (some not in the table), pairs beyond its last distance, all phases and P alone."""
    placed = pairs(spark, sf_dir).withColumn("depth_bin", F.floor(F.col("depth") / 3).cast("int"))
    both = J.arrivals(placed, phase_table(spark), "distance", ["depth_bin"], ["P", "S"]).withColumnsRenamed({"first": "first_s", "last": "last_s"})
    alone = J.arrivals(both, phase_table(spark), "distance", ["depth_bin"], first_p=True)
    return alone.select("event_id", "station", rnd("first_s", 4).alias("first_s"), rnd("last_s", 4).alias("last_s"), rnd("first", 4).alias("first_p"))


@query("blackout_intervals", _SEL_FULL + " SELECT event_id, s // 1000 AS s_ms, e // 1000 AS e_ms FROM black")
def blackout_intervals(spark, sf_dir):
    return blackouts(spark, sf_dir).select("event_id", F.floor(F.col("s") / 1000).alias("s_ms"), F.floor(F.col("e") / 1000).alias("e_ms"))


@query("merged_intervals", _SEL_FULL + ", " + _MARK + " SELECT s // 1000 AS s_ms, e // 1000 AS e_ms FROM islands")
def merged_intervals(spark, sf_dir):
    return I.merge_intervals(blackouts(spark, sf_dir)).select(F.floor(F.col("s") / 1000).alias("s_ms"), F.floor(F.col("e") / 1000).alias("e_ms"))


@query("quiet_regions", _SEL_FULL + ", " + _MARK + ", " + _REG + " SELECT s // 1000 AS s_ms, e // 1000 AS e_ms FROM regions")
def quiet_regions(spark, sf_dir):
    return regions(spark, sf_dir).select(F.floor(F.col("s") / 1000).alias("s_ms"), F.floor(F.col("e") / 1000).alias("e_ms"))


@query("sliding_windows", _SEL_FULL + ", " + _MARK + ", " + _REG + ", " + _WIN + f""" SELECT ws // 1000 AS ws_ms, we // 1000 AS we_ms,
 ws // {DAY} = we // {DAY} AS same_day FROM windows""")
def sliding_windows(spark, sf_dir):
    return windows(spark, sf_dir).select(
        F.floor(F.col("ws") / 1000).alias("ws_ms"), F.floor(F.col("we") / 1000).alias("we_ms"), (F.floor(F.col("ws") / DAY) == F.floor(F.col("we") / DAY)).alias("same_day"))


@query("daily_windows", _SEL_FULL + ", " + _MARK + ", " + _REG + ", " + _WIN + f""", daily AS (SELECT ws // {DAY} AS d, count(*) AS n FROM windows WHERE ws // {DAY} = we // {DAY} GROUP BY 1)
 SELECT d * {DAY} AS day_start, d * {DAY} + {DAY - 1_000_000} AS day_end, n FROM daily""")
def daily_windows(spark, sf_dir):
    w = I.sliding_windows(regions(spark, sf_dir), LEN, BUF, STRIDE, same_day=True)
    counts = w.groupBy((F.floor(F.col("ws") / DAY) * DAY).alias("ds")).agg(F.count(F.lit(1)).alias("n"))
    return I.day_windows(w).join(counts, "ds").select(F.col("ds").alias("day_start"), F.col("de").alias("day_end"), "n")


@query("window_names", _SEL_FULL + ", " + _MARK + ", " + _REG + ", " + _WIN + """ SELECT strftime(make_timestamp(ws), '%Y.%m.%d.%H.%M') AS name, count(*) AS n FROM windows GROUP BY 1""")
def window_names(spark, sf_dir):
    return windows(spark, sf_dir).groupBy(I.window_name().alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("rounded_window_length", ctes(*BASE) + ", " + _SEL + ", " + _PAIR + f" SELECT event_id, {R('ceil((e - s) / 1000000.0::DOUBLE / 2.5) * 2.5', 3)} AS seconds FROM black")
def rounded_window_length(spark, sf_dir):
    return blackouts(spark, sf_dir).select("event_id", rnd(I.rounded_length("s", "e", 2.5), 3).alias("seconds"))


@query("central_window", _SEL_FULL + f", padded AS (SELECT event_id, s - {HOUR} AS s, e + {HOUR} AS e FROM black) SELECT event_id, (s + (e - s - {LEN}) // 2) // 1000 AS cs_ms, (s + (e - s - {LEN}) // 4) // 1000 AS quarter_ms FROM padded")
def central_window(spark, sf_dir):
    b = blackouts(spark, sf_dir).select("event_id", (F.col("s") - HOUR).alias("s"), (F.col("e") + HOUR).alias("e"))
    half, _ = I.central_window("s", "e", LEN)
    quarter, _ = I.central_window("s", "e", LEN, 0.25)
    return b.select("event_id", F.floor(half / 1000).alias("cs_ms"), F.floor(quarter / 1000).alias("quarter_ms"))


_S0, _S1 = T0 + 5 * DAY, T0 + 12 * DAY


@query("time_range_slice", ctes("samples") + f"SELECT station, component, count(*) AS n, {R('sum(x)', 4)} AS total FROM samples WHERE ts >= {_S0} AND ts <= {_S1} GROUP BY 1, 2")
def time_range_slice(spark, sf_dir):
    return Q.time_slice(samples(spark, sf_dir), _S0, _S1).groupBy("station", "component").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("x"), 4).alias("total"))


@query("finished_day_windows", _SEL_FULL + ", " + _MARK + ", " + _REG + ", " + _WIN + f""", done AS (SELECT DISTINCT epoch_us(date_trunc('day', ts)) // {DAY} AS d FROM events WHERE event_type = 'error' AND value > 200)
 SELECT ws // 1000 AS ws_ms FROM windows WHERE ws // {DAY} IN (SELECT d FROM done)""")
def finished_day_windows(spark, sf_dir):
    names = table(spark, sf_dir, "events").where("event_type = 'error' AND value > 200").select(F.date_format("ts", "yyyy.MM.dd.HH.mm").alias("name"))
    return Q.finished_day_windows(windows(spark, sf_dir), names, DAY).select(F.floor(F.col("ws") / 1000).alias("ws_ms"))


_GRID6 = f"""cells AS (SELECT ts // {6 * HOUR} AS w, station, component, count(*) AS n, var_pop(x) AS variance FROM samples GROUP BY 1, 2, 3)"""


def _cells(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(F.floor(F.col("ts") / (6 * HOUR)).alias("w"), "station", "component").agg(
        F.count("x").alias("n"), F.var_pop("x").alias("variance"))


@query("fixed_length_gate", ctes("rec") + """, c AS (SELECT station, component, id, len(list_filter(x, lambda v: v > -0.35)) AS n FROM rec)
SELECT station, count(*) AS n FROM c GROUP BY station, id // 2 HAVING bool_and(n = 64)""".replace("SELECT station, count(*) AS n FROM c GROUP BY station, id // 2 HAVING bool_and(n = 64)",
       "SELECT id // 2 AS win FROM c GROUP BY id // 2 HAVING bool_and(n = 64)"))
def fixed_length_gate(spark, sf_dir):
    r = records(spark, sf_dir).select(F.floor(F.col("id") / 2).alias("win"), F.size(F.filter("x", lambda v: v > -0.35)).alias("n"))
    return Q.length_gate(r, ["win"], 64)


@query("window_quality_gate", ctes("samples") + ", " + _GRID6 + """, st AS (SELECT w, station, count(DISTINCT component) AS c, max(n) AS top, min(n) AS low, min(variance) AS v FROM cells GROUP BY 1, 2),
faults AS (SELECT w, 0 AS stage, station, CASE WHEN c != 3 THEN 'comp' WHEN top = 0 THEN 'empty' WHEN low = 0 THEN 'no data' END AS reason FROM st
 UNION ALL SELECT w, 1, station, CASE WHEN v <= 1e-30 THEN 'variance' END FROM st),
firsts AS (SELECT w, station, reason, row_number() OVER (PARTITION BY w ORDER BY stage, station) AS k FROM faults WHERE reason IS NOT NULL)
SELECT s.w, f.station || ' ' || f.reason AS reason FROM (SELECT DISTINCT w FROM st) s LEFT JOIN firsts f ON f.w = s.w AND f.k = 1""")
def window_quality_gate(spark, sf_dir):
    return Q.window_verdicts(_cells(spark, sf_dir), ["w"])


@query("blackout_anti_join", _SEL_FULL + f""", win AS (SELECT event_id AS id, ts AS ws, ts + {LEN} AS we FROM catalogue)
SELECT id FROM win WHERE NOT EXISTS (SELECT 1 FROM black WHERE ws <= e + {5 * MIN} AND we >= s - {5 * MIN})""")
def blackout_anti_join(spark, sf_dir):
    win = catalogue(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").alias("ws"), (F.col("ts") + LEN).alias("we"))
    return I.exclude_intervals(win, ["id"], blackouts(spark, sf_dir), 5 * MIN).select("id")


@query("window_sample_join", _SEL_FULL + ", samples AS (SELECT user_id % 10 AS station, event_type AS component, epoch_us(ts) AS ts, value AS x FROM events WHERE event_type IN ('view', 'click', 'error')), "
       + _MARK + ", " + _REG + ", " + _WIN + f""" SELECT ws // 1000 AS ws_ms, count(*) AS n, {R('sum(x)', 4)} AS total FROM windows JOIN samples ON ts BETWEEN ws AND we GROUP BY 1""")
def window_sample_join(spark, sf_dir):
    cut = I.cut_windows(samples(spark, sf_dir), windows(spark, sf_dir), HOUR)
    return cut.groupBy(F.floor(F.col("ws") / 1000).alias("ws_ms")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("x"), 4).alias("total"))


_STATS = _SEL_FULL + ", samples AS (SELECT user_id % 10 AS station, CASE event_type WHEN 'view' THEN 'Z' WHEN 'click' THEN '2' ELSE '1' END AS component, epoch_us(ts) AS ts, value AS x FROM events WHERE event_type IN ('view', 'click', 'error')), " \
    + _MARK + ", " + _REG + ", " + _WIN + """, stats AS (SELECT station, component, ws, count(*) AS n, avg(x) AS mean, var_pop(x) AS variance FROM windows JOIN samples ON ts BETWEEN ws AND we GROUP BY 1, 2, 3)"""


@query("window_trace_variance", _STATS + f" SELECT station, component, ws // 1000 AS ws_ms, n::BIGINT AS n, {R('mean', 4)} AS mean, {R('variance', 4)} AS variance FROM stats")
def window_trace_variance(spark, sf_dir):
    stats = quiet_window_statistics(samples(spark, sf_dir), regions(spark, sf_dir), ["station", "component"], LEN, STRIDE, BUF, PANE)
    return stats.select("station", "component", F.floor(F.col("ws") / 1000).alias("ws_ms"), "n", rnd("mean", 4).alias("mean"), rnd("variance", 4).alias("variance"))


@query("quiet_window_noise", _STATS + f""" SELECT station, component, count(*) AS windows, sum(n)::BIGINT AS samples, {R('avg(variance)', 4)} AS mean_variance, {R('stddev_pop(variance)', 3)} AS sd_variance
FROM stats WHERE n >= 2 AND variance > 1e-9 GROUP BY 1, 2""")
def quiet_window_noise(spark, sf_dir):
    found = station_noise(
        samples(spark, sf_dir), blackouts(spark, sf_dir), ["station", "component"], T0, T1, LEN, STRIDE, BUF, PANE, least_samples=2, variance_floor=1e-9)
    return found.select("station", "component", "windows", "samples", rnd("mean_variance", 4).alias("mean_variance"), rnd("sd_variance", 3).alias("sd_variance"))


@query("great_circle", ctes("catalogue") + f"SELECT event_id, {R(degrees_sql(str(LAT), str(LON), 'lat', 'lon'))} AS degrees, "
       + R(f"(degrees(atan2(sin(radians(lon - ({LON}))) * cos(radians(lat)), cos(radians({LAT})) * sin(radians(lat)) - sin(radians({LAT})) * cos(radians(lat)) * cos(radians(lon - ({LON}))))) + 360.0) % 360.0", 5) + " AS azimuth FROM catalogue")
def great_circle(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    return c.select("event_id", rnd(distance_degrees(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))).alias("degrees"),
                    rnd(azimuth_degrees(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")), 5).alias("azimuth"))


# Vincenty's inverse series, 40 steps of the longitude equation
_U = "atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians({0})))"
_STEP = "sqrt(pow(cos(u2) * sin(l), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) AS cs"
_ELL = ctes("catalogue") + f""", p AS (SELECT event_id, {_U.format(LAT)} AS u1, {_U.format('lat')} AS u2, radians(lon - ({LON})) AS d, 1 / 298.257223563::DOUBLE AS f FROM catalogue),
it(event_id, u1, u2, d, f, n, l) AS (SELECT event_id, u1, u2, d, f, 0, d FROM p UNION ALL SELECT event_id, u1, u2, d, f, n + 1, d + (1 - c) * f * sa * (atan2(ss, cs) + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
 FROM (SELECT *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) AS c, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS c2m FROM (SELECT *, cos(u1) * cos(u2) * sin(l) / ss AS sa FROM (SELECT *, {_STEP} FROM it WHERE n < 40)))),
k AS (SELECT *, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS c2m, (1 - sa * sa) * (1 / pow(1 - f, 2) - 1) AS e2 FROM (SELECT *, cos(u1) * cos(u2) * sin(l) / ss AS sa FROM (SELECT *, {_STEP} FROM it WHERE n = 40))),
ab AS (SELECT *, 1 + e2 / 16384 * (4096 + e2 * (-768 + e2 * (320 - 175 * e2))) AS a, e2 / 1024 * (256 + e2 * (-128 + e2 * (74 - 47 * e2))) AS b FROM k)
SELECT event_id, {R('6378137.0::DOUBLE * (1 - f) * a * (atan2(ss, cs) - b * ss * (c2m + b / 4 * (cs * (2 * c2m * c2m - 1) - b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3))))', 2)} AS metres,
{R('(degrees(atan2(cos(u2) * sin(l), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l))) + 360.0) % 360.0', 5)} AS azimuth,
{R('(degrees(atan2(cos(u1) * sin(l), cos(u1) * sin(u2) * cos(l) - sin(u1) * cos(u2))) + 180.0) % 360.0', 5)} AS back_azimuth FROM ab"""


@query("ellipsoid_distance", _ELL)
def ellipsoid_distance(spark, sf_dir):
    c = catalogue(spark, sf_dir).withColumn("p", ellipsoid_path(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")))
    return c.select("event_id", rnd("p.metres", 2).alias("metres"), rnd("p.azimuth", 5).alias("azimuth"), rnd("p.back_azimuth", 5).alias("back_azimuth"))


@query("route_stations", """WITH needed AS (SELECT DISTINCT user_id AS station FROM events), models AS (
SELECT c_custkey AS station, c_nationkey::BIGINT AS model_idx FROM customer UNION ALL SELECT s_suppkey, (s_nationkey + 3)::BIGINT FROM supplier)
SELECT n.station, min(m.model_idx) AS model_idx, 'model_' || min(m.model_idx) AS model FROM needed n JOIN models m USING (station) GROUP BY n.station""")
def route_stations(spark, sf_dir):
    needed, models = _routes(spark, sf_dir)
    return J.route_stations(needed, models)


def _routes(spark, sf_dir):
    needed = table(spark, sf_dir, "events").select(F.col("user_id").alias("station")).distinct()
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), F.col("c_nationkey").cast("long").alias("model_idx")).unionByName(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_nationkey") + 3).cast("long").alias("model_idx")))
    return needed, models.withColumn("model", F.concat(F.lit("model_"), F.col("model_idx").cast("string")))


@query("uncovered_stations", "SELECT DISTINCT user_id AS station FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def uncovered_stations(spark, sf_dir):
    needed, _ = _routes(spark, sf_dir)
    return J.uncovered(needed, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station")), ["station"])


@query("kernel_distance_ids", _SEL_FULL + f""", k AS (SELECT event_id, station, round(distance * 111.19, 1) AS dist FROM pairs)
SELECT event_id, station, {R('dist', 1)} AS dist, printf('%03d', dense_rank() OVER (PARTITION BY event_id ORDER BY dist)) AS kernel FROM k""")
def kernel_distance_ids(spark, sf_dir):
    p = pairs(spark, sf_dir).select("event_id", "station", (F.col("distance") * 111.19).alias("km"))
    return J.kernel_ids(p, ["event_id"], "km").select("event_id", "station", rnd("dist", 1).alias("dist"), "kernel")


@query("complement_of_sets", "SELECT DISTINCT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def complement_of_sets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("union_of_sources", ctes("catalogue") + ", " + _SEL + " SELECT part, count(*) AS n FROM chosen GROUP BY part UNION ALL SELECT 'trace', count(*) FROM embeddings")
def union_of_sources(spark, sf_dir):
    near_far = chosen(spark, sf_dir).select("part")
    both = near_far.unionByName(traces(spark, sf_dir).select(F.lit("trace").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
