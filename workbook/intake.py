"""Sources, sinks and record shapes (station lists, catalogues, archives, result sets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwave.functions.arrays import total
from quietwave.operators.quality import (
    available_stations, match_methods, output_component, standard_channel, trace_lengths,
)
from quietwave.session import fresh_path
from quietwave.sources import catalogue as C
from quietwave.sources import layers as L
from quietwave.sources import records as S
from quietwave.sources import stations as St
from workbook.registry import R, T0, T1, catalogue, ctes, layers, query, records, rnd, samples, sims, table, traces

DAY = 86400000000


def _station_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat(
        F.lit("C"), F.col("c_custkey").cast("string"), F.lit("  N"), F.col("c_nationkey").cast("string"), F.lit(" "),
        (F.col("c_custkey") % 180 - 90).cast("string"), F.lit(".5\t"), (F.col("c_custkey") * 7 % 360 - 180).cast("string"),
        F.lit(".25   # "), F.col("c_name"))
    return c.select(F.when(F.col("c_acctbal") < 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))


_STATIONS = ("SELECT 'C' || c_custkey AS station, 'N' || c_nationkey AS network, ((c_custkey % 180 - 90)::VARCHAR || '.5')::DOUBLE AS lat, "
             "((c_custkey * 7 % 360 - 180)::VARCHAR || '.25')::DOUBLE AS lon FROM customer WHERE c_acctbal >= 0")


@query("station_list_scan", _STATIONS)
def station_list_scan(spark, sf_dir):
    return St.parse_station_lines(_station_lines(spark, sf_dir))


@query("station_network_lookup", f"WITH s AS ({_STATIONS}) SELECT network, count(*) AS n, min(station) AS first_station FROM s GROUP BY network")
def station_network_lookup(spark, sf_dir):
    found = St.station_networks(St.parse_station_lines(_station_lines(spark, sf_dir)))
    return found.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.min("station").alias("first_station"))


def _station_maps(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    listed = F.when(F.col("c_nationkey") < 5, "[]").when(F.col("c_nationkey") < 12, '["Z","N"]').otherwise('["Z","E","N"]')
    components = c.where("c_nationkey != 24").select(F.concat(F.lit('{"'), name, F.lit('": '), listed, F.lit("}")).alias("value"))
    shifts = c.where("c_acctbal > 5000").select(F.concat(F.lit('{"'), name, F.lit('": '), (F.col("c_custkey") % 9 - 4).cast("string"), F.lit("}")).alias("value"))
    return c.select(name.alias("station")), St.parse_component_map(components), St.parse_shift_map(shifts)


@query("station_components_and_shifts",
       "SELECT 'C' || c_custkey AS station, CASE WHEN c_nationkey < 12 THEN 'Z,N' ELSE 'Z,E,N' END AS components, "
       "(CASE WHEN c_acctbal > 5000 THEN c_custkey % 9 - 4 ELSE 0 END)::INTEGER AS time_shift FROM customer WHERE c_nationkey >= 5 AND c_nationkey != 24")
def station_components_and_shifts(spark, sf_dir):
    stations, components, shifts = _station_maps(spark, sf_dir)
    return St.with_components(stations, components, shifts).select("station", F.concat_ws(",", "components").alias("components"), "time_shift")


@query("stations_missing_from_component_map", "SELECT 'C' || c_custkey AS station FROM customer WHERE c_nationkey = 24")
def stations_missing_from_component_map(spark, sf_dir):
    stations, components, _ = _station_maps(spark, sf_dir)
    return St.stations_without_components(stations, components)


@query("event_catalogue_scan", ctes("catalogue") +
       f"SELECT event_id, ts // 1000000 AS ts_second, {R('lat', 4)} AS lat, {R('lon', 4)} AS lon, {R('depth', 4)} AS depth, {R('mag', 4)} AS mag, "
       "'Region, no. ' || (event_id % 7) AS region FROM catalogue")
def event_catalogue_scan(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    t = F.timestamp_micros("ts")
    line = F.concat_ws(
        ",", F.date_format(t, "yyyy,MM,dd,HH:mm:ss"), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"),
        F.format_string("%.4f", "depth"), F.format_string("%.4f", "mag"),
        F.concat(F.lit('"Region, no. '), (F.col("event_id") % 7).cast("string"), F.lit('"')), F.floor(F.col("ts") / 1000000).cast("string"))
    parsed = C.parse_catalogue_lines(c.select("event_id", line.alias("value")))
    return parsed.select(
        "event_id", F.floor(F.col("ts") / 1000000).alias("ts_second"), rnd("lat", 4).alias("lat"), rnd("lon", 4).alias("lon"),
        rnd("depth", 4).alias("depth"), rnd("mag", 4).alias("mag"), "region")


_A0, _A1 = T0 + 9 * DAY + 3600000000, T0 + 12 * DAY - 1


@query("waveform_archive_scan", ctes("samples") + f""", inside AS (SELECT * FROM samples WHERE ts BETWEEN {_A0} AND {_A1}),
ok AS (SELECT station FROM inside GROUP BY station HAVING count(DISTINCT component) = 3)
SELECT station, component, count(*) AS n, {R('sum(x)', 4)} AS total FROM inside WHERE station IN (SELECT station FROM ok) GROUP BY station, component""")
def waveform_archive_scan(spark, sf_dir):
    path = fresh_path(spark, "archive")
    S.write_archive(samples(spark, sf_dir).withColumnRenamed("component", "channel"), path)
    found = S.read_archive(spark, path, _A0, _A1)
    return found.groupBy(F.col("station").cast("long").alias("station"), F.col("channel").alias("component")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("x"), 4).alias("total"))


@query("simulation_record_roundtrip", ctes("rec") +
       f"SELECT 'sim_' || id AS sim_id, station::INTEGER AS station, component, {R('x[1]', 8)} AS latitude, {R('x[6]', 8)} AS m_tp, 58::INTEGER AS n, "
       f"{R('list_sum(x[7:64])', 6)} AS total, {R('x[7] * x[7]', 8)} AS variance FROM rec")
def simulation_record_roundtrip(spark, sf_dir):
    r = records(spark, sf_dir)
    inputs = F.create_map(
        F.lit("source_location"), F.create_map(*[v for k, n in enumerate(["latitude", "longitude", "depth", "time_shift"]) for v in (F.lit(n), F.col("x")[k])]),
        F.lit("moment_tensor"), F.create_map(F.lit("m_rp"), F.col("x")[4], F.lit("m_tp"), F.col("x")[5]))
    made = r.select(
        F.format_string("sim_%d", F.col("id")).alias("sim_id"), inputs.alias("inputs"), "station", "component",
        F.slice("x", 7, 58).alias("x"), F.array(F.col("x")[6] * F.col("x")[6]).alias("misc"))
    path = fresh_path(spark, "simulations")
    S.write_simulations(made, path)
    back = S.read_simulations(spark, path)
    return back.select(
        "sim_id", "station", "component", rnd(F.col("inputs")["source_location"]["latitude"], 8).alias("latitude"),
        rnd(F.col("inputs")["moment_tensor"]["m_tp"], 8).alias("m_tp"), F.size("x").alias("n"), rnd(total("x")).alias("total"),
        rnd(F.col("misc")[0], 8).alias("variance"))


@query("ensemble_directory_scan", ctes("tr") + f"SELECT ens, count(*) AS n, {R('sum(x[1])')} AS total, true AS from_files FROM tr GROUP BY ens")
def ensemble_directory_scan(spark, sf_dir):
    path = fresh_path(spark, "ensemble")
    traces(spark, sf_dir).write.parquet(path)
    found = S.read_ensemble(spark, path, required=True)
    return found.groupBy("ens").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(F.col("x")[0])).alias("total"),
                                    F.bool_and(F.col("file_name").endswith(".parquet")).alias("from_files"))


@query("layered_model_scan", ctes("layers") +
       f"SELECT model, layer, {R('thickness', 4)} AS thickness, {R('vp', 4)} AS vp, {R('vs', 4)} AS vs, 2.5::DOUBLE AS rho, 600::DOUBLE AS qp, 300::DOUBLE AS qs FROM layers")
def layered_model_scan(spark, sf_dir):
    line = F.concat(F.format_string(" %.4f  %.4f %.4f 2.5", "thickness", "vp", "vs"), F.lit(" 600 300  # layer"))
    rows = L.parse_layer_lines(layers(spark, sf_dir).select("model", F.col("layer").cast("long").alias("layer"), line.alias("value")))
    return rows.select("model", "layer", *[rnd(c, 4).alias(c) for c in L.LAYER_FIELDS])


_RESULTS = ("res AS (SELECT event_id, user_id AS event, event_type AS method, (json_extract_string(props, '$.k')::BIGINT % 3)::INTEGER AS pos, "
            "value, value / 2 + 1 AS truth FROM events)")


def _results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("event"), F.col("event_type").alias("method"),
                    (F.get_json_object("props", "$.k").cast("long") % 3).cast("int").alias("pos"), "value", (F.col("value") / 2 + 1).alias("truth"))


@query("result_append_sink", f"WITH {_RESULTS} SELECT method, count(*) AS n, {R('sum(value)', 2)} AS total FROM res GROUP BY method")
def result_append_sink(spark, sf_dir):
    path = fresh_path(spark, "results")
    r = _results(spark, sf_dir)
    S.append_results(r.where("method IN ('view', 'click')"), path)
    S.append_results(r.where("method NOT IN ('view', 'click')"), path)
    back = spark.read.parquet(path)
    return back.groupBy("method").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 2).alias("total"))


@query("collect_runs", f"""WITH {_RESULTS}, k AS (SELECT *, CASE WHEN method LIKE '%view%' THEN 'view' ELSE 'c' END AS key FROM res
WHERE method LIKE '%view%' OR method LIKE '%c%')
SELECT key, pos, count(*) AS n, {R('avg((value - 1) / (pos + 9))', 6)} AS mean_scaled, {R('avg((truth - 1) / (pos + 9))', 6)} AS mean_truth
FROM k GROUP BY key, pos""")
def collect_runs(spark, sf_dir):
    r = _results(spark, sf_dir).withColumnRenamed("event_id", "sample_id")
    paths = [fresh_path(spark, "run") for _ in range(2)]
    S.append_results(r.where("value < 20"), paths[0])
    S.append_results(r.where("NOT value < 20"), paths[1])
    bounds = r.select("pos").distinct().select("pos", F.lit(1.0).alias("lo"), (F.col("pos") + 10.0).alias("hi"))
    found = S.collect_runs(spark, paths, ["view", "c"], bounds)
    return found.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("scaled")).alias("mean_scaled"), rnd(F.avg("scaled_truth")).alias("mean_truth"))


@query("method_key_selection", f"""WITH {_RESULTS}, h AS (SELECT event_id, method, list_filter(['error','r','purchase','up'], lambda k: contains(method, k)) AS hits FROM res),
p AS (SELECT event_id, method, unnest(CASE WHEN len(hits) > 1 THEN list_filter(hits, lambda k: k = method) ELSE hits END) AS key FROM h)
SELECT method, key, count(*) AS n FROM p GROUP BY method, key""")
def method_key_selection(spark, sf_dir):
    found = match_methods(_results(spark, sf_dir), ["error", "r", "purchase", "up"])
    return found.groupBy("method", "key").agg(F.count(F.lit(1)).alias("n"))


@query("channel_alias", """WITH c AS (SELECT event_id, (['BHZ','BH1','BH2','BHN','BHE'])[1 + event_id % 5] AS channel, user_id % 2 = 0 AS has_n FROM events)
SELECT event_id, channel, CASE WHEN right(channel, 1) = '1' AND has_n THEN 'E' WHEN right(channel, 1) = '2' AND has_n THEN 'N' ELSE right(channel, 1) END AS standard,
CASE right(channel, 1) WHEN 'Z' THEN 'Z' WHEN '1' THEN '1' WHEN 'E' THEN '1' ELSE '2' END AS component FROM c""")
def channel_alias(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in ("BHZ", "BH1", "BH2", "BHN", "BHE")])
    e = table(spark, sf_dir, "events").select(
        "event_id", names[(F.col("event_id") % 5).cast("int")].alias("channel"), (F.col("user_id") % 2 == 0).alias("has_n"))
    return e.select("event_id", "channel", standard_channel("channel", "has_n").alias("standard"), output_component("channel").alias("component"))


_E0, _E1 = T0 + 10 * DAY, T0 + 10 * DAY + DAY // 4


@query("station_availability", ctes("samples") + f"""SELECT station FROM samples WHERE ts BETWEEN {_E0 - DAY // 4} AND {_E1 + DAY // 4}
GROUP BY station HAVING count(DISTINCT component) = 3""")
def station_availability(spark, sf_dir):
    return available_stations(samples(spark, sf_dir), _E0, _E1, DAY // 4)


@query("trace_length_check", ctes("lg") + "SELECT id, count(*) AS n, true AS ok FROM lg GROUP BY id")
def trace_length_check(spark, sf_dir):
    return trace_lengths(traces(spark, sf_dir).select("id", F.posexplode("x").alias("i", "v")), ["id"], 64)
