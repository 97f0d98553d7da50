"""Trace reshaping, filters, resampling and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quietwave.functions import arrays as A
from quietwave.functions import signal as G
from quietwave.operators import pairing as J
from quietwave.operators import spectra as X
from quietwave.operators import traces as T
from quietwave.operators.covariance import mean_vectors
from workbook.registry import R, ctes, query, records, rnd, samples, traces, uniform_sql
from workbook.windows import _SEL_FULL, arrived

HOUR = 3_600_000_000


def checksum(x):
    """Sum of value times 1-based position."""
    x = F.col(x) if isinstance(x, str) else x
    return A.dot(x, F.transform(F.sequence(F.lit(1), F.size(x)), lambda k: k.cast("double")))


CHECK = "list_sum(list_transform({x}, lambda v, k: v * k))"
MEAN_TRACE = "mt0 AS (SELECT ens, i, avg(v) AS m FROM lg GROUP BY ens, i)"


@query("rotate_horizontals", ctes("rl") + f""", n AS (SELECT id // 3 AS rec, i, v FROM rl WHERE component = '2'), e AS (SELECT id // 3 AS rec, i, v FROM rl WHERE component = '1')
SELECT n.rec, n.i::INTEGER AS i, {R('-e.v * sin(radians(n.rec * 7 % 360)) - n.v * cos(radians(n.rec * 7 % 360))')} AS radial,
{R('-e.v * cos(radians(n.rec * 7 % 360)) + n.v * sin(radians(n.rec * 7 % 360))')} AS transverse FROM n JOIN e USING (rec, i)""")
def rotate_horizontals(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("rec", F.floor(F.col("id") / 3)).withColumn("ba", F.pmod(F.col("rec") * 7, F.lit(360)))
    long = r.select("rec", "ba", F.translate("component", "12", "EN").alias("component"), F.posexplode("x").alias("i", "x"))
    return T.rotate_horizontals(long, ["rec", "i"], "ba").select("rec", "i", rnd("radial").alias("radial"), rnd("transverse").alias("transverse"))


_PAIRED = f"""nn AS (SELECT id AS noise_id, row_number() OVER (ORDER BY id) - 1 AS idx, x AS noise FROM tr),
pn AS (SELECT t.id, t.ens, t.x, n.noise_id, n.noise FROM tr t JOIN nn n ON n.idx = floor({uniform_sql('t.id', 'pair')} * (SELECT count(*) FROM tr))::BIGINT)"""


def noise_pairs(spark, sf_dir):
    t = traces(spark, sf_dir)
    noise = t.select(F.col("id").alias("noise_id"), F.col("x").alias("noise"))
    return J.pair_with_noise(t, noise, "id", ["noise_id"], "pair")


@query("noise_pairing", ctes("tr") + ", " + _PAIRED + " SELECT id, noise_id FROM pn")
def noise_pairing(spark, sf_dir):
    return noise_pairs(spark, sf_dir).select("id", "noise_id")


@query("noise_injection", ctes("tr") + ", " + _PAIRED + f", u AS (SELECT id, unnest(x) + unnest(noise) AS y, generate_subscripts(x, 1) AS k FROM pn) SELECT id, {R('sum(y * k)')} AS checksum, {R('sum(y * y)')} AS power FROM u GROUP BY id")
def noise_injection(spark, sf_dir):
    made = J.inject_noise(noise_pairs(spark, sf_dir))
    return made.select("id", rnd(checksum("y")).alias("checksum"), rnd(A.power("y")).alias("power"))


@query("component_alias_lookup", ctes("tr") + """, offers AS (SELECT ens AS station, (['Z','1','2','N','E'])[1 + id % 5] AS component, max(id) AS trace FROM tr WHERE NOT (ens < 3 AND id % 5 IN (1, 4)) GROUP BY 1, 2),
wanted AS (SELECT DISTINCT ens AS station, unnest(['Z','N','E','1']) AS component FROM tr)
SELECT w.station, w.component, coalesce(a.trace, b.trace) AS trace, CASE WHEN a.trace IS NOT NULL THEN 'exact' WHEN b.trace IS NOT NULL THEN 'alias' ELSE 'missing' END AS found
FROM wanted w LEFT JOIN offers a ON a.station = w.station AND a.component = w.component LEFT JOIN offers b ON b.station = w.station AND b.component = translate(w.component, 'EN', '12')""")
def component_alias_lookup(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in ("Z", "1", "2", "N", "E")])
    t = traces(spark, sf_dir).select(F.col("ens").alias("station"), names[(F.col("id") % 5).cast("int")].alias("component"), F.col("id").alias("trace"))
    held = t.where("NOT (station < 3 AND component IN ('1', 'E'))").groupBy("station", "component").agg(F.max("trace").alias("trace"))
    wanted = t.select("station").distinct().select("station", F.explode(F.array(*[F.lit(c) for c in "ZNE1"])).alias("component"))
    return J.look_up_component(wanted, held, "trace")


@query("zero_fill_components", ctes("rl") + f""", g AS (SELECT DISTINCT id // 3 AS rec, station FROM rec), f AS (SELECT rec, station, unnest(['Z', '1', '2']) AS component FROM g),
s AS (SELECT id // 3 AS rec, station, component, sum(v * (i + 1)) AS c FROM rl GROUP BY 1, 2, 3)
SELECT f.rec, f.station, f.component, 64::INTEGER AS n, {R('coalesce(s.c, 0)')} AS checksum FROM f LEFT JOIN s USING (rec, station, component)""")
def zero_fill_components(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("rec", F.floor(F.col("id") / 3))
    return J.zero_fill(r, ["rec"], ["Z", "1", "2"], 64).select("rec", "station", "component", F.size("x").alias("n"), rnd(checksum("x")).alias("checksum"))


@query("merge_and_forward_fill", ctes("samples") + f""", s0 AS (SELECT station, component, ts // {HOUR} AS slot, min(x) AS lo, max(x) AS hi FROM samples GROUP BY 1, 2, 3),
k AS (SELECT station, component, slot, CASE WHEN lo = hi THEN lo END AS x FROM s0),
g AS (SELECT station, component, unnest(generate_series(min(slot), max(slot))) AS slot FROM k GROUP BY 1, 2),
f AS (SELECT g.station, g.component, g.slot, k.x IS NULL AS filled, last_value(k.x IGNORE NULLS) OVER (PARTITION BY g.station, g.component ORDER BY g.slot ROWS UNBOUNDED PRECEDING) AS x FROM g LEFT JOIN k USING (station, component, slot))
SELECT station, component, slot, x, filled FROM f WHERE x IS NOT NULL""")
def merge_and_forward_fill(spark, sf_dir):
    return T.fill_gaps(samples(spark, sf_dir), ["station", "component"], HOUR)


@query("zero_padded_shift", ctes("lg") + f", s AS (SELECT id, i + id % 7 - 3 AS j, v FROM lg) SELECT id, {R('sum(v * (j + 1))')} AS checksum, {R('sum(v)')} AS total FROM s WHERE j BETWEEN 0 AND 63 GROUP BY id")
def zero_padded_shift(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("y", A.shift("x", F.col("id") % 7 - 3))
    return t.select("id", rnd(checksum("y")).alias("checksum"), rnd(A.total("y")).alias("total"))


@query("cosine_taper", ctes("lg") + f""", t AS (SELECT id, i, v, least(i, 63 - i) AS j FROM lg)
SELECT id, {R('sum((i + 1) * v * CASE WHEN j < 6 THEN (1 - cos(pi() * j / 5)) / 2 ELSE 1 END)')} AS checksum FROM t GROUP BY id""")
def cosine_taper(spark, sf_dir):
    return traces(spark, sf_dir).select("id", rnd(checksum(A.cosine_taper("x", 0.1))).alias("checksum"))


@query("pad_and_trim", ctes("lg") + f""", p AS (SELECT id, i + 19 - 10 AS j, v FROM lg) SELECT id, {R('sum(v * (j + 1))')} AS checksum, 70::INTEGER AS n FROM p WHERE j BETWEEN 0 AND 69 GROUP BY id""")
def pad_and_trim(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("wide", A.pad("x", F.lit(19), F.lit(19))).withColumn("y", A.cut("wide", F.lit(10), F.lit(70)))
    return t.select("id", rnd(checksum("y")).alias("checksum"), F.size("y").alias("n"))


def _bandpass_polynomials(low: float, high: float) -> tuple[list[float], list[float]]:
    """Difference-equation coefficients of the same filter, by substituting into its polynomials.

    Prototype s^4 + c s^3 + ... + 1 with s -> (s^2 + low*high) / ((high-low) s), then
    s -> (1-w)/(1+w) with warped corners; w is the one-sample delay.
    """
    a, b = np.tan(np.pi * low), np.tan(np.pi * high)
    prototype = np.real(np.poly(np.exp(1j * np.pi * np.array([5, 7, 9, 11]) / 8)))  # highest power first
    minus, plus = np.array([1.0, -1.0]), np.array([1.0, 1.0])  # lowest power of w first
    square = np.convolve(minus, minus) + a * b * np.convolve(plus, plus)
    band = (b - a) * np.convolve(minus, plus)

    def power(poly: np.ndarray, n: int) -> np.ndarray:
        out = np.array([1.0])
        for _ in range(n):
            out = np.convolve(out, poly)
        return out

    bottom = sum(c * np.convolve(power(square, 4 - k), power(band, k)) for k, c in enumerate(prototype))
    top = power(band, 4)
    return list(top / bottom[0]), list(bottom / bottom[0])


def _recursion(name: str, source: str, top: list[float], bottom: list[float]) -> str:
    """Filtered lists of `source` (id, x): one recursive step per sample, newest output first."""
    feed = " + ".join(f"({float(c)!r})::DOUBLE * CASE WHEN t >= {k} THEN x[t + {1 - k}] ELSE 0 END" for k, c in enumerate(top) if c)
    back = " + ".join(f"({float(c)!r})::DOUBLE * coalesce(y[{k}], 0)" for k, c in enumerate(bottom) if k)
    return (f"{name}r(id, t, x, y) AS (SELECT id, 0, x, []::DOUBLE[] FROM {source} UNION ALL "
            f"SELECT id, t + 1, x, list_prepend(({feed}) - ({back}), y) FROM {name}r WHERE t < 64), "
            f"{name} AS (SELECT id, list_reverse(y) AS x FROM {name}r WHERE t = 64)")


_TOP, _BOTTOM = _bandpass_polynomials(0.05, 0.2)
_TOP = [c if abs(c) > 1e-15 else 0.0 for c in _TOP]
_ENERGY = f"{R('list_sum(list_transform(x, lambda v, k: v * k))', 5)} AS checksum, {R('list_sum(list_transform(x, lambda v: v * v))', 5)} AS power"


@query("band_pass_filter", ctes("tr") + ", " + _recursion("f", "tr", _TOP, _BOTTOM) + f" SELECT id, {_ENERGY} FROM f")
def band_pass_filter(spark, sf_dir):
    job = G.bandpass(0.05, 0.2, 1.0, corners=4)
    t = traces(spark, sf_dir).withColumn("y", job("x"))
    return t.select("id", rnd(checksum("y"), 5).alias("checksum"), rnd(A.power("y"), 5).alias("power"))


@query("band_pass_zero_phase", ctes("tr") + ", " + _recursion("f", "tr", _TOP, _BOTTOM) + ", g AS (SELECT id, list_reverse(x) AS x FROM f), " + _recursion("h", "g", _TOP, _BOTTOM)
       + f", z AS (SELECT id, list_reverse(x) AS x FROM h) SELECT id, {_ENERGY} FROM z")
def band_pass_zero_phase(spark, sf_dir):
    job = G.bandpass(0.05, 0.2, 1.0, corners=4, zerophase=True)
    t = traces(spark, sf_dir).withColumn("y", job("x"))
    return t.select("id", rnd(checksum("y"), 5).alias("checksum"), rnd(A.power("y"), 5).alias("power"))


@query("fourier_resample", ctes("lg") + f""", ks AS (SELECT k FROM generate_series(0, 16) t(k)),
sp AS (SELECT id, k, sum(v * cos(2 * pi() * k * i / 64)) * (0.5 + 0.5 * cos(2 * pi() * k / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) * (0.5 + 0.5 * cos(2 * pi() * k / 64)) AS im FROM lg CROSS JOIN ks GROUP BY id, k)
SELECT id, m::INTEGER AS i, {R("sum((CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * k * m / 32) - (CASE WHEN k IN (0, 16) THEN 0 ELSE im END) * sin(2 * pi() * k * m / 32))) / 64")} AS x
FROM sp CROSS JOIN generate_series(0, 31) u(m) GROUP BY id, m""")
def fourier_resample(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("x", G.fourier_resample(1.0, 0.5)("x"))
    return T.to_long(t, ["id"]).select("id", "i", rnd("x").alias("x"))


@query("lanczos_interpolation", ctes("lg") + f""", o AS (SELECT id, m, 0.3 * (id % 5) + m / 0.8 AS t FROM tr CROSS JOIN generate_series(0, 39) g(m)),
w AS (SELECT o.id, o.m, lg.v, o.t - lg.i AS p FROM o JOIN lg ON lg.id = o.id AND abs(o.t - lg.i) < 20)
SELECT id, m::INTEGER AS i, {R('sum(v * CASE WHEN abs(p) < 1e-12 THEN 1 ELSE sin(pi() * p) / (pi() * p) * sin(pi() * p / 20) / (pi() * p / 20) END)')} AS x FROM w GROUP BY id, m""")
def lanczos_interpolation(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("x", G.lanczos(1.0, 0.8, 40)("x", (F.col("id") % 5) * 0.3))
    return T.to_long(t, ["id"]).select("id", "i", rnd("x").alias("x"))


def _spectro(source: str, name: str) -> str:
    """Long table (id, i, v) to mean-removed Hann frames of 16, step 2, padded to 32."""
    return f"""{name}d AS (SELECT id, i, v - avg(v) OVER (PARTITION BY id) AS v FROM {source}),
{name} AS (SELECT id, f AS frame, k, CASE WHEN k = 16 THEN 1 ELSE 2 END * (pow(sum(v * h * cos(2 * pi() * k * (i - 2 * f) / 32)), 2) + pow(sum(v * h * sin(2 * pi() * k * (i - 2 * f) / 32)), 2)) / max(hh) AS power
 FROM (SELECT d.id, f, d.i, d.v, 0.5 - 0.5 * cos(2 * pi() * (d.i - 2 * f) / 15) AS h, (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * n / 15), 2)) FROM generate_series(0, 15) q(n)) AS hh
 FROM {name}d d CROSS JOIN generate_series(0, 24) g(f) WHERE d.i BETWEEN 2 * f AND 2 * f + 15) CROSS JOIN generate_series(1, 16) kk(k) GROUP BY id, f, k)"""


@query("spectrogram", ctes("lg") + ", " + _spectro("lg", "sg") + f" SELECT id, {R('k / 32.0::DOUBLE', 5)} AS freq, count(*) AS frames, {R('avg(sqrt(power))')} AS level FROM sg GROUP BY id, k")
def spectrogram(spark, sf_dir):
    s = X.spectrogram(traces(spark, sf_dir), ["id"], 1.0, 16.0, pad_factor=2.0)
    return s.groupBy("id", rnd("freq", 5).alias("freq")).agg(F.count(F.lit(1)).alias("frames"), rnd(F.avg("power")).alias("level"))


@query("spectral_ratio", ctes("lg") + ", nm AS (SELECT ens AS id, i, avg(v) AS v FROM lg GROUP BY ens, i), " + _spectro("lg", "sg") + ", " + _spectro("nm", "ng")
       + f" SELECT tr.ens, {R('s.k / 32.0::DOUBLE', 5)} AS freq, {R('avg(10 * log10(sqrt(s.power) / sqrt(n.power)))', 5)} AS ratio_db FROM sg s JOIN tr ON tr.id = s.id JOIN ng n ON n.id = tr.ens AND n.frame = s.frame AND n.k = s.k GROUP BY tr.ens, s.k")
def spectral_ratio(spark, sf_dir):
    t = traces(spark, sf_dir)
    signal = X.spectrogram(t, ["id", "ens"], 1.0, 16.0, pad_factor=2.0)
    noise = X.spectrogram(mean_vectors(t, ["ens"]), ["ens"], 1.0, 16.0, pad_factor=2.0)
    return X.spectral_ratio(signal, noise, ["ens"]).groupBy("ens", rnd("freq", 5).alias("freq")).agg(rnd(F.avg("ratio_db"), 5).alias("ratio_db"))


@query("band_limited_stft", ctes("lg") + f""", fr AS (SELECT id, f, n, v * (0.5 - 0.5 * cos(2 * pi() * (n - 22) / 20)) AS h FROM generate_series(0, 6) g(f) CROSS JOIN generate_series(22, 41) w(n)
 JOIN lg ON i = CASE WHEN n + 10 * f - 32 < 0 THEN 32 - n - 10 * f WHEN n + 10 * f - 32 > 63 THEN 126 - (n + 10 * f - 32) ELSE n + 10 * f - 32 END),
st AS (SELECT id, f, k, sum(h * cos(2 * pi() * k * n / 64)) AS re, -sum(h * sin(2 * pi() * k * n / 64)) AS im FROM fr CROSS JOIN generate_series(4, 12) kk(k) GROUP BY id, f, k)
SELECT id, {R('k / 64.0::DOUBLE', 5)} AS freq, count(*) AS frames, {R('avg(sqrt(re * re + im * im))')} AS magnitude, {R('sum(re)')} AS re, {R('sum(im)')} AS im FROM st GROUP BY id, k""")
def band_limited_stft(spark, sf_dir):
    s = X.band_stft(traces(spark, sf_dir), ["id"], 1.0, size=64, low=0.06, high=0.19)
    return s.groupBy("id", rnd("freq", 5).alias("freq")).agg(
        F.count(F.lit(1)).alias("frames"), rnd(F.avg("magnitude")).alias("magnitude"),
        rnd(F.sum(F.col("magnitude") * F.cos("phase"))).alias("re"), rnd(F.sum(F.col("magnitude") * F.sin("phase"))).alias("im"))


@query("arrival_slice", ctes("tr") + f""", q AS (SELECT id, floor(0.25::DOUBLE * (id % 30))::INTEGER AS b, floor(12.5::DOUBLE + 0.5::DOUBLE * (60 + id % 30))::INTEGER AS c, x FROM tr),
y AS (SELECT id, x[b + 1 : b + c] AS y FROM q) SELECT id, len(y)::INTEGER AS n, {R(CHECK.format(x='y'))} AS checksum FROM y""")
def arrival_slice(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("y", T.arrival_slice(F.col("x"), (F.col("id") % 30 + 60).cast("double"), 0.25))
    return t.select("id", F.size("y").alias("n"), rnd(checksum("y")).alias("checksum"))


@query("order_by_arrival", _SEL_FULL + " SELECT event_id, station, row_number() OVER (PARTITION BY event_id ORDER BY first, station)::INTEGER AS stacked, row_number() OVER (PARTITION BY event_id ORDER BY first DESC, station)::INTEGER AS moveout FROM arr")
def order_by_arrival(spark, sf_dir):
    a = arrived(spark, sf_dir).select("event_id", "station", "first")
    up = T.order_by_arrival(a, ["event_id"], "first").withColumnRenamed("position", "stacked")
    return T.order_by_arrival(up, ["event_id"], "first", descending=True).select("event_id", "station", "stacked", F.col("position").alias("moveout"))


@query("flatten_record", ctes("rl") + f""", o AS (SELECT id // 3 AS rec, (id % 3) AS ord, i, v / sqrt(1 + id % 3) AS v FROM rl WHERE i < 50),
p AS (SELECT rec, v, row_number() OVER (PARTITION BY rec ORDER BY ord, i) AS k FROM o) SELECT rec, count(*)::INTEGER AS n, {R('sum(v * k)')} AS checksum FROM p GROUP BY rec""")
def flatten_record(spark, sf_dir):
    r = records(spark, sf_dir).select(F.floor(F.col("id") / 3).alias("rec"), (F.col("id") % 3).alias("ord"), (1 + F.col("id") % 3).cast("double").alias("factor"), "x")
    flat = T.flatten_record(r, ["rec"], "ord", length=50, factor="factor")
    return flat.select("rec", F.size("x").alias("n"), rnd(checksum("x")).alias("checksum"))


@query("stack_record", ctes("rl") + f" SELECT rl.id // 30 AS rec, count(DISTINCT rl.id // 3)::INTEGER AS stations, {R('sum(CASE WHEN i = 0 THEN v ELSE 0 END)')} AS firsts, {R('sum(v)')} AS total FROM rl WHERE i < 40 GROUP BY 1")
def stack_record(spark, sf_dir):
    r = traces(spark, sf_dir).select(F.floor(F.col("id") / 30).alias("rec"), F.floor(F.col("id") / 3).alias("st"), (F.col("id") % 3).alias("c"), "x")
    s = T.stack_record(r, ["rec"], "st", "c", length=40)
    flat = F.flatten("x")
    return s.select("rec", F.size("x").alias("stations"), rnd(A.total(F.transform(flat, lambda t: t[0]))).alias("firsts"), rnd(A.total(F.flatten(flat))).alias("total"))


@query("amplitude_normalisation", ctes("lg") + ", " + MEAN_TRACE + f""", top AS (SELECT ens, max(abs(m)) AS top FROM mt0 GROUP BY ens), os AS (SELECT ens, avg(abs(v)) * 10 AS o FROM lg GROUP BY ens)
SELECT id, {R('sum(v * (i + 1) / top)', 5)} AS checksum, {R('max(o)')} AS offset_scale FROM lg JOIN top USING (ens) JOIN os USING (ens) GROUP BY id""")
def amplitude_normalisation(spark, sf_dir):
    t = traces(spark, sf_dir)
    scaled = T.normalise_by_observation(t, mean_vectors(t, ["ens"]), ["ens"]).join(T.offset_scale(t, ["ens"]), "ens")
    return scaled.select("id", rnd(checksum("x"), 5).alias("checksum"), rnd("offset_scale").alias("offset_scale"))
