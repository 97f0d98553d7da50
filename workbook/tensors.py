"""Moment tensor columns, planes, projections and scalers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quietwave.functions import scalers as S
from quietwave.functions import tensors as M
from quietwave.functions.angles import wrap
from quietwave.operators import posterior as P
from quietwave.operators.scaling import fit_signed_log_minmax
from quietwave.plans.evaluation import reparametrise
from workbook.registry import R, ctes, query, rnd, table, tensor_truth, tensors, traces

NORM = "m1*m1 + m2*m2 + m3*m3 + 2*(m4*m4 + m5*m5 + m6*m6)"
# eigenvalues as roots of the characteristic cubic by Newton steps from outside, then the remaining quadratic
EIG = f"""u AS (SELECT id, ens, m1/1e16 AS a, m2/1e16 AS b, m3/1e16 AS c, m4/1e16 AS d, m5/1e16 AS e, m6/1e16 AS f FROM mt),
co AS (SELECT id, ens, a+b+c AS i1, a*b + a*c + b*c - d*d - e*e - f*f AS i2, a*b*c + 2*d*e*f - a*f*f - b*e*e - c*d*d AS i3, sqrt(a*a+b*b+c*c+2*(d*d+e*e+f*f)) AS nrm FROM u),
it(id, step, x) AS (SELECT id, 0, nrm + 1e-9 FROM co UNION ALL SELECT it.id, step + 1, x - (x*x*x - i1*x*x + i2*x - i3) / (3*x*x - 2*i1*x + i2) FROM it JOIN co USING (id) WHERE step < 60),
l AS (SELECT co.id, co.ens, co.nrm, it.x AS l1, i1 - it.x AS s, i2 - it.x * (i1 - it.x) AS q FROM co JOIN it ON co.id = it.id AND step = 60),
eig AS (SELECT id, ens, nrm, l1, s / 2 + sqrt(greatest(0, s * s / 4 - q)) AS l2, s / 2 - sqrt(greatest(0, s * s / 4 - q)) AS l3 FROM l),
src AS (SELECT *, degrees(atan((-l1 + 2 * l2 - l3) / (sqrt(3) * (l1 - l3)))) AS gamma, 90 - degrees(acos((l1 + l2 + l3) / (sqrt(3) * nrm))) AS delta FROM eig)"""


@query("scalar_moment", ctes("mt") + f" SELECT id, {R(f'sqrt(({NORM}) / 2) / 1e16')} AS m0, {R(f'(log10(sqrt(({NORM}) / 2)) - 9.1) / 1.5')} AS mw FROM mt")
def scalar_moment(spark, sf_dir):
    return tensors(spark, sf_dir).select("id", rnd(M.scalar_moment() / 1e16).alias("m0"), rnd(M.magnitude()).alias("mw"))


@query("tensor_eigenvalues", ctes("mt") + f", {EIG} SELECT id, {R('l1', 5)} AS lam1, {R('l2', 5)} AS lam2, {R('l3', 5)} AS lam3 FROM eig")
def tensor_eigenvalues(spark, sf_dir):
    e = M.with_eigenvalues(tensors(spark, sf_dir))
    return e.select("id", *[rnd(F.col(f"lam{k}") / 1e16, 5).alias(f"lam{k}") for k in (1, 2, 3)])


@query("source_type", ctes("mt") + f""", {EIG} SELECT id, {R('gamma', 3)} AS gamma, {R('delta', 4)} AS delta, {R('nrm / sqrt(2)')} AS m0, {R('degrees(acos((l1 - l3) / (sqrt(2) * nrm)))', 3)} AS theta_dc,
{R('(l1 + l2 + l3) / 3', 5)} AS iso, {R('(l2 - (l1 + l2 + l3) / 3) / greatest(abs(l1 - (l1 + l2 + l3) / 3), abs(l3 - (l1 + l2 + l3) / 3))', 4)} AS epsilon FROM src""")
def source_type(spark, sf_dir):
    s = M.with_source_type(tensors(spark, sf_dir))
    return s.select("id", rnd("gamma", 3).alias("gamma"), rnd("delta", 4).alias("delta"), rnd(F.col("m0") / 1e16).alias("m0"), rnd("theta_dc", 3).alias("theta_dc"),
                    rnd(F.col("iso") / 1e16, 5).alias("iso"), rnd(M.clvd_epsilon(), 4).alias("epsilon"))


# both planes from the pressure and tension axes; axes as cross products of two rows of M - lambda I
NED = "-m2/1e16 AS a, -m3/1e16 AS b, -m1/1e16 AS c, -m5/1e16 AS d, -m6/1e16 AS e, -m4/1e16 AS f"


def planes_sql(source: str) -> str:
    return f"""pn AS (SELECT id, ens, {NED} FROM {source}),
pc AS (SELECT *, a+b+c AS i1, a*b + a*c + b*c - d*d - e*e - f*f AS i2, a*b*c + 2*d*e*f - a*f*f - b*e*e - c*d*d AS i3, sqrt(a*a+b*b+c*c+2*(d*d+e*e+f*f)) AS nrm FROM pn),
pi0(id, step, x, y) AS (SELECT id, 0, nrm + 1e-9, -nrm - 1e-9 FROM pc UNION ALL SELECT pi0.id, step + 1, x - (x*x*x - i1*x*x + i2*x - i3) / (3*x*x - 2*i1*x + i2), y - (y*y*y - i1*y*y + i2*y - i3) / (3*y*y - 2*i1*y + i2) FROM pi0 JOIN pc USING (id) WHERE step < 60),
pv AS (SELECT pc.*, s.w, s.l FROM pc JOIN (SELECT id, unnest(['t', 'p']) AS w, unnest([x, y]) AS l FROM pi0 WHERE step = 60) s USING (id)),
px AS (SELECT id, ens, w, unnest([[d*f - e*(b-l), e*d - (a-l)*f, (a-l)*(b-l) - d*d], [d*(c-l) - e*f, e*e - (a-l)*(c-l), (a-l)*f - d*e], [(b-l)*(c-l) - f*f, f*e - d*(c-l), d*f - (b-l)*e]]) AS v FROM pv),
pb AS (SELECT id, ens, w, arg_max(v, list_dot_product(v, v)) AS v, max(list_dot_product(v, v)) AS n2 FROM px GROUP BY 1, 2, 3),
pa AS (SELECT id, ens, max(CASE WHEN w = 't' THEN list_transform(v, lambda z: z / sqrt(n2)) END) AS t, max(CASE WHEN w = 'p' THEN list_transform(v, lambda z: z / sqrt(n2)) END) AS p FROM pb GROUP BY 1, 2),
pf AS (SELECT id, ens, unnest([1, -1]) AS side, t, p FROM pa),
pd AS (SELECT id, ens, list_transform(t, lambda z, k: (z + side * p[k]) / sqrt(2)) AS n, list_transform(t, lambda z, k: (z - side * p[k]) / sqrt(2)) AS s FROM pf),
pu AS (SELECT id, ens, CASE WHEN n[3] > 0 THEN list_transform(n, lambda z: -z) ELSE n END AS n, CASE WHEN n[3] > 0 THEN list_transform(s, lambda z: -z) ELSE s END AS s FROM pd),
pg AS (SELECT id, ens, s, acos(-n[3]) AS dip, atan2(-n[1], n[2]) AS strike FROM pu),
pl AS (SELECT id, ens, (degrees(strike) + 360.0) % 360.0 AS strike, degrees(dip) AS dip, degrees(atan2(-s[3] / sin(dip), s[1] * cos(strike) + s[2] * sin(strike))) AS rake FROM pg),
planes AS (SELECT id, ens, min(strike) AS strike1, arg_min(dip, strike) AS dip1, arg_min(rake, strike) AS rake1, max(strike) AS strike2, arg_max(dip, strike) AS dip2, arg_max(rake, strike) AS rake2 FROM pl GROUP BY 1, 2)"""


NAMES = ["strike1", "dip1", "rake1", "strike2", "dip2", "rake2"]


def with_planes(df):
    turned = M.convert_axes(df, "use", "planes", prefix="q")
    return turned.withColumn("planes", M.nodal_planes(*[f"q{k}" for k in range(1, 7)]))


@query("nodal_planes", ctes("mt") + ", " + planes_sql("mt") + " SELECT id, " + ", ".join(f"{R(n, 3)} AS {n}" for n in NAMES) + " FROM planes")
def nodal_planes(spark, sf_dir):
    return with_planes(tensors(spark, sf_dir)).select("id", *[rnd(f"planes.{n}", 3).alias(n) for n in NAMES])


@query("angle_wrap", f"SELECT event_id, {R('(((value - 40 + 90.0) % 180.0) + 180.0) % 180.0 - 90.0', 4)} AS wrapped FROM events")
def angle_wrap(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rnd(wrap(F.col("value") - 40, 180.0), 4).alias("wrapped"))


def aligned(spark, sf_dir):
    def flat(df, keys):
        return with_planes(df).select(*keys, *[F.col(f"planes.{n}").alias(n) for n in NAMES])

    return P.align_planes(flat(tensors(spark, sf_dir), ["id", "ens"]), flat(tensor_truth(spark, sf_dir), ["ens"]), ["ens"])


def _w(expr: str, period: float = 360.0) -> str:
    h = period / 2
    return f"((({expr} + {h}) % {period}) + {period}) % {period} - {h}"


def _dist(a: str, b: str, i: int, j: int) -> str:
    return f"pow({_w(f'{a}.strike{i} - {b}.strike{j}')}, 2) + pow({a}.dip{i} - {b}.dip{j}, 2) + pow({_w(f'{a}.rake{i} - {b}.rake{j}')}, 2)"


ALIGN = f"""tt AS (SELECT ens AS id, ens, m1, m2, m3, m4, m5, m6 FROM truth),
{{truth_planes}},
ds AS (SELECT s.*, {", ".join(f"{_dist('s', 't', i, j)} AS d{i}{j}" for i in (1, 2) for j in (1, 2))}, {", ".join(f"t.{n} AS t_{n}" for n in NAMES)} FROM planes s JOIN tplanes t USING (ens)),
ch AS (SELECT ens, sum(least(d11, d21)) <= sum(least(d12, d22)) AS one FROM ds GROUP BY ens),
al AS (SELECT ds.id, ds.ens, {", ".join(f"CASE WHEN CASE WHEN one THEN d11 <= d21 ELSE d12 <= d22 END THEN {q}1 ELSE {q}2 END AS {q}, CASE WHEN one THEN t_{q}1 ELSE t_{q}2 END AS true_{q}" for q in ('strike', 'dip', 'rake'))} FROM ds JOIN ch USING (ens))"""


def _renamed(sql: str, prefix: str) -> str:
    return re.sub(r"\b(pn|pc|pi0|pv|px|pb|pa|pf|pd|pu|pg|pl|planes)\b", lambda m: prefix + m.group(1), sql)


ALIGN = ALIGN.replace("{truth_planes}", _renamed(planes_sql("tt"), "t"))


@query("aligned_planes", ctes("mt", "truth") + ", " + planes_sql("mt") + ", " + ALIGN
       + f" SELECT id, ens, {R('strike', 3)} AS strike, {R('dip', 3)} AS dip, {R(_w('rake'), 3)} AS rake, {R('true_strike', 3)} AS true_strike FROM al")
def aligned_planes(spark, sf_dir):
    return aligned(spark, sf_dir).select("id", "ens", rnd("strike", 3).alias("strike"), rnd("dip", 3).alias("dip"), rnd("rake", 3).alias("rake"), rnd("true_strike", 3).alias("true_strike"))


@query("reparametrised_samples", ctes("mt") + f", {EIG}, " + planes_sql("mt") + f""" SELECT src.id, {R('gamma', 3)} AS gamma, {R('delta', 4)} AS delta, {R('(log10(nrm / sqrt(2)) + 16 - 9.1) / 1.5', 5)} AS mw,
{R('strike1', 3)} AS strike, {R('dip1', 3)} AS dip, {R('rake1', 3)} AS rake FROM src JOIN planes USING (id)""")
def reparametrised_samples(spark, sf_dir):
    out = reparametrise(tensors(spark, sf_dir))
    return out.select("id", rnd("gamma", 3).alias("gamma"), rnd("delta", 4).alias("delta"), rnd("Mw", 5).alias("mw"), rnd("strike", 3).alias("strike"), rnd("dip", 3).alias("dip"), rnd("rake", 3).alias("rake"))


@query("plane_selection_callback", ctes("mt") + ", " + planes_sql("mt") + f" SELECT id, {R('CASE WHEN dip1 <= dip2 THEN strike1 ELSE strike2 END', 3)} AS strike, {R('least(dip1, dip2)', 3)} AS dip FROM planes")
def plane_selection_callback(spark, sf_dir):
    flatter = lambda pair: F.when(pair["dip1"] <= pair["dip2"], F.struct(pair["strike1"].alias("strike"), pair["dip1"].alias("dip"), pair["rake1"].alias("rake"))).otherwise(
        F.struct(pair["strike2"].alias("strike"), pair["dip2"].alias("dip"), pair["rake2"].alias("rake")))
    return reparametrise(tensors(spark, sf_dir), select=flatter).select("id", rnd("strike", 3).alias("strike"), rnd("dip", 3).alias("dip"))


@query("tensor_conventions", ctes("mt") + ", s AS (SELECT id, m1/1e16 AS rr, m2/1e16 AS tt, m3/1e16 AS pp, m4/1e16 AS rt, m5/1e16 AS rp, m6/1e16 AS tp FROM mt) SELECT id, "
       + ", ".join(f"{R(e, 7)} AS {n}" for n, e in {
           "nn": "tt", "ee": "pp", "dd": "rr", "ne": "-tp", "nd": "rt", "ed": "-rp", "enu_xy": "-tp", "enu_xz": "rp", "enu_yz": "-rt", "back": "rp"}.items()) + " FROM s")
def tensor_conventions(spark, sf_dir):
    t = M.convert_axes(tensors(spark, sf_dir), "use", "ned", prefix="n")
    t = M.convert_axes(t, "use", "enu", prefix="e")
    t = M.convert_axes(t, "enu", "ned", [f"e{k}" for k in range(1, 7)], prefix="v")
    t = M.convert_axes(t, "ned", "use", [f"v{k}" for k in range(1, 7)], prefix="b")
    pick = {"nn": "v1", "ee": "v2", "dd": "v3", "ne": "v4", "nd": "v5", "ed": "n6", "enu_xy": "e4", "enu_xz": "e5", "enu_yz": "e6", "back": "b5"}
    return t.select("id", *[rnd(F.col(c) / 1e16, 7).alias(n) for n, c in pick.items()])


@query("hudson_parameters", ctes("mt") + f""", {EIG}, h AS (SELECT id, (l1+l2+l3)/3 AS iso, l2 - (l1+l2+l3)/3 AS mid, greatest(abs(l1 - (l1+l2+l3)/3), abs(l3 - (l1+l2+l3)/3)) AS o FROM eig),
tk AS (SELECT id, iso / (abs(iso) + o) AS k, 2 * mid / o * (1 - abs(iso / (abs(iso) + o))) AS tau FROM h)
SELECT id, {R('k', 4)} AS k, {R('tau', 4)} AS tau,
{R('CASE WHEN tau > 0 AND k > 0 THEN CASE WHEN tau < 4 * k THEN tau / (1 - tau / 2) ELSE tau / (1 - 2 * k) END WHEN tau < 0 AND k < 0 THEN CASE WHEN tau > 4 * k THEN tau / (1 + tau / 2) ELSE tau / (1 + 2 * k) END ELSE tau END', 4)} AS u,
{R('CASE WHEN tau > 0 AND k > 0 THEN CASE WHEN tau < 4 * k THEN k / (1 - tau / 2) ELSE k / (1 - 2 * k) END WHEN tau < 0 AND k < 0 THEN CASE WHEN tau > 4 * k THEN k / (1 + tau / 2) ELSE k / (1 + 2 * k) END ELSE k END', 4)} AS v FROM tk""")
def hudson_parameters(spark, sf_dir):
    s = M.with_hudson(M.with_source_type(tensors(spark, sf_dir)))
    return s.select("id", rnd("hudson_k", 4).alias("k"), rnd("hudson_tau", 4).alias("tau"), rnd("hudson_u", 4).alias("u"), rnd("hudson_v", 4).alias("v"))


@query("plane_parameters", ctes("mt") + ", " + planes_sql("mt") + f""" SELECT id, {R('radians(CASE WHEN abs(rake1) <= 90 THEN strike1 ELSE strike2 END)', 4)} AS kappa, {R('cos(radians(CASE WHEN abs(rake1) <= 90 THEN dip1 ELSE dip2 END))', 4)} AS h,
{R('radians(CASE WHEN abs(rake1) <= 90 THEN rake1 ELSE rake2 END)', 4)} AS sigma, false AS dc FROM planes""")
def plane_parameters(spark, sf_dir):
    s = M.with_source_type(M.with_kappa_h_sigma(with_planes(tensors(spark, sf_dir))))
    return s.select("id", rnd("kappa", 4).alias("kappa"), rnd("h", 4).alias("h"), rnd("sigma", 4).alias("sigma"), M.is_double_couple().alias("dc"))


@query("principal_axes", ctes("mt") + ", " + planes_sql("mt") + f""" SELECT id, {R('abs(t[1])', 4)} AS t1, {R('abs(t[3])', 4)} AS t3, {R('abs(p[2])', 4)} AS p2, {R('abs(t[2] * p[3] - t[3] * p[2])', 4)} AS n1 FROM pa""")
def principal_axes(spark, sf_dir):
    t = M.convert_axes(tensors(spark, sf_dir), "use", "planes", prefix="q").withColumn("a", M.principal_axes(*[f"q{k}" for k in range(1, 7)]))
    return t.select("id", rnd(F.abs(F.col("a.t")[0]), 4).alias("t1"), rnd(F.abs(F.col("a.t")[2]), 4).alias("t3"), rnd(F.abs(F.col("a.p")[1]), 4).alias("p2"), rnd(F.abs(F.col("a.n")[0]), 4).alias("n1"))


_UNIT = "v AS (SELECT id, x[1] / sqrt(x[1]*x[1]+x[2]*x[2]+x[3]*x[3]) AS a, x[2] / sqrt(x[1]*x[1]+x[2]*x[2]+x[3]*x[3]) AS b, x[3] / sqrt(x[1]*x[1]+x[2]*x[2]+x[3]*x[3]) AS c FROM tr)"


@query("sphere_projections", ctes("tr") + f", {_UNIT} SELECT id, {R('CASE WHEN c >= 0 THEN a * sqrt(2 / (1 + c)) END')} AS area_x, {R('CASE WHEN c <= 0 THEN b / (1 - c) END')} AS upper_angle_y, {R('CASE WHEN c >= 0 THEN a / (1 + c) ELSE -a / (1 - c) END')} AS folded_x FROM v")
def sphere_projections(spark, sf_dir):
    x = F.col("x")
    n = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    v = traces(spark, sf_dir).select("id", (x[0] / n).alias("a"), (x[1] / n).alias("b"), (x[2] / n).alias("c"))
    abc = [F.col(k) for k in "abc"]
    area, _ = M.project_sphere(*abc)
    _, upper = M.project_sphere(*abc, kind="angle", lower=False)
    folded, _ = M.project_sphere(*abc, kind="angle", back_project=True)
    return v.select("id", rnd(area).alias("area_x"), rnd(upper).alias("upper_angle_y"), rnd(folded).alias("folded_x"))


@query("lune_coordinates", ctes("mt") + f", {EIG}, h AS (SELECT id, radians(gamma) AS g, radians(delta) AS d FROM src) SELECT id, {R('2 * sqrt(2) * cos(d) * sin(g / 2) / sqrt(1 + cos(d) * cos(g / 2))', 4)} AS x, {R('sqrt(2) * sin(d) / sqrt(1 + cos(d) * cos(g / 2))', 5)} AS y FROM h")
def lune_coordinates(spark, sf_dir):
    x, y = M.lune_coordinates(F.col("gamma"), F.col("delta"))
    return M.with_source_type(tensors(spark, sf_dir)).select("id", rnd(x, 4).alias("x"), rnd(y, 5).alias("y"))


@query("radiation_pattern", ctes("mt") + f""", g AS (SELECT r * 8 + q AS direction, 0.001 + q * (2 * pi() - 0.002) / 7 AS phi, 0.001 + r * (pi() - 0.002) / 7 AS theta FROM generate_series(0, 7) a(q) CROSS JOIN generate_series(0, 7) b(r)),
k AS (SELECT direction, sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z FROM g),
amp AS (SELECT id, direction, m1*x*x + m2*y*y + m3*z*z + 2*(m4*x*y + m5*x*z + m6*y*z) AS a FROM mt CROSS JOIN k)
SELECT id, direction::INTEGER AS direction, {R('a / max(abs(a)) OVER (PARTITION BY id)')} AS amplitude FROM amp""")
def radiation_pattern(spark, sf_dir):
    return M.radiation_pattern(tensors(spark, sf_dir), 8).select("id", "direction", rnd("amplitude").alias("amplitude"))


_SCALE = "q AS (SELECT event_id, value * CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS x, event_type AS kind FROM events)"


def _signed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("value") * F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)).alias("x"), F.col("event_type").alias("kind"))


@query("parameter_scalers", f"""WITH {_SCALE} SELECT event_id, {R('(x + 100) / 300')} AS unit, {R('sign(x) * (log10(greatest(0.5, least(100.0, abs(x)))) - log10(0.5)) / (log10(100.0) - log10(0.5)) * 0.5 + 0.5')} AS signed,
{R('sign(x) * CASE WHEN least(100.0, abs(x)) <= 0.5 THEN least(100.0, abs(x)) / 0.5 * 0.05 ELSE 0.45 * (log10(least(100.0, abs(x))) - log10(0.5)) / (log10(100.0) - log10(0.5)) END + 0.5')} AS linear,
{R("CASE WHEN kind = 'view' THEN (x + 100) / 300 WHEN kind = 'click' THEN sign(x) * (log10(greatest(0.5, least(100.0, abs(x)))) - log10(0.5)) / (log10(100.0) - log10(0.5)) * 0.5 + 0.5 END")} AS by_kind FROM q""")
def parameter_scalers(spark, sf_dir):
    x, lo, hi = F.col("x"), F.lit(0.5), F.lit(100.0)
    q = _signed(spark, sf_dir)
    wide = F.when(F.col("kind") == "view", F.lit(-100.0)).otherwise(lo), F.when(F.col("kind") == "view", F.lit(200.0)).otherwise(hi)
    return q.select(
        "event_id", rnd(S.to_unit(x, F.lit(-100.0), F.lit(200.0))).alias("unit"), rnd(S.signed_log(x, lo, hi)).alias("signed"), rnd(S.linear_log(x, lo, hi)).alias("linear"),
        rnd(S.scale_by_type(F.col("kind"), x, *wide, {"view": "unit", "click": "signed log"})).alias("by_kind"))


@query("parameter_scalers_inverse", f"WITH {_SCALE} SELECT event_id, {R('x', 5)} AS unit, {R('CASE WHEN abs(x) <= 0.5 THEN 0 ELSE sign(x) * least(100.0, abs(x)) END', 5)} AS signed FROM q")
def parameter_scalers_inverse(spark, sf_dir):
    x, lo, hi = F.col("x"), F.lit(0.5), F.lit(100.0)
    unit = S.from_unit(S.to_unit(x, F.lit(-100.0), F.lit(200.0)), F.lit(-100.0), F.lit(200.0))
    return _signed(spark, sf_dir).select("event_id", rnd(unit, 5).alias("unit"), rnd(S.signed_log_inverse(S.signed_log(x, lo, hi), lo, hi), 5).alias("signed"))


@query("plot_units", f"WITH m AS (SELECT event_id, value, min(value) OVER () AS lo FROM events) SELECT event_id, {R('(value - lo) * 111.1', 4)} AS km_lat, {R('(value - lo) * 86', 4)} AS km_lon, {R('10 * value / pow(10, floor(log10(abs(value + 1))))', 5)} AS tensor_unit FROM m")
def plot_units(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lo = e.agg(F.min("value")).scalar()
    v = F.col("value")
    return e.withColumn("lo", lo).select(
        "event_id", rnd(S.degrees_to_km(v, F.col("lo"), "latitude"), 4).alias("km_lat"), rnd(S.degrees_to_km(v, F.col("lo"), "longitude"), 4).alias("km_lon"),
        rnd(S.tensor_plot_unit(v, v + 1), 5).alias("tensor_unit"))


@query("signed_log_minmax_fit", ctes("lg") + f""", f AS (SELECT i, 5 * min(abs(v)) AS lo, max(abs(v)) AS hi FROM lg GROUP BY i),
s AS (SELECT id, i, sign(v) * (log10(greatest(lo, least(hi, abs(v)))) - log10(lo)) / (log10(hi) - log10(lo)) * 0.5 + 0.5 AS s FROM lg JOIN f USING (i)), b AS (SELECT i, min(s) AS a, max(s) AS b FROM s GROUP BY i)
SELECT id, i::INTEGER AS i, {R('(s - a) / (b - a)', 5)} AS scaled FROM s JOIN b USING (i)""")
def signed_log_minmax_fit(spark, sf_dir):
    long = traces(spark, sf_dir).select("id", F.posexplode("x").alias("i", "v"))
    return fit_signed_log_minmax(long, ["i"], "v").select("id", "i", rnd("scaled", 5).alias("scaled"))
