"""Prior draws, mechanism tables and perturbed models: pure functions of a row id."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietwave.functions.batches import blocks, lists_of
from quietwave.functions.draws import normal, normal_rows, uniform
from quietwave.functions.normal import normal_cdf, normal_quantile
from quietwave.functions.tensors import CONVENTIONS
from quietwave.operators.ordering import ROWS_PER_CHUNK, first_n, order_cuts, ranked, running
from quietwave.session import materialise

Sampler = Callable[[list, str, list], Column]


def draw_ids(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Row ids lo..hi-1 with the simulation name sim_<i>."""
    return spark.range(lo, hi).withColumn("name", F.format_string("sim_%d", F.col("id")))


def constant(keys: list, stream: str, args: list) -> Column:
    """args = [values]"""
    return F.array(*[F.lit(float(v)) for v in args[0]])


def uniform_draw(keys: list, stream: str, args: list) -> Column:
    """args = [lower bounds, upper bounds]"""
    return F.array(*[
        F.lit(float(lo)) + (float(hi) - float(lo)) * uniform(keys, f"{stream}.{d}") for d, (lo, hi) in enumerate(zip(*args))])


def gaussian_draw(keys: list, stream: str, args: list) -> Column:
    """args = [means, variances]"""
    return F.array(*[
        F.lit(float(m)) + math.sqrt(float(v)) * normal(keys, f"{stream}.{d}") for d, (m, v) in enumerate(zip(*args))])


def truncated_gaussian_draw(keys: list, stream: str, args: list) -> Column:
    """args = [means, variances, lower bounds, upper bounds]; inverse-CDF draw."""
    out = []
    for d, (m, v, lo, hi) in enumerate(zip(*args)):
        sd = math.sqrt(float(v))
        a, b = (NormalDist().cdf((float(t) - float(m)) / sd) for t in (lo, hi))
        p = F.lit(a) + (b - a) * uniform(keys, f"{stream}.{d}")
        value = F.lit(float(m)) + sd * normal_quantile(p)
        out.append(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value)))
    return F.array(*out)


def homogeneous_tensor_draw(keys: list, stream: str, args: list) -> Column:
    """args = [smallest M0, largest M0]: uniform on the unit sphere of tensors, log-uniform moment.

    Five uniforms give the squared radii of three planes and their angles; elements are
    returned as up, south, east.
    """
    # two ordered marks on (0, 1) part a unit square sum among three planes
    marks = [F.lit(0.0), F.sqrt(uniform(keys, f"{stream}.1")) * uniform(keys, f"{stream}.0"), F.sqrt(uniform(keys, f"{stream}.1")), F.lit(1.0)]
    point: list[Column] = []
    for plane in range(3):
        radius, angle = F.sqrt(marks[plane + 1] - marks[plane]), 2 * math.pi * uniform(keys, f"{stream}.{plane + 2}")
        point += [radius * F.cos(angle), radius * F.sin(angle)]
    least, most = (math.log(float(a)) for a in args[:2])
    moment = F.exp(F.lit(least) + (most - least) * uniform(keys, f"{stream}.m"))
    # north, east, down: the diagonal counts once in the norm, the other elements twice
    ned = [math.sqrt(2.0) * moment * p for p in point[:3]] + [moment * point[k] for k in (3, 5, 4)]
    return F.array(*[ned[element - 1] * sign for element, sign in CONVENTIONS[("ned", "use")]])


def velocity_model_draw(keys: list, stream: str, args: list) -> Column:
    """args = [layers as six-number lists, kappa]: thickness, Vp, Vs each times N(1, kappa %)."""
    layers, kappa = args

    def layer(k: int, row: list) -> Column:
        shaken = [float(v) * (1 + kappa / 100 * normal(keys, f"{stream}.{k}.{f}")) for f, v in enumerate(row[:3])]
        return F.array(*shaken, *[F.lit(float(v)) for v in row[3:]])

    return F.array(*[layer(k, row) for k, row in enumerate(layers)])


SAMPLERS: dict[str, Sampler] = {
    "constant": constant,
    "uniform": uniform_draw,
    "uniform known": uniform_draw,
    "gaussian": gaussian_draw,
    "truncated gaussian": truncated_gaussian_draw,
    "moment tensor log prior": homogeneous_tensor_draw,
    "velocity model": velocity_model_draw,
}


def prior_table(ids: DataFrame, key: str, choice: dict[str, tuple[str, list]], stream: str) -> DataFrame:
    """One array column per parameter group; `choice` maps a group to (sampler name, args).

    'latin hypercube' ranks the whole table; all other samplers look at their row only.
    """
    for group, (name, args) in choice.items():
        if name == "latin hypercube":
            ids = latin_hypercube(ids, key, *args, f"{stream}.{group}", out=group)
        elif name in SAMPLERS:
            ids = ids.withColumn(group, SAMPLERS[name]([key], f"{stream}.{group}", args))
        else:
            raise KeyError(f"unknown sampler {name}")
    return ids


def latin_hypercube(ids: DataFrame, key: str, lower: list[float], upper: list[float], stream: str, out: str = "draw",
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """One draw per stratum and dimension; each dimension has its own distributed permutation.

    A rank over several chunks reads its input more than once, so it is written before the next
    dimension ranks it: the work grows with the number of dimensions, not with its power of two.
    """
    size = ids.agg(F.count(F.lit(1))).scalar()
    table = ids
    for d in range(len(lower)):
        keyed = table.withColumn("_u", uniform([key], f"{stream}.order.{d}"))
        cuts = order_cuts(keyed, ["_u", key], rows_per_chunk)
        table = running(keyed, ["_u", key], {f"_r{d}": ("count", None)}, cuts=cuts).drop("_u")
        if cuts and d + 1 < len(lower):
            table = materialise(table, "hypercube")
    table = table.withColumn("_size", size)
    values = [
        F.lit(float(lo)) + (float(hi) - float(lo)) * (F.col(f"_r{d}") - uniform([key], f"{stream}.in.{d}")) / F.col("_size")
        for d, (lo, hi) in enumerate(zip(lower, upper))]
    return table.withColumn(out, F.array(*values)).drop("_size", *[f"_r{d}" for d in range(len(lower))])


# Elements rr, tt, pp, rt, rp, tp of the named mechanisms.
MECHANISMS = {
    "normal": [1, -1, 0, 0, 0, 0],
    "strike_slip": [0, -1, 1, 0, 0, 0],
    "thrust": [0, 1, -1, 0, 0, 0],
    "pure_isotropic": [1, 1, 1, 0, 0, 0],
    "pure_DC": [1, 0, -1, 0, 0, 0],
    "pure_CLVD": [1, 1, -2, 0, 0, 0],
    "rotated_strike": [0, 0, 0, 1, 0, 0],
}


def mechanism_moments(lower: Column | None, upper: Column) -> Column:
    """Moments to run: upper/1.5, or with a lower bound two log-spaced values between them."""
    if lower is None:
        return F.array(upper / 1.5)
    a, b = F.log10(lower), F.log10(upper)
    return F.array(F.pow(F.lit(10.0), a + (b - a) / 3), F.pow(F.lit(10.0), a + (b - a) * 2 / 3))


def mechanism_table(moments: DataFrame, m0: str = "m0", names: list[str] | None = None) -> DataFrame:
    """Every named mechanism at every moment: name <type>_<Mw>M and elements of that moment."""
    entries = []
    for name in names or list(MECHANISMS):
        e = np.array(MECHANISMS[name], float)
        size = math.sqrt(np.sum(e**2) / 2)  # each of the six listed elements counts once
        entries.append(F.struct(F.lit(name).alias("mechanism"), F.array(*[F.lit(float(v / size)) for v in e]).alias("unit")))
    spread = moments.withColumn("_e", F.explode(F.array(*entries)))
    mw = (F.log10(m0) - 9.1) / 1.5
    return spread.withColumns({
        "mechanism": F.col("_e.mechanism"),
        "name": F.concat(F.col("_e.mechanism"), F.lit("_"), F.format_string("%.2f", mw), F.lit("M")),
        "tensor": F.transform("_e.unit", lambda v: v * F.col(m0)),
    }).drop("_e")


def ensemble_size_sweep(draws: DataFrame, key: str, event: str, sizes: list[int], repeats: int, stream: str,
                        rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows of each (size, repeat) subset; result name <event>_<size>_<repeat>."""
    spread = draws.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = spread.withColumn("_u", uniform([key, "repeat"], stream))
    drawn = first_n(keyed, ["_u", key], max(sizes), ["repeat"])
    order = ranked(drawn, ["_u", key], ["repeat"], "_rank", rows_per_chunk)
    chosen = order.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("_rank"))))
    return chosen.withColumn("result", F.concat_ws("_", F.lit(event), "size", "repeat")).drop("_u", "_rank")


def clip_unit(x: str) -> Column:
    """Scaled statistics outside the box are held at its sides."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def gaussian_noise(df: DataFrame, keys: list, n: int, sigma: Column, stream: str, out: str = "noise") -> DataFrame:
    """Independent noise of n samples: sigma * z, for scalar and diagonal covariances."""
    index = F.sequence(F.lit(0), F.lit(n - 1))
    return df.withColumn(out, F.transform(index, lambda i: normal([*keys, i], stream) * sigma))


# --- layered models --------------------------------------------------------------

def density_from_vp(vp: Column) -> Column:
    """Quintic density law in g/cm^3 for Vp in km/s, at least 1."""
    # Published coefficients of vp, vp^2, ..., vp^5.
    coefficients = [1.6612, -0.4721, 0.0671, -0.0043, 0.000106]
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * vp + F.lit(c)
    return F.greatest(total * vp, F.lit(1.0))


def limit_vs(vp: Column, vs: Column) -> Column:
    """Vs above Vp/sqrt 2 becomes 0.99 Vp/sqrt 2."""
    top = vp / math.sqrt(2.0)
    return F.when(vs > top, top * 0.99).otherwise(vs)


def perturb_independent(layers: DataFrame, keys: list, copies: int, kappa: float, stream: str) -> DataFrame:
    """`copies` models per model: thickness, Vp, Vs each times N(1, kappa %)."""
    spread = layers.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return spread.withColumns({
        c: F.col(c) * (1 + kappa / 100 * normal([*keys, "copy"], f"{stream}.{c}")) for c in ("thickness", "vp", "vs")})


def smooth_fields(white: np.ndarray, spacing: np.ndarray, length: float, deviation: float) -> np.ndarray:
    """Rows of white noise smoothed over `length`, centred, scaled to `deviation`.

    The ends are mirrored.  Each row has its own spacing, so its own Gaussian width;
    weights are folded onto the 2n mirrored positions, where they repeat.
    """
    rows, n = white.shape
    sigma = np.maximum(0.5, length / spacing)
    radius = (4.0 * sigma + 0.5).astype(int)
    folded, total = np.zeros((rows, 2 * n)), np.zeros(rows)
    for shift in range(-int(radius.max()), int(radius.max()) + 1):
        w = np.where(abs(shift) <= radius, np.exp(-0.5 * (shift / sigma) ** 2), 0.0)
        folded[:, shift % (2 * n)] += w
        total += w
    at = (np.arange(n)[:, None] + np.arange(2 * n)) % (2 * n)
    mirrored = white[:, np.where(at < n, at, 2 * n - 1 - at)]
    smooth = np.einsum("rif,rf->ri", mirrored, folded / total[:, None])
    smooth = smooth - smooth.mean(axis=1, keepdims=True)
    return smooth / (smooth.std(axis=1, keepdims=True) + 1e-16) * deviation


def perturb_smooth(models: DataFrame, copies: int, stream: str, key: str = "model", length: float = 5.0,
                   std_vp: float = 0.03, std_vs: float = 0.03, std_thickness: float = 0.03, correlation: float = 0.9) -> DataFrame:
    """Correlated smooth log-perturbations of Vp, Vs and thickness, new density.

    Models are rows with arrays thickness, vp, vs (one entry per layer).
    """
    spread = models.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    common_part = max(0.0, min(1.0, correlation))
    # rows: Vp, Vs; columns: the shared field and the two own fields
    mixing = np.sqrt([[common_part, 1 - common_part, 0], [common_part, 0, 1 - common_part]])
    deviations = np.array([std_vp, std_vs])[:, None, None]

    def block(h, vp, vs, common, own_p, own_s, own_h):
        top = np.cumsum(h, axis=1) - h
        spacing = np.median(np.diff(top, axis=1), axis=1) if h.shape[1] > 1 else h[:, 0]
        # layers without thickness leave no spacing; the smoothing length stands in
        spacing = np.where(spacing > 0, spacing, length)
        fields = np.stack([smooth_fields(w, spacing, length, 1.0) for w in (common, own_p, own_s)])
        mixed = np.tensordot(mixing, fields, axes=1)
        size = mixed.std(axis=2, keepdims=True)
        factors = np.exp(np.divide(mixed * deviations, size, out=np.zeros_like(mixed), where=size > 0))
        return h * np.exp(smooth_fields(own_h, spacing, length, std_thickness)), vp * factors[0], vs * factors[1]

    @F.arrow_udf("struct<thickness:array<double>,vp:array<double>,vs:array<double>>")
    def job(keys: pa.Array, h: pa.Array, vp: pa.Array, vs: pa.Array) -> pa.Array:
        results: list = [[], [], []]
        for columns in zip(*[blocks(c) for c in (h, vp, vs)]):
            rows, n = columns[0][0], columns[0][1].shape[1]
            made = [np.empty((len(rows), n)) for _ in results]
            # a smoothing takes 2 n^2 numbers a model
            step = max(1, 1_000_000 // max(1, 2 * n * n))
            for at in range(0, len(rows) if n else 0, step):
                own = slice(at, at + step)
                names = keys.take(pa.array(rows[own]))
                white = normal_rows(names, np.full(len(names), n), [f"{stream}.{field}" for field in ("shared", "p", "s", "h")])
                for out, values in zip(made, block(*[part[own] for _, part in columns], *white.reshape(4, -1, n))):
                    out[own] = values
            for out, values in zip(results, made):
                out.append((rows, values))
        return pa.StructArray.from_arrays([lists_of(len(h), parts) for parts in results], ["thickness", "vp", "vs"])

    # the draws of layer i are those of `normal([key, "copy", i], ...)`
    out = spread.withColumn("_m", job(F.concat_ws("|", F.col(key).cast("string"), F.col("copy").cast("string")), "thickness", "vp", "vs"))
    keep = [c for c in models.columns if c not in ("thickness", "vp", "vs")]
    out = out.select(*keep, "copy", "_m.*")
    out = out.withColumn("vs", F.zip_with("vp", "vs", limit_vs))
    return out.withColumn("rho", F.transform("vp", density_from_vp))


def stair_profile(layers: DataFrame, model: list[str], layer: str = "layer", thickness: str = "thickness",
                  values: list[str] | None = None, top: float = 0.0) -> DataFrame:
    """Running depth and two rows (top and bottom edge) per layer. A model has few layers, so a plain window holds it."""
    above = Window.partitionBy(*model).orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)
    deep = layers.withColumn("_depth", F.sum(thickness).over(above)).withColumn("bottom", F.col("_depth") + F.lit(top))
    edges = F.array(F.struct(F.lit(0).alias("edge"), (F.col("bottom") - F.col(thickness)).alias("depth")),
                    F.struct(F.lit(1).alias("edge"), F.col("bottom").alias("depth")))
    return deep.withColumn("_e", F.explode(edges)).select(*model, layer, *(values or []), "_e.edge", "_e.depth")


# --- kernels from elementary responses -------------------------------------------

# Fixed values: (component, tensor element 1..6, response 0..9, factor, angle function).
# Components are vertical, radial, transverse; angles refer to the station azimuth.
RESPONSE_RULES = [
    ("Z", 1, 5, 0.5, "cos2"), ("Z", 1, 0, -1 / 6, "one"), ("Z", 1, 8, 1 / 3, "one"),
    ("Z", 2, 5, -0.5, "cos2"), ("Z", 2, 0, -1 / 6, "one"), ("Z", 2, 8, 1 / 3, "one"),
    ("Z", 3, 0, 1 / 3, "one"), ("Z", 3, 8, 1 / 3, "one"),
    ("Z", 4, 5, 1.0, "sin2"), ("Z", 5, 2, 1.0, "cos1"), ("Z", 6, 2, 1.0, "sin1"),
    ("R", 1, 6, 0.5, "cos2"), ("R", 1, 1, -1 / 6, "one"), ("R", 1, 9, 1 / 3, "one"),
    ("R", 2, 6, -0.5, "cos2"), ("R", 2, 1, -1 / 6, "one"), ("R", 2, 9, 1 / 3, "one"),
    ("R", 3, 1, 1 / 3, "one"), ("R", 3, 9, 1 / 3, "one"),
    ("R", 4, 6, 1.0, "sin2"), ("R", 5, 3, 1.0, "cos1"), ("R", 6, 3, 1.0, "sin1"),
    ("T", 1, 7, 0.5, "sin2"), ("T", 2, 7, -0.5, "sin2"),
    ("T", 4, 7, -1.0, "cos2"), ("T", 5, 4, 1.0, "sin1"), ("T", 6, 4, -1.0, "cos1"),
]


def assemble_kernels(responses: DataFrame, keys: list[str], azimuth: str, back_azimuth: str) -> DataFrame:
    """Kernels (keys, component Z/N/E, element, i, value) from the ten responses of a station.

    `responses` has keys, response 0..9, x array, azimuth and back-azimuth in degrees.
    The responses of a sample come into one row and are weighted into the kernels, rotation included.
    A sample without the last response belongs to an unfinished station and gives no row; a kernel
    that lacks another response it is made of is null, not the sum of the rest.
    """
    last = max(rule[2] for rule in RESPONSE_RULES)
    long = responses.select(*keys, "response", F.radians(azimuth).alias("_az"), F.radians(back_azimuth).alias("_baz"), F.posexplode("x").alias("i", "_x"))
    wide = long.groupBy(*keys, "i").agg(
        F.max("_az").alias("_az"), F.max("_baz").alias("_baz"),
        *[F.max(F.when(F.col("response") == r, F.col("_x"))).alias(f"_g{r}") for r in range(last + 1)]).where(F.col(f"_g{last}").isNotNull())
    az, baz = F.col("_az"), F.col("_baz")
    angle = {"one": F.lit(1.0), "cos1": F.cos(az), "sin1": F.sin(az), "cos2": F.cos(2 * az), "sin2": F.sin(2 * az)}
    turned = {"Z": [("Z", F.lit(1.0))], "R": [("N", -F.cos(baz)), ("E", -F.sin(baz))], "T": [("N", F.sin(baz)), ("E", -F.cos(baz))]}
    sums: dict[tuple, Column] = {}
    for c, e, r, w, f in RESPONSE_RULES:
        for target, spin in turned[c]:
            term = F.lit(w) * angle[f] * spin * F.col(f"_g{r}")
            sums[target, e] = sums[target, e] + term if (target, e) in sums else term
    entries = [F.struct(F.lit(target).alias("component"), F.lit(e).alias("element"), value.alias("value")) for (target, e), value in sums.items()]
    return wide.withColumn("_k", F.explode(F.array(*entries))).select(*keys, "_k.component", "_k.element", "i", "_k.value")
