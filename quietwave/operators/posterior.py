"""Posterior samples: bias and z, planes, coverage, densities, histograms, summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwave.functions.angles import wrap
from quietwave.functions.normal import normal_cdf, normal_quantile
from quietwave.operators.ordering import ROWS_PER_CHUNK, chunk_of, group_quantiles, join_same, ranked, running, with_totals
from quietwave.session import materialise

DEVIATION_FLOOR = 1e-12
# Period in degrees of each reported quantity, None for a linear one.
PERIODS = {"gamma": 60.0, "delta": 180.0, "Mw": None, "strike": 360.0, "dip": None, "rake": 360.0}


def bias_table(samples: DataFrame, groups: list[str], value: str = "value", truth: str = "truth", period: str = "period") -> DataFrame:
    """Bias mu, deviation sd, z = mu/sd, u = Phi(z) and spread per group.

    Residuals of a quantity with a period are wrapped; its spread is the circular
    deviation of the samples, else the sample deviation.
    """
    p = F.col(period)
    residual = F.when(p.isNull(), F.col(value) - F.col(truth)).otherwise(
        F.pmod(F.col(value) - F.col(truth) + p / 2, p) - p / 2)
    angle = F.col(value) * 2 * math.pi / p
    stats = samples.withColumn("_res", residual).groupBy(*groups).agg(
        F.avg("_res").alias("mu"), F.stddev_samp("_res").alias("_sd"), F.stddev_samp(value).alias("_linear"),
        F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"), F.max(p).alias("_p"))
    floor = F.lit(DEVIATION_FLOOR)
    stats = stats.withColumn("sd", F.coalesce(F.greatest(F.col("_sd"), floor), floor))
    stats = stats.withColumn("z", F.col("mu") / F.col("sd"))
    length = F.least(F.lit(1.0), F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")))
    circular = F.col("_p") / (2 * math.pi) * F.sqrt(F.abs(-2 * F.log(length)))
    return stats.withColumn("u", normal_cdf(F.col("z"))).withColumn(
        "spread", F.when(F.col("_p").isNull(), F.col("_linear")).otherwise(circular)
    ).select(*groups, "mu", "sd", "z", "u", "spread")


def plane_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared strike, dip and rake differences, strike and rake wrapped."""
    s, d, r = wrap(a[0] - b[0], 360.0), a[1] - b[1], wrap(a[2] - b[2], 360.0)
    return s * s + d * d + r * r


def align_planes(samples: DataFrame, truth: DataFrame, event: list[str]) -> DataFrame:
    """Truth plane with the least summed distance, then the nearer plane of each sample.

    Both inputs have strike1..rake2.  Adds strike, dip, rake and true_strike, true_dip,
    true_rake; ties take the first plane.
    """
    names = [f"{q}{i}" for i in (1, 2) for q in ("strike", "dip", "rake")]
    reference = truth.select(*event, *[F.col(n).alias(f"_t_{n}") for n in names])

    def plane(prefix: str, i: int) -> tuple[Column, Column, Column]:
        return tuple(F.col(f"{prefix}{q}{i}") for q in ("strike", "dip", "rake"))

    joined = samples.join(reference, event).withColumns({
        f"_d{i}{j}": plane_distance(plane("", i), plane("_t_", j)) for i in (1, 2) for j in (1, 2)})
    choice = joined.groupBy(*event).agg(
        F.sum(F.least("_d11", "_d21")).alias("_s1"), F.sum(F.least("_d12", "_d22")).alias("_s2"))
    picked = joined.join(choice.select(*event, (F.col("_s1") <= F.col("_s2")).alias("_first")), event)
    nearer = F.when(F.col("_first"), F.col("_d11") <= F.col("_d21")).otherwise(F.col("_d12") <= F.col("_d22"))

    def value(q: str) -> Column:
        v = F.when(nearer, F.col(f"{q}1")).otherwise(F.col(f"{q}2"))
        t = F.when(F.col("_first"), F.col(f"_t_{q}1")).otherwise(F.col(f"_t_{q}2"))
        if q == "strike":
            return F.pmod(v, F.lit(360.0)), F.pmod(t, F.lit(360.0))
        return (wrap(v, 360.0), wrap(t, 360.0)) if q == "rake" else (v, t)

    out = {}
    for q in ("strike", "dip", "rake"):
        out[q], out[f"true_{q}"] = value(q)
    return picked.withColumns(out).drop(*[c for c in picked.columns if c.startswith("_")])


def ordered_z(scores: DataFrame, groups: list[str], z: str = "z", row_id: str = "id", limit: float = 5.8,
              rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Sorted z with index i and expected normal value, both held in [-limit, limit]."""
    live = scores.where(F.col(z).isNotNull() & ~F.isnan(z))
    order = ranked(live, [z, row_id], groups, "i", rows_per_chunk)
    sizes = live.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    hold = lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), c))
    return order.join(sizes, groups).withColumn("z", hold(F.col(z))).withColumn(
        "expected", hold(normal_quantile((F.col("i") - 0.5) / F.col("n"))))


def coverage_band(coverage: DataFrame, level: str = "level", value: str = "ecp", ks: tuple = (1, 2)) -> DataFrame:
    """Mean expected coverage per level and its band mean -/+ k population deviations."""
    stats = coverage.groupBy(level).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"))
    for k in ks:
        stats = stats.withColumn(f"lo{k}", F.col("mean") - k * F.col("_sd")).withColumn(f"hi{k}", F.col("mean") + k * F.col("_sd"))
    return stats.drop("_sd")


def smooth_reflected(values: Column, sigma: float = 1.0, truncate: float = 4.0) -> Column:
    """Gaussian smoothing of an array; the ends are mirrored, edge sample repeated."""
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = weights / weights.sum()
    n = F.size(values)

    def at(i: Column, shift: int) -> Column:
        j = F.pmod(i + F.lit(shift), 2 * n)
        return F.try_element_at(values, (F.when(j < n, j).otherwise(2 * n - 1 - j) + 1).cast("int"))

    def smooth(v: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for shift, w in zip(range(-radius, radius + 1), weights):
            total = total + F.lit(float(w)) * at(i, shift)
        return total

    return F.transform(values, smooth)


def credibility_ranks(coverage: DataFrame, boot: str = "boot", level: str = "level", value: str = "ecp",
                      sigma: float = 1.0, band: tuple = (0.025, 0.975)) -> DataFrame:
    """Smoothed, mean-one histogram of credibility ranks with a bootstrap band.

    The histogram is the difference of mean coverage between levels; the band is the
    quantiles of the same differences in each bootstrap.  Levels are a short grid.
    """
    steps = Window.partitionBy(boot).orderBy(level)
    diffs = coverage.withColumn("_d", F.col(value) - F.lag(value).over(steps)).where("_d IS NOT NULL")
    means = diffs.groupBy(level).agg(F.avg("_d").alias("_m"))
    packed = means.agg(F.array_sort(F.collect_list(F.struct(level, "_m"))).alias("_a")).select(
        F.transform("_a", lambda s: s[level]).alias("_levels"), F.transform("_a", lambda s: s["_m"]).alias("_v"))
    smooth = packed.select("_levels", smooth_reflected(F.col("_v"), sigma).alias("_h"))
    mean = F.try_divide(F.aggregate("_h", F.lit(0.0), lambda a, v: a + v), F.size("_h").cast("double"))
    ranks = smooth.withColumn("_mean", mean).select(F.inline(F.arrays_zip("_levels", "_h")), "_mean").select(
        F.col("_levels").alias(level), F.try_divide("_h", "_mean").alias("rank"))
    lo, hi = (float(q) for q in band)
    bands = group_quantiles(diffs, [level], "_d", boot, [lo, hi]).groupBy(level).agg(
        F.max(F.when(F.col("q") == lo, F.col("value"))).alias("lo"), F.max(F.when(F.col("q") == hi, F.col("value"))).alias("hi"))
    return ranks.join(bands, level).select(
        level, "rank", (F.col("rank") + F.col("lo")).alias("lo"), (F.col("rank") + F.col("hi")).alias("hi"))


def _kernels(samples: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Per group the kernel covariance (Scott width, full sample covariance), its determinant and the norm; null without spread."""
    stats = samples.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"),
        F.covar_samp(x, y).alias("_xy"))
    width = F.pow(F.col("_n"), F.lit(-1.0 / 3.0))
    stats = stats.withColumns({c: F.col(c) * width for c in ("_xx", "_yy", "_xy")})
    # samples on a line leave a determinant of rounding errors only
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    stats = stats.withColumn("_det", F.when(det > 1e-12 * F.col("_xx") * F.col("_yy"), det))
    return stats.withColumn("_w", 1 / (F.col("_n") * 2 * math.pi * F.sqrt("_det")))


def _all_cells(sums: DataFrame, kernels: DataFrame, groups: list[str], nx: int, ny: int) -> DataFrame:
    """The density of each group in each cell; null where the group has no spread."""
    cells = kernels.select(*groups, "_w", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    named = sums.withColumnsRenamed({g: f"_g_{g}" for g in groups} | {"ix": "_ix", "iy": "_iy"})
    same = [cells[g].eqNullSafe(named[f"_g_{g}"]) for g in groups]
    return cells.join(named, [*same, F.col("ix") == F.col("_ix"), F.col("iy") == F.col("_iy")], "left").select(
        *groups, "ix", "iy", (F.coalesce("_s", F.lit(0.0)) * F.col("_w")).alias("density"))


def kde_binned(samples: DataFrame, groups: list[str], x: str, y: str, xs: list[float], ys: list[float], fine: int = 4) -> DataFrame:
    """`kde_on_grid` from binned samples: its cost does not grow as samples x cells.

    Each sample is shared linearly between the four nearest nodes of a lattice `fine` times closer than the
    regular grid, which partial aggregates reduce to node weights. Per group the weights are convolved with the kernel
    by FFT. The error falls with the square of the node distance over the kernel width. Nodes reach as far
    beyond the grid as the kernel exceeds exp(-40); what lies further adds less than rounding errors.
    Columns and groups without spread as in `kde_on_grid`; samples with a null or non-finite coordinate take no part.
    """
    grids = [np.asarray(g, float) for g in (xs, ys)]
    steps = [float(g[1] - g[0]) / fine for g in grids]
    if any(not np.allclose(np.diff(g), s * fine, rtol=1e-9) for g, s in zip(grids, steps)):
        raise ValueError("binning needs regular grids")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    live = samples.select(*groups, x, y).where(finite(x) & finite(y))
    kernels = materialise(_kernels(live, groups, x, y), "kernels")
    joined = join_same(live, kernels.where("_det IS NOT NULL"), groups)
    reach = {c: F.ceil(F.sqrt(F.lit(80.0) * F.col(v)) / s) for c, v, s in ((x, "_xx", steps[0]), (y, "_yy", steps[1]))}
    place = {c: (F.col(c) - float(g[0])) / s for c, g, s in ((x, grids[0], steps[0]), (y, grids[1], steps[1]))}
    near = [(place[c] >= -reach[c]) & (place[c] <= (len(g) - 1) * fine + reach[c]) for c, g in ((x, grids[0]), (y, grids[1]))]
    placed = joined.where(near[0] & near[1]).select(*groups, F.floor(place[x]).alias("_i"), F.floor(place[y]).alias("_j"), (place[x] - F.floor(place[x])).alias("_u"), (place[y] - F.floor(place[y])).alias("_v"))
    shares = F.array(*[F.struct((F.col("_i") + a).cast("int").alias("i"), (F.col("_j") + b).cast("int").alias("j"),
                                ((F.col("_u") if a else 1 - F.col("_u")) * (F.col("_v") if b else 1 - F.col("_v"))).alias("c")) for a in (0, 1) for b in (0, 1)])
    nodes = placed.select(*groups, F.inline(shares)).where("c > 0").groupBy(*groups, "i", "j").agg(F.sum("c").alias("c"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*groups).schema.fields)
    nx, ny = (len(g) for g in grids)

    def convolve(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        i, j = rows["i"].to_numpy(int), rows["j"].to_numpy(int)
        lo, wide = (i.min(), j.min()), (np.ptp(i) + 1, np.ptp(j) + 1)
        weights = np.zeros(wide)
        weights[i - lo[0], j - lo[1]] = rows["c"]
        # offsets from a node to an output node: all that occur
        first = [-(n - 1 + o) for n, o in zip(wide, lo)]
        count = [(m - 1) * fine + n for m, n in zip((nx, ny), wide)]
        dx, dy = ((f + np.arange(c)) * s for f, c, s in zip(first, count, steps))
        kernel = np.exp(-0.5 * (head["_yy"] * dx[:, None] ** 2 - 2 * head["_xy"] * dx[:, None] * dy + head["_xx"] * dy ** 2) / head["_det"])
        size = [c + n - 1 for c, n in zip(count, wide)]
        full = np.fft.irfft2(np.fft.rfft2(weights, size) * np.fft.rfft2(kernel, size), size)
        at = [n - 1 + np.arange(m) * fine for n, m in zip(wide, (nx, ny))]
        out = np.maximum(full[np.ix_(*at)], 0.0)
        ix, iy = (g.ravel() for g in np.meshgrid(np.arange(nx), np.arange(ny), indexing="ij"))
        return pd.DataFrame({**{g: [head[g]] * nx * ny for g in groups}, "ix": ix, "iy": iy, "_s": out.ravel()})

    widths = join_same(nodes, kernels.select(*groups, "_xx", "_yy", "_xy", "_det"), groups)
    sums = widths.groupBy(*groups).applyInPandas(convolve, f"{fields}, ix int, iy int, _s double")
    return _all_cells(sums, kernels, groups, nx, ny)


def kde_on_grid(samples: DataFrame, groups: list[str], x: str, y: str, xs: list[float], ys: list[float],
                memory: int = 64 * 1024 * 1024) -> DataFrame:
    """2-D Gaussian density on a grid: Scott bandwidth, full sample covariance. The exact sum; see `kde_binned`.

    Each task sums the kernels of its own samples over the whole grid and emits one row
    per group and cell; sample-cell pairs never leave a task. A group without spread (one sample,
    or samples on a line) has null densities.
    Columns: groups, ix, iy, density.
    """
    kernels = _kernels(samples, groups, x, y)
    stats = kernels.where("_det IS NOT NULL").drop("_w")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*groups).schema.fields)
    gx, gy = (g.ravel() for g in np.meshgrid(np.asarray(xs, float), np.asarray(ys, float), indexing="ij"))
    cells = len(gx)
    step = max(1, memory // (8 * max(cells, 1)))
    ix, iy = (g.ravel() for g in np.meshgrid(np.arange(len(xs)), np.arange(len(ys)), indexing="ij"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, total in sums.items():
                yield pd.DataFrame({**dict(zip(groups, ([k] * cells for k in key))), "ix": ix, "iy": iy, "s": total})
            sums.clear()

        for batch in batches:
            for key, part in batch.groupby(groups, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                xx, yy, xy, det = (float(part[c].iloc[0]) for c in ("_xx", "_yy", "_xy", "_det"))
                px, py = part[x].to_numpy(float), part[y].to_numpy(float)
                total = sums.get(key, np.zeros(cells))
                for at in range(0, len(part), step):
                    dx, dy = px[at:at + step, None] - gx, py[at:at + step, None] - gy
                    total = total + np.exp(-0.5 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det).sum(axis=0)
                sums[key] = total
            if len(sums) * cells * 8 > memory:
                yield from flush()
        yield from flush()

    joined = join_same(samples.select(*groups, x, y), stats.drop("_n"), groups)
    parts = joined.mapInPandas(partial, f"{fields}, ix int, iy int, s double")
    sums = parts.groupBy(*groups, "ix", "iy").agg(F.sum("s").alias("_s"))
    return _all_cells(sums, kernels, groups, len(xs), len(ys))


def hpd_thresholds(cells: DataFrame, groups: list[str], cell: list[str], density: str = "density",
                   levels: tuple = (0.6827, 0.9545), rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Density at which the mass, taken from the highest cells down, first reaches each level."""
    total = cells.groupBy(*groups).agg(F.sum(density).alias("_total"))
    keyed = cells.withColumn("_down", -F.col(density))
    swept = running(keyed, ["_down", *cell], {"_mass": ("sum", density)}, groups, rows_per_chunk=rows_per_chunk)
    share = swept.join(total, groups).withColumn("_share", F.try_divide("_mass", "_total"))
    return share.groupBy(*groups).agg(F.min(density).alias("_least"), *[
        F.max(F.when(F.col("_share") >= p, F.col(density))).alias(f"_p{i}") for i, p in enumerate(levels)
    ]).select(*groups, F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("level"), F.coalesce(f"_p{i}", "_least").alias("threshold"))
        for i, p in enumerate(levels)])).alias("_t")).select(*groups, "_t.*")


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1, the last one closed; null outside."""
    k = F.floor((x - lo) / (hi - lo) * bins).cast("int")
    return F.when((x >= lo) & (x <= hi), F.least(k, F.lit(bins - 1)))


def bin_by_edges(df: DataFrame, x: str, edges: list[float], out: str = "bin") -> DataFrame:
    """Bin between given edges, the last one closed; null outside."""
    inner = [(e,) for e in edges[1:-1]]
    value = chunk_of([x], inner)
    return df.withColumn(out, F.when((F.col(x) >= edges[0]) & (F.col(x) <= edges[-1]), value))


def histogram(df: DataFrame, groups: list[str], x: str, lo: float, hi: float, bins: int, weight: str | None = None,
              density: bool = False) -> DataFrame:
    """Sum of weights per equal-width bin, empty bins as zero."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    counts = df.withColumn("bin", bin_of(F.col(x), lo, hi, bins)).where("bin IS NOT NULL").groupBy(*groups, "bin").agg(
        F.sum(w).alias("value"))
    grid = counts.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*groups, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if density:
        total = counts.groupBy(*groups).agg(F.sum("value").alias("_t"))
        full = with_totals(full, total, groups).withColumn("value", F.try_divide(F.col("value"), F.col("_t") * ((hi - lo) / bins))).drop("_t")
    return full


def histogram_2d(df: DataFrame, groups: list[str], x: str, y: str, xrange: tuple, yrange: tuple, bins: int,
                 weight: str | None = None, density: bool = False) -> DataFrame:
    """Occupied cells only: an empty cell is missing."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    cells = df.withColumns({"bx": bin_of(F.col(x), *xrange, bins), "by": bin_of(F.col(y), *yrange, bins)}).where(
        "bx IS NOT NULL AND by IS NOT NULL").groupBy(*groups, "bx", "by").agg(F.sum(w).alias("value")).where("value != 0")
    if density:
        total = cells.groupBy(*groups).agg(F.sum("value").alias("_t"))
        area = (xrange[1] - xrange[0]) * (yrange[1] - yrange[0]) / bins / bins
        cells = with_totals(cells, total, groups).withColumn("value", F.try_divide(F.col("value"), F.col("_t") * area)).drop("_t")
    return cells


def strongest_per_cell(df: DataFrame, groups: list[str], x: str, y: str, weight: str, row_id: str,
                       xedges: list[float], yedges: list[float]) -> DataFrame:
    """Per occupied cell the row of highest weight, the first one by id on ties."""
    cells = bin_by_edges(bin_by_edges(df, x, xedges, "bx"), y, yedges, "by").where("bx IS NOT NULL AND by IS NOT NULL")
    best = F.max_by(F.struct(x, y, weight), F.struct(F.col(weight), -F.col(row_id)))
    return cells.groupBy(*groups, "bx", "by").agg(best.alias("_b")).select(*groups, "bx", "by", "_b.*")


def unique_samples(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with their count as weight; counted in map tasks first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("weight"))


def most_probable(df: DataFrame, groups: list[str], weight: str, row_id: str, single: bool = False) -> DataFrame:
    """All rows at the largest weight of their group, or the first of them."""
    top = df.groupBy(*groups).agg(F.max(F.struct(F.col(weight), -F.col(row_id))).alias("_top"))
    joined = df.join(top, groups)
    keep = F.col(weight) == F.col(f"_top.{weight}")
    if single:
        keep = keep & (F.col(row_id) == -F.col("_top.col2"))
    return joined.where(keep).drop("_top")


def chain_point(samples: DataFrame, groups: list[str], columns: list[str], logp: str, row_id: str, best: bool = True) -> DataFrame:
    """Row of highest log-probability, or the column means."""
    if best:
        row = F.max_by(F.struct(*columns), F.struct(F.col(logp), -F.col(row_id)))
        return samples.groupBy(*groups).agg(row.alias("_r")).select(*groups, "_r.*")
    return samples.groupBy(*groups).agg(*[F.avg(c).alias(c) for c in columns])


def quantile_traces(traces: DataFrame, groups: list[str], row_id: str, quantiles: tuple = (0.05, 0.5, 0.95), x: str = "x",
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Exact interpolated quantiles per group and sample position: columns i, q, value."""
    long = traces.select(*groups, row_id, F.posexplode(x).alias("i", "v"))
    return group_quantiles(long, [*groups, "i"], "v", row_id, list(quantiles), rows_per_chunk)


def nearest_to_quantile(samples: DataFrame, groups: list[str], value: str, row_id: str, quantiles: tuple = (0.05, 0.5, 0.95)) -> DataFrame:
    """The row whose value lies nearest each quantile of its group, first by id on ties."""
    q = group_quantiles(samples, groups, value, row_id, list(quantiles)).withColumnRenamed("value", "target")
    joined = samples.join(q, groups)
    nearest = F.min_by(F.struct(row_id, value, "target"), F.struct(F.abs(F.col(value) - F.col("target")), F.col(row_id)))
    return joined.groupBy(*groups, "q").agg(nearest.alias("_n")).select(*groups, "q", "_n.*")


def order_chains(samples: DataFrame, step: str = "step", chain: str = "chain", thin: int = 1) -> DataFrame:
    """Sample-major order over chains, every `thin`-th step."""
    return samples.where(F.pmod(F.col(step), F.lit(thin)) == 0).orderBy(step, chain)


def best_iteration(history: DataFrame, groups: list[str], iteration: str = "iteration", misfit: str = "chi2", keep: list[str] | None = None) -> DataFrame:
    """Lowest misfit with its iteration, the earliest on ties."""
    keep = keep or []
    row = F.min_by(F.struct(iteration, misfit, *keep), F.struct(misfit, iteration))
    return history.groupBy(*groups).agg(row.alias("_b")).select(*groups, "_b.*")


def compression_quality(pairs: DataFrame, names: list[str], truth: str = "truth", estimate: str = "estimate") -> DataFrame:
    """Bias and root mean square error per parameter from (truth, estimate) arrays."""
    label = F.array(*[F.lit(n) for n in names])
    long = pairs.select(F.inline(F.arrays_zip(label.alias("parameter"), F.col(truth).alias("truth"), F.col(estimate).alias("estimate"))))
    error = F.col("estimate") - F.col("truth")
    return long.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse"))
