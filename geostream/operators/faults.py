"""Profiles across a fault, elastic dislocations, grid search, bootstrap and moments."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.functions.geodesy import km_to_degrees
from geostream.operators.ordered import number_rows
from geostream.sources.shared import staged


def project_profile(df: DataFrame, azimuth: float, reference: tuple[float, float], half_width_km: float) -> DataFrame:
    """Stations within half_width_km of the profile line, with dist_km along and off_km across it from the reference, v_along,
    v_across and their errors. df: Ecoord, Ncoord (m), velocity, azimuth (degrees), erreast, errnorth."""
    s, c = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
    angle = F.radians(F.col("azimuth") - azimuth)
    error = F.hypot("erreast", "errnorth")
    de, dn = F.col("Ecoord") - reference[0], F.col("Ncoord") - reference[1]
    out = df.withColumns({
        "dist_km": (de * s + dn * c) / 1000, "off_km": (dn * s - de * c) / 1000, "v_along": F.col("velocity") * F.cos(angle), "v_across": -F.col("velocity") * F.sin(angle),
        "err_along": F.abs(error * F.cos(angle)), "err_across": F.abs(error * F.sin(angle)),
    })
    return out.filter(F.abs("off_km") <= half_width_km)


def order_profile(df: DataFrame, drop_first: bool = True) -> DataFrame:
    """Stations by distance along the profile, with rank; the first left out if asked for."""
    ranked = number_rows(df, ("dist_km", "sites"), "rank")
    return ranked.filter("rank > 1") if drop_first else ranked


def back_slip(df: DataFrame, rate: Column) -> DataFrame:
    """df (dist_km, v_across) with d: the velocity, less the block rate on the far side (distance from 0 on)."""
    return df.withColumn("d", F.when(F.col("dist_km") >= 0, F.col("v_across") - rate).otherwise(F.col("v_across")))


def _chinnery(xi: np.ndarray, eta: np.ndarray, q: np.ndarray, sd: np.ndarray, cd: np.ndarray, alpha: float) -> np.ndarray:
    """Surface displacement of a half-infinite corner by unit strike, dip and tensile slip: array (3 slips, 3 axes, n), over 2 pi.

    After Okada (1985), eqs. 25-30, with the limits for q = 0, R + eta = 0 and a vertical fault.
    """
    r = np.sqrt(xi * xi + eta * eta + q * q)
    y, d = eta * cd + q * sd, eta * sd - q * cd
    r_eta = np.maximum(r + eta, 0.0)
    edge = r_eta == 0.0
    inv = np.where(edge, 0.0, 1.0 / np.where(edge, 1.0, r_eta))
    log_eta = np.where(edge, -np.log(np.where(edge, r - eta, 1.0)), np.log(np.where(edge, 1.0, r_eta)))
    with np.errstate(divide="ignore", invalid="ignore"):
        theta = np.where(q != 0.0, np.arctan(xi * eta / (q * r)), 0.0)
        a, b = inv / r, 1.0 / (r * (r + xi))
        rd = r + d
        big = np.sqrt(xi * xi + q * q)
        upright = cd == 0.0
        i5 = np.where(xi == 0.0, 0.0, 2 * alpha / cd * np.arctan((eta * (big + q * cd) + big * (r + big) * sd) / (xi * (r + big) * cd)))
        i4 = alpha / cd * (np.log(rd) - sd * log_eta)
        i3 = alpha * (y / (cd * rd) - log_eta) + sd / cd * i4
        i1 = -alpha * xi / (cd * rd) - sd / cd * i5
        i5 = np.where(upright, -alpha * xi * sd / rd, i5)
        i4 = np.where(upright, -alpha * q / rd, i4)
        i3 = np.where(upright, alpha / 2 * (eta / rd + y * q / rd**2 - log_eta), i3)
        i1 = np.where(upright, -alpha / 2 * xi * q / rd**2, i1)
    i2 = -alpha * log_eta - i3
    strike = (-(xi * q * a + theta + i1 * sd), -(y * q * a + q * cd * inv + i2 * sd), -(d * q * a + q * sd * inv + i4 * sd))
    dip = (-(q / r - i3 * sd * cd), -(y * q * b + cd * theta - i1 * sd * cd), -(d * q * b + sd * theta - i5 * sd * cd))
    twist = xi * q * a - theta
    tensile = (q * q * a - i3 * sd * sd, -d * q * b - sd * twist - i1 * sd * sd, y * q * b + cd * twist - i5 * sd * sd)
    return np.array([strike, dip, tensile]) / (2 * np.pi)


def displacement(length, width, depth, dip, strike, east, north, slips, x, y, nu: float = 0.25) -> np.ndarray:
    """(n, 3) east, north, up at x, y of rectangular dislocations, all arguments arrays of n (slips: strike, dip, tensile).

    depth is that of the lower edge, (east, north) the middle of that edge, angles in degrees. A dislocation with a
    negative length, width or depth, or one that reaches the surface, moves nothing.
    """
    length, width, depth, dip, strike, east, north, x, y = (np.asarray(v, float) for v in (length, width, depth, dip, strike, east, north, x, y))
    sd, cd = np.sin(np.radians(dip)), np.cos(np.radians(dip))
    vertical = np.abs(dip) == 90.0
    sd, cd = np.where(vertical, np.sign(dip), sd), np.where(vertical, 0.0, cd)
    good = (length >= 0) & (width >= 0) & (depth >= 0) & (depth - sd * width >= -1e-12)
    turn = np.radians(strike - 90.0)
    ct, st = np.cos(turn), np.sin(turn)
    along = ct * (x - east) - st * (y - north) + length / 2
    across = st * (x - east) + ct * (y - north)
    p, q = across * cd + depth * sd, across * sd - depth * cd
    corners = sum(sign * _chinnery(xi, eta, q, sd, cd, 1 - 2 * nu) for sign, xi, eta in ((1, along, p), (-1, along, p - width), (-1, along - length, p), (1, along - length, p - width)))
    local = sum(np.asarray(s, float) * np.where(np.asarray(s) == 0, 0.0, corners[k]) for k, s in enumerate(slips))
    out = np.stack([ct * local[0] + st * local[1], ct * local[1] - st * local[0], local[2]], axis=-1)
    return np.where(good[:, None], out, 0.0)


def with_green(df: DataFrame, columns: Mapping[str, str | float], slips: tuple[float, float, float] = (1.0, 0.0, 0.0), nu: float = 0.25) -> DataFrame:
    """df with green_e, green_n, green_u of a unit slip, in Arrow batches.

    columns: for each of length, width, depth, dip, strike, east, north, x, y a column of df or a number, one column at least.
    """
    names = ("length", "width", "depth", "dip", "strike", "east", "north", "x", "y")
    given = [k for k in names if isinstance(columns[k], str)]
    fixed = {k: float(columns[k]) for k in names if k not in given}

    @F.arrow_udf("struct<e: double, n: double, u: double>")
    def kernel(*args: pa.Array) -> pa.Array:
        a = fixed | {k: v.to_numpy(zero_copy_only=False) for k, v in zip(given, args)}
        moved = displacement(*[np.broadcast_to(a[k], len(args[0])) for k in names[:7]], slips, *[np.broadcast_to(a[k], len(args[0])) for k in names[7:]], nu)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in moved.T], ["e", "n", "u"])

    args = [F.col(columns[k]).cast("double") for k in given]
    return df.withColumn("_g", kernel(*args)).select(*df.columns, F.col("_g.e").alias("green_e"), F.col("_g.n").alias("green_n"), F.col("_g.u").alias("green_u"))


def parameter_grid(spark: SparkSession, axes: Mapping[str, Sequence[float]]) -> DataFrame:
    """The cartesian product of the axes with grid_id, in the order of nested loops; generated on executors."""
    sizes = [len(v) for v in axes.values()]
    out = spark.range(math.prod(sizes)).withColumnRenamed("id", "grid_id")
    step = math.prod(sizes)
    for name, values in axes.items():
        step //= len(values)
        place = F.pmod(F.floor(F.col("grid_id") / step), F.lit(len(values))).cast("int")
        out = out.withColumn(name, F.get(F.array(*map(F.lit, map(float, values))), place))
    return out


def expand_grid(stations: DataFrame, grid: DataFrame) -> DataFrame:
    """Every grid point with every station of a profile. The grid is dealt to all cores first: its file may be one split."""
    return grid.repartition(grid.sparkSession.sparkContext.defaultParallelism).crossJoin(stations)


def score_grid(expanded: DataFrame, by: Sequence[str], g: str = "green_n", d: str = "d", err: str = "err", sums: bool = False) -> DataFrame:
    """by with slip, chi2, rchi2 and wrms of the weighted one-parameter fit d = g * slip; slip 0 where g vanishes.

    One pass: chi2 = sum(d^2/s^2) - 2 slip sum(gd/s^2) + slip^2 sum(g^2/s^2), which is right to about 1e-15 of the first sum:
    for fits that leave less than a millionth of it, use residual_chi2. sums: with _dd, the first sum, for near_best.
    """
    w = 1 / (F.col(err) * F.col(err))
    own = expanded.groupBy(*by).agg(F.sum(w * F.col(g) * F.col(g)).alias("gg"), F.sum(w * F.col(g) * F.col(d)).alias("gd"), F.sum(w * F.col(d) * F.col(d)).alias("dd"), F.sum(w).alias("ww"), F.count("*").alias("n"))
    slip = F.coalesce(F.try_divide("gd", "gg"), F.lit(0.0))
    own = own.withColumn("slip", slip).withColumn("chi2", F.greatest(F.col("dd") - 2 * F.col("slip") * F.col("gd") + F.col("slip") ** 2 * F.col("gg"), F.lit(0.0)))
    scored = own.withColumn("rchi2", F.col("chi2") / F.col("n")).withColumn("wrms", F.sqrt(F.col("chi2") / F.col("ww"))).withColumn("_dd", F.col("dd")).drop("gg", "gd", "dd", "ww", "n")
    return scored if sums else scored.drop("_dd")


def score_models(profile: DataFrame, grid: DataFrame, by: Sequence[str], shape: Sequence[str], green: Callable[[DataFrame], DataFrame], g: str = "green_n", err: str = "err") -> DataFrame:
    """by with slip, chi2, rchi2 and wrms, as score_grid has them of expand_grid and back_slip, for a kernel that depends on shape and dist_km alone.

    profile: dist_km, v_across, err; grid: by, with shape and rate among them, equal rows counting once; green adds the column g
    to rows of shape and dist_km. Grid points of equal shape share their sums, and stations at equal distances act through the
    sums of their weights: the kernel has a row for each different shape and distance, and none for a rate, and each grid point then meets its sums. Where all
    shapes and distances differ, that is the product of grid and profile.
    """
    w, v = 1 / (F.col(err) * F.col(err)), F.col("v_across")
    sums = {"ww": w, "wo": F.when(v.isNotNull(), w), "wv": w * v, "wvv": w * v * v}
    sites = profile.groupBy("dist_km").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"_{k}") for k, x in sums.items()], F.count("*").alias("_n"))
    sites = staged(sites, "profile-sums")
    far = F.col("dist_km") >= 0
    kernel = green(expand_grid(sites, grid.select(*shape).distinct()))
    side = lambda k: [F.sum(F.when(far, F.col(g) * F.col(k))).alias(f"far{k}"), F.sum(F.when(~far, F.col(g) * F.col(k))).alias(f"near{k}")]
    own = staged(kernel.groupBy(*shape).agg(F.sum(F.col(g) * F.col(g) * F.col("_ww")).alias("gg"), *side("_wv"), *side("_wo")), "kernel-sums")
    total = sites.agg(F.sum("_ww").alias("ww"), F.sum("_n").alias("n"), F.sum(F.when(~far, F.col("_wvv"))).alias("near_vv"), F.sum(F.when(far, F.col("_wvv"))).alias("far_wvv"), F.sum(F.when(far, F.col("_wv"))).alias("v_far"), F.sum(F.when(far, F.col("_wo"))).alias("o_far"))
    points = grid.select(*by).distinct().alias("p")
    met = points.join(own.alias("o"), [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in shape]).select("p.*", *[F.col(f"o.{c}") for c in own.columns if c not in shape]).crossJoin(F.broadcast(total))  # one row
    rate, zero = F.col("rate"), F.lit(0.0)
    both = lambda near, beyond: F.coalesce(near, zero) + F.coalesce(beyond, zero)
    gd = both(F.col("near_wv"), F.col("far_wv") - rate * F.col("far_wo"))
    dd = both(F.col("near_vv"), F.col("far_wvv") - 2 * rate * F.col("v_far") + rate * rate * F.col("o_far"))
    met = met.withColumns({"gd": gd, "dd": dd}).withColumn("slip", F.coalesce(F.try_divide("gd", "gg"), zero))
    met = met.withColumn("chi2", F.greatest(F.col("dd") - 2 * F.col("slip") * F.col("gd") + F.col("slip") ** 2 * F.col("gg"), zero))
    return met.select(*by, "slip", "chi2", (F.col("chi2") / F.col("n")).alias("rchi2"), F.sqrt(F.col("chi2") / F.col("ww")).alias("wrms"))


def near_best(scored: DataFrame, by: Sequence[str] = (), slack: float = 1e-9) -> DataFrame:
    """The plausible rows of score_grid that may be the best by wrms: within what cancellation can take from chi2, slack of the first sum (scored has it as _dd)."""
    rows = plausible_models(scored)
    least = rows.groupBy(*by).agg(F.min(F.col("chi2") + slack * F.col("_dd")).alias("_least"))
    joined = rows.join(least, list(by)) if by else rows.crossJoin(F.broadcast(least))  # one row
    return joined.filter(F.col("chi2") - slack * F.col("_dd") <= F.col("_least")).drop("_least", "_dd")


def residual_chi2(expanded: DataFrame, scored: DataFrame, by: Sequence[str], g: str = "green_n", d: str = "d", err: str = "err") -> DataFrame:
    """scored with chi2, rchi2 and wrms summed anew from the residuals d - g * slip, in a second pass over expanded."""
    own = expanded.join(scored.select(*by, "slip"), list(by)).withColumn("_r", (F.col(d) - F.col(g) * F.col("slip")) / F.col(err))
    sums = own.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r")).alias("chi2"), F.sum(1 / (F.col(err) * F.col(err))).alias("_w"), F.count("*").alias("_n"))
    sums = sums.withColumn("rchi2", F.col("chi2") / F.col("_n")).withColumn("wrms", F.sqrt(F.col("chi2") / F.col("_w"))).drop("_w", "_n")
    return scored.drop("chi2", "rchi2", "wrms").join(sums, list(by)).select(scored.columns)


def plausible_models(df: DataFrame, max_rchi2: float | None = None) -> DataFrame:
    """Slip at most the block rate; with max_rchi2 also slip from 0 and a smaller reduced chi-square."""
    rows = df.filter(F.col("slip") <= F.col("rate"))
    return rows if max_rchi2 is None else rows.filter((F.col("slip") >= 0) & (F.col("rchi2") < max_rchi2))


def best_by_wrms(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The plausible models of smallest wrms, ties included."""
    rows = plausible_models(scored)
    least = rows.groupBy(*by).agg(F.min("wrms").alias("_least"))
    joined = rows.join(least, list(by)) if by else rows.crossJoin(F.broadcast(least))  # one row
    return joined.filter(F.col("wrms") == F.col("_least")).drop("_least")


def best_by_rchi(scored: DataFrame, by: Sequence[str] = (), order: str = "grid_id") -> DataFrame:
    """The one plausible model whose reduced chi-square is nearest to 1; ties by grid order."""
    rows = plausible_models(scored)
    best = F.min_by(F.struct(*rows.columns), F.struct(F.abs(F.col("rchi2") - 1), F.col(order))).alias("b")
    return rows.groupBy(*by).agg(best).select("b.*") if by else rows.agg(best).filter("b is not null").select("b.*")


def draw_rows(n: DataFrame, n_draws: int, size: int | None, seed: int = 1) -> DataFrame:
    """(draw, place, row): row numbers from 0 drawn with replacement, md5(seed:draw:place) modulo the count in n (one row, _size), so that draws repeat. size None: as many as n counts."""
    spark = n.sparkSession
    if size is None:
        counted = spark.range(n_draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n))  # one row
        draws = counted.filter("_size > 0").select(F.col("draw").cast("int").alias("draw"), "_size", F.explode(F.sequence(F.lit(0), F.col("_size").cast("int") - 1)).alias("place"))
    else:
        placed = spark.range(n_draws * size).select(F.floor(F.col("id") / size).cast("int").alias("draw"), (F.col("id") % size).cast("int").alias("place"))
        draws = placed.crossJoin(F.broadcast(n))  # one row
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "place").cast("binary")), 1, 8), 16, 10).cast("long")
    return draws.select("draw", "place", (key % F.col("_size")).alias("row"))


def bootstrap(df: DataFrame, n_draws: int, size: int | None, seed: int = 1, order: str = "sites") -> DataFrame:
    """(draw, place, row of df) with replacement; see draw_rows."""
    numbered = number_rows(df, (order,), "_row").withColumn("_row", F.col("_row") - 1)
    picked = draw_rows(numbered.agg(F.count("*").alias("_size")), n_draws, size, seed).withColumnRenamed("row", "_row")
    return picked.join(numbered, "_row").drop("_row")


def with_reference(draws: DataFrame, ref: DataFrame) -> DataFrame:
    """Each draw with the reference rows added at place -1. Spark decides by the sizes how the draws' numbers meet ref."""
    own = draws.select("draw").distinct().crossJoin(ref).withColumn("place", F.lit(-1))
    return draws.unionByName(own, allowMissingColumns=True)


def confidence_bounds(best: DataFrame, cols: Sequence[str], low: float = 0.16, high: float = 0.84) -> DataFrame:
    """(parameter, low, high): exact interpolated percentiles of each parameter."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("value")) for c in cols]))
    rows = best.select(pairs.alias("p")).select("p.*")
    return rows.groupBy("parameter").agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n) of equal bins from the smallest to the largest value; empty bins are left out."""
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    rows = df.select(F.col(col).cast("double").alias("v")).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = rows.filter("v is not null").groupBy(place.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def moment(patches: DataFrame) -> DataFrame:
    """One row: seismic moment in dyne-cm, 3e23 * sum(length * width * slip) / 1000, and magnitude 2/3 log10(M0) - 10.7."""
    return patches.agg((3e23 * F.sum(F.col("length") * F.col("width") * F.col("slip")) / 1000).alias("m0")).withColumn("mw", 2 / 3 * F.log10("m0") - 10.7)


def patch_vectors(patches: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """(row, lon, lat, slip_east, slip_north): centroid of the four corners (km) and surface slip vector of each patch."""
    cx, cy = (sum((F.col(f"{a}{i}") for i in (2, 3, 4)), F.col(f"{a}1")) / 4 for a in "xy")
    lon, lat = km_to_degrees(cx, cy, F.lit(lon0), F.lit(lat0))
    flat = F.col("slip_dip") * F.cos(F.radians("dip"))
    bearing = F.radians(F.col("strike") - 90) + F.when((F.col("slip_strike") == 0) & (F.col("slip_dip") == 0), 0.0).otherwise(F.atan2(F.col("slip_strike"), flat))
    size = F.hypot(F.col("slip_strike"), flat)
    return patches.select("row", lon.alias("lon"), lat.alias("lat"), (size * F.sin(bearing)).alias("slip_east"), (size * F.cos(bearing)).alias("slip_north"))


def patches(fault: DataFrame, i: int, j: int) -> DataFrame:
    """fault (length, width, depth, dip, strike, east, north) cut into i by j patches along strike and dip, with patch_i and patch_j.

    1 by 1 is the fault itself; (east, north) and depth are those of the middle of each patch's lower edge.
    """
    cut = fault.withColumn("patch_i", F.explode(F.sequence(F.lit(1), F.lit(i)))).withColumn("patch_j", F.explode(F.sequence(F.lit(1), F.lit(j))))
    sd, cd, turn = F.sin(F.radians("dip")), F.cos(F.radians("dip")), F.radians("strike")
    step_w, step_l = F.col("width") / j, F.col("length") / i
    up = F.col("width") - step_w * F.col("patch_j")
    across, along = -cd * up, step_l * F.col("patch_i") - (F.col("length") + step_l) / 2
    return cut.withColumns({"length": step_l, "width": step_w, "depth": F.col("depth") - sd * up, "east": F.col("east") + across * F.cos(turn) + along * F.sin(turn), "north": F.col("north") - across * F.sin(turn) + along * F.cos(turn)})


def clip_bbox(points: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """Points strictly inside a box; segments keep their ids."""
    return points.filter((F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north))


def zip_rows(frames: Sequence[DataFrame], key: str = "row") -> DataFrame:
    """Frames with row numbers side by side."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, key)
    return out
