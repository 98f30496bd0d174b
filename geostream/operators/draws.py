"""Bootstrap of a grid search as products of matrices: grid points in blocks, stations and draws in one small matrix.

A draw takes each station of a profile some number of times. With those counts as a matrix C (stations, draws), the sums of
a weighted one-parameter fit are, for a block of grid points with the kernel G (points, stations),

    sum g^2/s^2 = (G^2 / s^2) C     sum g d/s^2 = (G v / s^2) C - rate (G far / s^2) C     sum d^2/s^2, from stations alone,

so that neither a draw nor a rate has a row. A block yields, of each draw, the models that may be the best so far; their slip
and chi-square are summed anew from the residuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostream.operators import faults
from geostream.sources.shared import staged

#: (columns of a block as arrays (n, 1), distances (1, stations)) -> kernel (n, stations)
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]


class Weights(NamedTuple):
    """A profile and how often each draw takes each of its stations."""

    x: np.ndarray
    v: np.ndarray
    err: np.ndarray
    counts: np.ndarray


def draw_counts(n: DataFrame, n_draws: int, size: int | None, seed: int) -> DataFrame:
    """(draw, row, times) of the rows 0, 1, ... of a table that n (one row, _size) counts, as faults.bootstrap draws them; size: rows of a draw, as many as the table has if None."""
    return faults.draw_rows(n, n_draws, size, seed).groupBy("draw", "row").agg(F.count("*").alias("times"))


def weights(profile: DataFrame, ref: DataFrame | None, n_draws: int, size: int | None, seed: int, order: str = "sites", most: int = 1 << 22) -> Weights | None:
    """The profile (sites, dist_km, v_across, err) and its counts by draw, ref in each draw once; None if stations x draws exceed most."""
    columns = ("dist_km", "v_across", "err")
    n, fixed = profile.count(), [] if ref is None else [tuple(r) for r in ref.select(*columns).take(most + 1)]
    if (n + len(fixed)) * n_draws > most or not n:
        return None
    rows = [tuple(r) for r in profile.orderBy(order, *columns).select(*columns).collect()]  # most at most, as what follows
    counts = np.zeros((n + len(fixed), n_draws))
    counts[n:] = 1
    one = profile.sparkSession.range(1).select(F.lit(n).cast("long").alias("_size"))
    for draw, row, times in draw_counts(one, n_draws, size, seed).select("draw", "row", "times").collect():
        counts[row, draw] = times
    x, v, err = np.array(rows + fixed, float).T
    return Weights(x, v, err, counts)


def strike_slip(length: float = 1000.0, turn: float = 180.0) -> Kernel:
    """Horizontal motion along strike 0 by unit strike slip on rectangles (width, depth, dip - turn, east if there is one)."""

    def kernel(columns: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        shape = np.broadcast_shapes(columns["width"].shape, x.shape)
        flat = lambda v: np.broadcast_to(v, shape).ravel()
        zero, one = np.zeros(shape[0] * shape[1]), np.ones(shape[0] * shape[1])
        east = flat(columns["east"]) if "east" in columns else zero
        moved = faults.displacement(one * length, flat(columns["width"]), flat(columns["depth"]), flat(columns["dip"]) - turn, zero, east, zero, (1.0, 0.0, 0.0), flat(x), zero)
        return moved[:, 1].reshape(shape)

    return kernel


def _near_best(g: np.ndarray, w: Weights, rates: Sequence[float], least: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, draws, rate) of a block that may be the best plausible models of their draws; least: the smallest certain chi-square of each draw so far, which falls."""
    inv = 1 / (w.err * w.err)
    far = (w.x >= 0).astype(float)
    gg, gv, gf = (g * g * inv) @ w.counts, (g * (inv * w.v)) @ w.counts, (g * (inv * far)) @ w.counts
    found = []
    for rate in rates:
        d = w.v - rate * far
        dd = (inv * d * d) @ w.counts
        gd = gv - rate * gf
        with np.errstate(divide="ignore", invalid="ignore"):
            slip = np.where(gg > 0, gd / gg, 0.0)
        chi2 = dd - slip * gd
        slack = 1e-11 * (dd + np.abs(slip) * (np.abs(gv) + abs(rate) * np.abs(gf)))  # rounding of the sums
        edge = 1e-9 * (abs(rate) + np.abs(slip)) + 1e-12
        sure, may = slip <= rate - edge, slip <= rate + edge
        np.minimum(least, np.where(sure, chi2 + slack, np.inf).min(axis=0, initial=np.inf), out=least)
        found.append((rate, may, chi2 - slack))
    for rate, may, low in found:
        rows, draws = np.nonzero(may & (low <= least))
        if len(rows):
            yield rows, draws, np.full(len(rows), rate)


def _fit(g: np.ndarray, w: Weights, draws: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """slip, chi2, reduced chi2 and wrms of models with kernels g, by residuals; equal models have equal figures."""
    times = w.counts[:, draws].T
    inv = times / (w.err * w.err)
    d = w.v - rate[:, None] * (w.x >= 0)
    gg, gd = (inv * g * g).sum(1), (inv * g * d).sum(1)
    slip = np.divide(gd, gg, out=np.zeros_like(gd), where=gg > 0)
    off = d - slip[:, None] * g
    chi2 = (inv * off * off).sum(1)
    return slip, chi2, chi2 / times.sum(1), np.sqrt(chi2 / inv.sum(1))


def _search(w: Weights, kernel: Kernel, axes: Sequence[str], rates: Sequence[float], schema: pa.Schema, block: int):
    def run(batches):
        least = np.full(w.counts.shape[1], np.inf)
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                columns = {a: part.column(a).to_numpy(zero_copy_only=False).astype(float)[:, None] for a in axes}
                g = kernel(columns, w.x[None, :])
                for rows, draws, rate in _near_best(g, w, rates, least):
                    for at in range(0, len(rows), block):
                        cut = slice(at, at + block)
                        slip, chi2, rchi2, wrms = _fit(g[rows[cut]], w, draws[cut], rate[cut])
                        out = pa.RecordBatch.from_arrays([pa.array(draws[cut].astype(np.int32)), *[part.column(c).take(pa.array(rows[cut])) for c in ("grid_id", *axes)], *[pa.array(c) for c in (rate[cut], slip, chi2, rchi2, wrms)]], schema=schema)
                        yield out.filter(pa.array(slip <= rate[cut]))

    return run


def best_by_draw(grid: DataFrame, w: Weights, kernel: Kernel, axes: Sequence[str], rates: Sequence[float], block: int = 2048) -> DataFrame:
    """draw, grid_id, axes, rate, slip, chi2, rchi2, wrms: the plausible models (slip <= rate) of least wrms of each draw, ties included.

    grid: grid_id and axes; it is dealt to all cores, its file may be one split. Work is linear in grid points; a task
    holds w and some arrays of block x draws numbers, and only models that are the best of their draw so far leave it.
    """
    own = grid.select(F.col("grid_id").cast("long").alias("grid_id"), *[F.col(a).cast("double").alias(a) for a in axes])
    fields = [("draw", "int"), ("grid_id", "long"), *[(c, "double") for c in (*axes, "rate", "slip", "chi2", "rchi2", "wrms")]]
    schema = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t]) for c, t in fields])
    dealt = own.repartition(grid.sparkSession.sparkContext.defaultParallelism)
    found = staged(dealt.mapInArrow(_search(w, kernel, axes, list(map(float, rates)), schema, block), ", ".join(f"{c} {t}" for c, t in fields)), "draws")
    least = found.groupBy("draw").agg(F.min("wrms").alias("_least"))
    return found.join(least, "draw").filter(F.col("wrms") == F.col("_least")).drop("_least")


def best_by_join(expanded: DataFrame, drawn: DataFrame, axes: Sequence[str], rates: Sequence[float]) -> DataFrame:
    """The same from tables of any size: expanded (grid_id, axes, sites, green_n) joined with drawn (draw, sites, dist_km, v_across, err), a row for each draw and station."""
    rated = faults.back_slip(drawn.withColumn("rate", F.explode(F.array(*map(F.lit, map(float, rates))))), F.col("rate"))
    joined = expanded.join(rated.select("draw", "rate", "sites", "d", "err"), "sites")
    by = ["draw", "grid_id", *axes, "rate"]
    return faults.best_by_wrms(faults.residual_chi2(joined, faults.near_best(faults.score_grid(joined, by, sums=True), ["draw"]), by), ["draw"]).select(*by, "slip", "chi2", "rchi2", "wrms")
