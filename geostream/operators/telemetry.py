"""Velocity and displacement telemetry: gating, integration, receiver modes, events, rollups, alerts.

Windows run over each station's rows in arrival order; their running frames need constant memory however long a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL = ("file_name", "line_no")
IDENTICAL, HIGH, LOW = "IDENTICAL", "HIGH_VEL_NEQ", "LOW_VEL_NEQ"
#: Rows of one class in a run that switch the receiver mode.
TO_MANUAL, TO_MANUAL_SUSPECT, TO_RECEIVER = 5, 3, 30


def with_magnitude(df: DataFrame, e: str, n: str, u: str | None = None, name: str = "magnitude") -> DataFrame:
    """Horizontal magnitude, or that of three components."""
    return df.withColumn(name, F.hypot(e, n) if u is None else F.sqrt(F.col(e) ** 2 + F.col(n) ** 2 + F.col(u) ** 2))


def scale_columns(df: DataFrame, factor: float, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in cols})


def filter_complete(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Displacements of sufficient completeness; before anything that keeps state."""
    return df.filter(F.col("overall_completeness") >= least)


def with_config(df: DataFrame, stations: DataFrame, mm_s: float = 15.0, decay: float = 1.0) -> DataFrame:
    """df with mm_s and decay of its station (see sources.telemetry.read_stations); the given ones where a station has none.

    A filter that isn't enabled doesn't decay.
    """
    own = stations.select("station_code", F.col("threshold_mm_s").alias("mm_s"), F.when(F.col("filter.enabled"), F.col("filter.decay")).when(F.col("filter.enabled") == False, F.lit(1.0)).alias("decay"))  # noqa: E712
    joined = df.join(own.dropDuplicates(["station_code"]), "station_code", "left")
    return joined.withColumn("mm_s", F.coalesce("mm_s", F.lit(float(mm_s)))).withColumn("decay", F.coalesce("decay", F.lit(float(decay))))


def _given(value: float | str | Column) -> Column:
    """A number, or a column by its name."""
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


def over_threshold(value: Column, mm_s: float | str | Column = 15.0) -> Column:
    """Events need more than the threshold, a number or a column."""
    return value > _given(mm_s)


def series_window(df: DataFrame, station: str, t0: str, t1: str, cols: Sequence[str] = (), factor: float = 1000.0) -> DataFrame:
    """One station's rows from t0 to t1 in time order, cols scaled (metres to mm)."""
    rows = df.filter((F.col("station_code") == station) & F.col("time").between(F.lit(t0).cast("timestamp"), F.lit(t1).cast("timestamp")))
    return scale_columns(rows, factor, cols).orderBy("time")


def merge_streams(velocities: DataFrame, displacements: DataFrame) -> DataFrame:
    """Both kinds of rows in one table with kind LVM or LDM; arrival order is theirs."""
    return velocities.withColumn("kind", F.lit("LVM")).unionByName(displacements.withColumn("kind", F.lit("LDM")), allowMissingColumns=True)


def _order(order: Sequence[str], by: str = "station_code"):
    return Window.partitionBy(by).orderBy(*order)


def asof_last(left: DataFrame, right: DataFrame, cols: Sequence[str], by: str = "station_code", order: Sequence[str] = ARRIVAL) -> DataFrame:
    """left with the last preceding non-null cols of right, by arrival order of the same key; no tolerance."""
    both = left.withColumn("_left", F.lit(True)).unionByName(right.select(by, *order, *cols).withColumn("_left", F.lit(False)), allowMissingColumns=True)
    before = _order([*order, "_left"], by).rowsBetween(Window.unboundedPreceding, -1)
    filled = both.withColumns({c: F.last(F.when(~F.col("_left"), F.col(c)), ignorenulls=True).over(before) for c in cols})
    return filled.filter("_left").drop("_left")


def classify_signal(df: DataFrame, mm_s: float | str | Column = 15.0) -> DataFrame:
    """df (dE, dN and the last velocity's vE, vN) with signal; null without a velocity."""
    same = (F.abs(F.col("vE") - F.col("dE")) < 1e-9) & (F.abs(F.col("vN") - F.col("dN")) < 1e-9)
    return df.withColumn("signal", F.when(F.col("vE").isNull(), None).when(same, IDENTICAL).when(F.hypot("vE", "vN") * 1000 >= _given(mm_s), HIGH).otherwise(LOW))


def with_dt(df: DataFrame, max_gap: float = 5.0, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Velocity rows with dt, seconds since the station's previous one, and gate, 0 < dt < max_gap."""
    dt = (F.unix_micros(F.col("time").cast("timestamp")) - F.lag(F.unix_micros(F.col("time").cast("timestamp"))).over(_order(order))) / 1e6
    return df.withColumn("dt", dt).withColumn("gate", F.coalesce((F.col("dt") > 0) & (F.col("dt") < max_gap), F.lit(False)))


def receiver_mode(df: DataFrame, order: Sequence[str] = ARRIVAL, manual: bool = False) -> DataFrame:
    """Displacement rows with signal -> with mode (RECEIVER or MANUAL) and frozen after each row.

    A run of one class resets the counts of the others, so that a row switches the mode exactly if its run has come to
    the class's length: 5 identical or 3 low to MANUAL, 30 high to RECEIVER. Integration is frozen in MANUAL behind a low row.
    """
    rows = df.withColumn("_new", F.coalesce(F.col("signal") != F.lag("signal").over(_order(order)), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(_order(order)))
    rows = rows.withColumn("_length", F.row_number().over(Window.partitionBy("station_code", "_run").orderBy(*order)))
    switch = F.when((F.col("signal") == IDENTICAL) & (F.col("_length") >= TO_MANUAL), "MANUAL").when((F.col("signal") == LOW) & (F.col("_length") >= TO_MANUAL_SUSPECT), "MANUAL").when((F.col("signal") == HIGH) & (F.col("_length") >= TO_RECEIVER), "RECEIVER")
    mode = F.coalesce(F.last(switch, ignorenulls=True).over(_order(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit("MANUAL" if manual else "RECEIVER"))
    return rows.withColumn("mode", mode).withColumn("frozen", F.coalesce((F.col("mode") == "MANUAL") & (F.col("signal") == LOW), F.lit(False))).drop("_new", "_run", "_length")


def integrate(df: DataFrame, decay: float | str = 1.0, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Velocity rows (gate, frozen, dt, vE, vN, vU) with iE, iN, iU, the leaky integral after each row.

    d <- d * decay + v * dt where the gate is open and nothing is frozen. decay, a number or a column that is the same in all
    rows of a station, is above 0 and at most 1. Written as a sum over the open rows, weighted by
    decay to the number of open rows since; blocks of rows keep the powers in range, and what lies two blocks back weighs
    less than 1e-150.
    """
    frozen = F.coalesce("frozen", F.lit(False)) if "frozen" in df.columns else F.lit(False)
    rows = df.withColumn("_open", (F.col("gate") & ~frozen).cast("int"))
    rows = rows.withColumn("_count", F.sum("_open").over(_order(order)))
    steps = {a: F.when(F.col("_open") == 1, F.col(f"v{a}") * F.col("dt")).otherwise(0.0) for a in "ENU"}
    if decay == 1.0:
        return rows.withColumns({f"i{a}": F.sum(x).over(_order(order).rowsBetween(Window.unboundedPreceding, 0)) for a, x in steps.items()}).drop("_open", "_count")
    kept = _given(decay)
    block = F.when(kept < 1, F.greatest(F.floor(F.lit(150 * math.log(10)) / -F.log(kept)), F.lit(1))).otherwise(F.lit(1 << 62)).cast("long")
    rows = rows.withColumn("_block", F.floor(F.col("_count") / block)).withColumn("_place", F.col("_count") % block)
    inside = Window.partitionBy("station_code", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = F.pow(kept, F.col("_place"))
    rows = rows.withColumns({f"_own{a}": down * F.sum(x / down).over(inside) for a, x in steps.items()})
    ends = rows.groupBy("station_code", (F.col("_block") + 1).alias("_block")).agg(*[F.max_by(f"_own{a}", F.struct("_place", *order)).alias(f"_end{a}") for a in "ENU"])
    rows = rows.join(ends, ["station_code", "_block"], "left")
    carried = {f"i{a}": F.col(f"_own{a}") + F.coalesce(F.col(f"_end{a}"), F.lit(0.0)) * down * kept for a in "ENU"}
    return rows.withColumns(carried).drop("_open", "_count", "_block", "_place", *[f"_{x}{a}" for x in ("own", "end") for a in "ENU"])


def label_displacement(df: DataFrame) -> DataFrame:
    """Displacement rows (mode, signal, iE, iN, iU) with components replaced in MANUAL, and displacement_source."""
    manual = F.col("mode") == "MANUAL"
    label = F.when(manual, "INTEGRATOR").when(F.col("signal") == LOW, "RECEIVER_SUSPECT").otherwise("RECEIVER")
    return df.withColumn("displacement_source", label).withColumns({f"d{a}": F.when(manual, F.coalesce(f"i{a}", F.lit(0.0))).otherwise(F.col(f"d{a}")) for a in "ENU"})


def process_telemetry(velocities: DataFrame, displacements: DataFrame, mm_s: float | str = 15.0, decay: float | str = 1.0, max_gap: float = 5.0, manual: bool = False, order: Sequence[str] = ARRIVAL) -> tuple[DataFrame, DataFrame]:
    """(velocities, displacements) as the station state machine leaves them, from parsed rows with station_code.

    mm_s and decay: numbers, or names of columns of both (see with_config). Displacements learn the last velocity, their signal and the mode; velocities learn from the last displacement whether
    integration is frozen; displacements then take the last integral.
    """
    marked = receiver_mode(classify_signal(asof_last(filter_complete(displacements), velocities, ("vE", "vN"), order=order), mm_s), order, manual)
    moved = integrate(with_dt(asof_last(velocities.drop("frozen"), marked, ("frozen",), order=order), max_gap, order), decay, order)
    labelled = label_displacement(asof_last(marked, moved, ("iE", "iN", "iU"), order=order))
    return moved.withColumn("v_horizontal", F.hypot("vE", "vN")), labelled.withColumn("d_horizontal", F.hypot("dE", "dN")).drop("vE", "vN", "iE", "iN", "iU")


def detect_events(velocities: DataFrame, displacements: DataFrame | None = None, mm_s: float | str = 15.0, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """station_code, detection_time, peak_velocity_horizontal, peak_displacement_horizontal (mm/s, mm), duration_seconds.

    A run opens at the first velocity (v_horizontal, m/s) over the threshold and closes at the first that is not;
    displacements (d_horizontal, m) that arrive in between count. A run that is open at the end is not reported.
    """
    rows = velocities.select("station_code", "time", *order, (F.col("v_horizontal") * 1000).alias("v"), F.lit(None).cast("double").alias("d"), _given(mm_s).alias("limit"))
    if displacements is not None:
        rows = rows.union(displacements.select("station_code", "time", *order, F.lit(None).cast("double"), F.col("d_horizontal") * 1000, F.lit(None).cast("double")))
    rows = rows.withColumn("over", F.when(F.col("v").isNotNull(), over_threshold(F.col("v"), "limit")))
    before = F.coalesce(F.last("over", ignorenulls=True).over(_order(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("active", before).withColumn("_start", F.coalesce(F.col("over") & ~F.col("active"), F.lit(False)).cast("int"))
    rows = rows.withColumn("run", F.sum("_start").over(_order(order))).filter(F.coalesce("over", F.lit(False)) | F.col("active"))
    ended = F.max(F.when(~F.col("over"), F.col("time")))
    events = rows.groupBy("station_code", "run").agg(
        F.min_by("time", F.struct(*order)).alias("detection_time"),
        F.max(F.when(F.col("over"), F.col("v"))).alias("peak_velocity_horizontal"),
        F.coalesce(F.max("d"), F.lit(0.0)).alias("peak_displacement_horizontal"),
        ended.alias("ended"),
    )
    micros = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("detection_time").cast("timestamp"))
    return events.filter("ended is not null").withColumn("duration_seconds", micros / 1e6).drop("run", "ended")


def latest_events(events: DataFrame, t0: str, t1: str, n: int = 50) -> DataFrame:
    """The n latest events from t0 to t1, values rounded to 1, 1 and 0 places; ties by station."""
    rows = events.filter(F.col("detection_time").between(F.lit(t0).cast("timestamp"), F.lit(t1).cast("timestamp"))).orderBy(F.desc("detection_time"), "station_code").limit(n)
    return rows.withColumn("peak_velocity_horizontal", F.round("peak_velocity_horizontal", 1)).withColumn("peak_displacement_horizontal", F.round("peak_displacement_horizontal", 1)).withColumn("duration_seconds", F.round("duration_seconds", 0))


def rollup(df: DataFrame, width: str) -> DataFrame:
    """bucket, station_code, v_horizontal_max and averages, sample_count in windows of a width; batch or stream, always from raw rows."""
    grouped = df.groupBy(F.window("time", width).alias("w"), "station_code").agg(F.max("v_horizontal").alias("v_horizontal_max"), *[F.avg(f"v_{c}").alias(f"v_{c}_avg") for c in ("horizontal", "east", "north", "up")], F.count("*").alias("sample_count"))
    return grouped.select(F.col("w.start").alias("bucket"), "station_code", "v_horizontal_max", "v_horizontal_avg", "v_east_avg", "v_north_avg", "v_up_avg", "sample_count")


def refresh_rollup(raw: DataFrame, path: str, width: str, as_of: str, span: str, lag: str) -> DataFrame:
    """Recompute the buckets from as_of - span to as_of - lag of a rollup that is partitioned by day, and write their days."""
    first = F.date_trunc("day", F.lit(as_of).cast("timestamp") - F.expr(f"interval {span}"))
    last = F.lit(as_of).cast("timestamp") - F.expr(f"interval {lag}")
    rows = rollup(raw.filter((F.col("time") >= first) & (F.col("time") < F.date_trunc("day", last) + F.expr("interval 1 day"))), width)
    rows = rows.filter(F.col("bucket") + F.expr(f"interval {width}") <= last).withColumn("bucket_date", F.to_date("bucket"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_date").parquet(path)
    return raw.sparkSession.read.parquet(path)


def alert_means(df: DataFrame, width: str = "10 seconds", limit: float = 0.015) -> DataFrame:
    """bucket, station_code, mean_v and breach of each window; windows without values are left out."""
    means = df.filter("v_horizontal is not null").groupBy(F.window("time", width).alias("w"), "station_code").agg(F.avg("v_horizontal").alias("mean_v"))
    return means.select(F.col("w.start").alias("bucket"), "station_code", "mean_v", (F.col("mean_v") > limit).alias("breach"))


def alert_holds(alerts: DataFrame, width: str = "10 seconds") -> DataFrame:
    """alerts with firing: the breach has lasted through the window before."""
    order = _order(["bucket"])
    held = F.lag("breach").over(order) & (F.lag("bucket").over(order) + F.expr(f"interval {width}") == F.col("bucket"))
    return alerts.withColumn("firing", F.col("breach") & F.coalesce(held, F.lit(False)))


def resolve_dates(df: DataFrame, base_date: str, clock: str = "clock", by: str = "file_name", order: Sequence[str] = ("line_no",)) -> DataFrame:
    """df with time: base_date plus the time of day plus a day for each step back of more than twelve hours."""
    part = F.split(clock, ":")
    seconds = F.get(part, 0).cast("double") * 3600 + F.get(part, 1).cast("double") * 60 + F.get(part, 2).cast("double")
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.withColumn("_s", seconds)
    rows = rows.withColumn("_back", F.coalesce(F.lag("_s").over(w) - F.col("_s") > 43200, F.lit(False)).cast("int"))
    days = F.sum("_back").over(w)
    base = F.unix_micros(F.lit(base_date).cast("timestamp"))
    return rows.withColumn("time", F.timestamp_micros((base + F.round((F.col("_s") + days * 86400) * 1_000_000)).cast("long"))).drop("_s", "_back")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")
