"""Live telemetry: event time, rollups, dedupe, alerts, and the station state machine with state between batches."""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geostream.operators.telemetry import HIGH, IDENTICAL, LOW, TO_MANUAL, TO_MANUAL_SUSPECT, TO_RECEIVER, rollup
from geostream.sources.telemetry import parse_ldm, parse_lvm, route_sentences

OUTPUT = "station_code string, kind string, time timestamp, east double, north double, up double, horizontal double, source string, peak_velocity double, peak_displacement double, duration double, seq long"
_STATE = "mode string, bad int, good int, suspect int, frozen boolean, e double, n double, u double, last long, ve double, vn double, open boolean, start long, peak_v double, peak_d double, seq long"
_HELD = "micros long, kind string, east double, north double, up double, overall_completeness double, file_name string, file_path string, line_no long"


def with_event_time(df: DataFrame, delay: str = "10 minutes", time: str = "time") -> DataFrame:
    """Watermark on a timestamp column, for rollups and dedupe. The station machine has a clock for each station instead; see StationProcessor."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def dedupe_stream(df: DataFrame, keys: tuple[str, ...] = ("time", "station_code")) -> DataFrame:
    """Replayed rows are dropped as long as the watermark keeps their keys."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def stream_rollup(df: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    return rollup(with_event_time(df, delay), width)


def parse_stream(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of both kinds for process_station_stream, rejects with reason) of a stream of sentences.

    Both kinds are parsed in one pass over the stream, so that a station's rows keep their order of arrival.
    """
    routed = route_sentences(lines)
    lvm, bad_v = parse_lvm(routed.filter("kind = 'LVM'"))
    ldm, bad_d = parse_ldm(routed.filter("kind = 'LDM'"))
    station = F.substring_index("file_name", "_", 1).alias("station_code")
    keys = ["file_path", "file_name", "line_no", "kind", "time"]
    velocities = lvm.select(station, *keys, F.col("vE").alias("east"), F.col("vN").alias("north"), F.col("vU").alias("up"), F.lit(1.0).alias("overall_completeness"))
    displacements = ldm.select(station, *keys, F.col("dE").alias("east"), F.col("dN").alias("north"), F.col("dU").alias("up"), "overall_completeness")
    return velocities.unionByName(displacements), bad_v.unionByName(bad_d)


def rejects_stream(parsed_rejects: DataFrame) -> DataFrame:
    """Counts of rejected sentences by reason, for a query of its own."""
    return parsed_rejects.groupBy("reason").count()


class _Alert(StatefulProcessor):
    """Firing state of a station: whether the window before was in breach. A timer ends a breach when no window follows it."""

    def __init__(self, width: float = 10.0, silence_ms: int | None = None):
        self.width, self.silence_ms = width, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "bucket timestamp, breach boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("bucket")
        bucket, breach = self.before.get() if self.before.exists() else (None, False)
        out = []
        for row in frame.itertuples():
            held = breach and bucket is not None and (pd.Timestamp(row.bucket) - pd.Timestamp(bucket)).total_seconds() == self.width
            out.append((key[0], row.bucket, row.mean_v, bool(row.breach), bool(row.breach and held)))
            bucket, breach = row.bucket, bool(row.breach)
        self.before.update((pd.Timestamp(bucket).to_pydatetime(), breach))
        if self.silence_ms is not None:
            _set_timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.silence_ms if breach else None)
        yield pd.DataFrame(out, columns=_ALERT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bucket, breach = self.before.get() if self.before.exists() else (None, False)
        if breach:
            self.before.clear()
            yield pd.DataFrame([(key[0], pd.Timestamp(bucket) + pd.Timedelta(seconds=self.width), None, False, False)], columns=_ALERT)

    def close(self) -> None:
        pass


_ALERT = ["station_code", "bucket", "mean_v", "breach", "firing"]


def _set_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The station's one timer, in place of any other."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


def alert_stream(means: DataFrame, width: float = 10.0, silence: float | None = None) -> DataFrame:
    """station_code, bucket, mean_v, breach, firing from a stream of 10-second means (operators.telemetry.alert_means in append mode).

    silence: after so many seconds of the clock without a window, a station in breach gets a row without a mean that
    ends it, for the window that is missing; None: nothing but rows changes a state.
    """
    schema = "station_code string, bucket timestamp, mean_v double, breach boolean, firing boolean"
    processor = _Alert(width, None if silence is None else round(silence * 1000))
    return means.groupBy("station_code").transformWithStateInPandas(processor, schema, "Append", "None" if silence is None else "ProcessingTime")


class StationProcessor(StatefulProcessor):
    """The integrator, receiver mode and open event of one station.

    Rows may carry mm_s and decay of their station, which go before the given ones. Without further options rows are taken in
    order of arrival (file_name, file_path, line_no) and all of them. A batch holds what its trigger admits
    (files_per_trigger); history of any length belongs to the batch form in plans.jobs.telemetry_backfill.

    remember: seconds back from a station's latest time in which a second row of the same kind and time is a replay and
    does nothing; older rows are given out as late (kind late, source their own kind) and do nothing either.
    reorder: seconds for which rows wait in a buffer. Those that are older than the station's latest time by so much are
    released in order of time (velocities before displacements of the same time); a row that comes after its time was
    released is late. idle_ms: when no row of the station has come for so long, by the clock, the buffer is released whole.
    ttl_ms: a station that is silent for so long is forgotten. The clock is each station's own: a receiver whose time runs
    ahead doesn't make the rows of others late, and late rows reach the output, which a watermark would drop.
    """

    def __init__(self, mm_s: float = 15.0, decay: float = 1.0, max_gap: float = 5.0, least: float = 0.5, remember: float | None = None, reorder: float | None = None, idle_ms: int | None = None, ttl_ms: int | None = None):
        self.mm_s, self.decay, self.max_gap, self.least = mm_s, decay, max_gap, least
        self.remember, self.reorder, self.idle_ms, self.ttl_ms = remember, reorder, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {} if self.ttl_ms is None else {"ttlDurationMs": self.ttl_ms}
        self.state = handle.getValueState("station", _STATE, **ttl)
        self.clock = handle.getValueState("clock", "top long, released long, mm_s double, decay double, seen binary", **ttl)
        self.held = handle.getListState("held", _HELD, **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        frame = frame.sort_values([c for c in ("file_name", "file_path", "line_no") if c in frame.columns])
        own = {c: frame[c].iloc[0] for c in ("mm_s", "decay") if c in frame.columns}
        self.now_mm_s, self.now_decay = float(own.get("mm_s", self.mm_s)), float(own.get("decay", self.decay))
        out: list[tuple] = []
        s = self._start()
        if self.remember is None and self.reorder is None:
            for r in frame.itertuples():
                self._step(s, key[0], r, r.time, out)
        else:
            self._admit(s, key[0], frame, out)
            if self.idle_ms is not None:
                _set_timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._finish(s, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.clock.exists() and self.held.exists():
            top, _, self.now_mm_s, self.now_decay, seen = self.clock.get()
            s, out = self._start(), []
            self._release(s, key[0], self._buffered(), top, out)
            self.held.clear()
            self.clock.update((top, top, self.now_mm_s, self.now_decay, seen))
            yield self._finish(s, out)

    def _start(self) -> dict:
        names = [x.split()[0] for x in _STATE.split(", ")]
        return dict(zip(names, self.state.get() if self.state.exists() else ("RECEIVER", 0, 0, 0, False, 0.0, 0.0, 0.0, None, None, None, False, None, 0.0, 0.0, 0)))

    def _finish(self, s: dict, out: list[tuple]) -> pd.DataFrame:
        out = [(*row, s["seq"] + i) for i, row in enumerate(out)]
        s["seq"] += len(out)
        self.state.update(tuple(s.values()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def _buffered(self) -> pd.DataFrame:
        names = [x.split()[0] for x in _HELD.split(", ")]
        return pd.DataFrame([tuple(r) for r in self.held.get()] if self.held.exists() else [], columns=names)

    def _admit(self, s: dict, station: str, frame: pd.DataFrame, out: list[tuple]) -> None:
        """Take the rows of a batch that are neither replays nor late, now or from the buffer, in order."""
        top, released, seen = None, None, np.zeros(0, np.int64)
        if self.clock.exists():
            top, released, _, _, data = self.clock.get()
            seen = np.frombuffer(bytes(data), "<i8")
        frame = frame.assign(micros=pd.to_datetime(frame["time"]).astype("datetime64[us]").astype("int64"))
        frame = frame.assign(file_name=frame["file_name"] if "file_name" in frame else "", file_path=frame["file_path"] if "file_path" in frame else "")
        own = frame["micros"].to_numpy() * 2 + (frame["kind"] == "LDM").to_numpy()
        first = np.zeros(len(frame), bool)
        first[np.unique(own, return_index=True)[1]] = True
        fresh = first & ~np.isin(own, seen)
        back = int(max(self.remember or 0.0, self.reorder or 0.0) * 1e6)
        edge = released if self.reorder is not None else None if top is None else top - back
        late = fresh & (frame["micros"].to_numpy() <= edge if edge is not None else np.zeros(len(frame), bool))
        out += [(station, "late", r.time, r.east, r.north, r.up, None, r.kind, None, None, None) for r in frame[late].itertuples()]
        good = frame[fresh & ~late]
        top = int(max([x for x in (top, good["micros"].max() if len(good) else None) if x is not None], default=edge or 0))
        seen = np.concatenate([seen, own[fresh]])
        seen = seen[seen // 2 >= top - back]
        if self.reorder is None:
            for r in good.itertuples():
                self._step(s, station, r, r.time, out)
        else:
            released = max([x for x in (released, top - int(self.reorder * 1e6)) if x is not None])
            both = [x for x in (self._buffered(), good[[x.split()[0] for x in _HELD.split(", ")]]) if len(x)]
            waiting = self._release(s, station, pd.concat(both), released, out) if both else []
            self.held.clear()
            if waiting:
                self.held.put(waiting)
        self.clock.update((top, released, self.now_mm_s, self.now_decay, seen.astype("<i8").tobytes()))

    def _release(self, s: dict, station: str, rows: pd.DataFrame, until: int, out: list[tuple]) -> list[tuple]:
        """Step through the rows up to a time; the others are returned."""
        rows = rows.assign(_second=rows["kind"] == "LDM").sort_values(["micros", "_second", "file_name", "file_path", "line_no"]).drop(columns="_second")
        ready = rows["micros"] <= until
        for r in rows[ready].itertuples():
            self._step(s, station, r, pd.Timestamp(r.micros, unit="us"), out)
        return [(int(m), k, *map(float, values), f, p, int(n)) for m, k, *values, f, p, n in rows[~ready].itertuples(index=False)]

    def _step(self, s: dict, station: str, r, time, out: list[tuple]) -> None:
        (self._velocity if r.kind == "LVM" else self._displacement)(s, station, r, pd.Timestamp(time), out)

    def _velocity(self, s: dict, station: str, r, time: pd.Timestamp, out: list[tuple]) -> None:
        t = time.value // 1000  # value is in nanoseconds, whatever the unit
        s["ve"], s["vn"] = r.east, r.north
        v = hypot(r.east, r.north)
        out.append((station, "velocity", time, r.east, r.north, r.up, v, None, None, None, None))
        if v * 1000 > self.now_mm_s:
            if not s["open"]:
                s["open"], s["start"], s["peak_v"], s["peak_d"] = True, t, 0.0, 0.0
            s["peak_v"] = max(s["peak_v"], v * 1000)
        elif s["open"]:
            out.append((station, "event", pd.Timestamp(s["start"], unit="us"), None, None, None, None, None, s["peak_v"], s["peak_d"], (t - s["start"]) / 1e6))
            s["open"] = False
        dt = None if s["last"] is None else (t - s["last"]) / 1e6
        if dt is not None and 0 < dt < self.max_gap and not s["frozen"]:
            for axis, value in zip("enu", (r.east, r.north, r.up)):
                s[axis] = s[axis] * self.now_decay + value * dt
        s["last"] = t

    def _displacement(self, s: dict, station: str, r, time: pd.Timestamp, out: list[tuple]) -> None:
        if not r.overall_completeness >= self.least:
            return
        signal = None
        if s["ve"] is not None:
            same = abs(s["ve"] - r.east) < 1e-9 and abs(s["vn"] - r.north) < 1e-9
            signal = IDENTICAL if same else HIGH if hypot(s["ve"], s["vn"]) * 1000 >= self.now_mm_s else LOW
            counts = {IDENTICAL: "bad", HIGH: "good", LOW: "suspect"}
            for kind, name in counts.items():
                s[name] = s[name] + 1 if kind == signal else 0
            if s["bad"] >= TO_MANUAL or s["suspect"] >= TO_MANUAL_SUSPECT:
                s["mode"] = "MANUAL"
            elif s["good"] >= TO_RECEIVER:
                s["mode"] = "RECEIVER"
            s["frozen"] = s["mode"] == "MANUAL" and signal == LOW
        manual = s["mode"] == "MANUAL"
        e, n, u = (s["e"], s["n"], s["u"]) if manual else (r.east, r.north, r.up)
        d = hypot(e, n)
        if s["open"]:
            s["peak_d"] = max(s["peak_d"], d * 1000)
        out.append((station, "displacement", time, e, n, u, d, "INTEGRATOR" if manual else "RECEIVER_SUSPECT" if signal == LOW else "RECEIVER", None, None, None))

    def close(self) -> None:
        pass


def process_station_stream(rows: DataFrame, **params) -> DataFrame:
    """Velocities, displacements and events (kind) of a stream of rows station_code, file_name, line_no, kind (LVM or LDM),
    time, east, north, up, overall_completeness, with file_path, mm_s and decay if there are. params: see StationProcessor; its
    late rows have kind late. seq numbers a station's output. Needs the RocksDB state store."""
    timed = params.get("idle_ms") is not None or params.get("ttl_ms") is not None
    return rows.groupBy("station_code").transformWithStateInPandas(StationProcessor(**params), OUTPUT, "Append", "ProcessingTime" if timed else "None")


def backfill(rows: DataFrame, path: str, checkpoint: str, **params) -> None:
    """Run the same logic over all that is there, then stop."""
    query = process_station_stream(rows, **params).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
