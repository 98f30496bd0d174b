"""End-to-end jobs: ingestion, velocities from daily coordinates, telemetry backfill, bootstrap uncertainty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geostream.operators import draws, faults, network, series, telemetry
from geostream.sources import archive, coordinates, reports
from geostream.sources import sinks as files
from geostream.sources import telemetry as sentences
from geostream.sources.ledger import Ledger, Table, replace_file
from geostream.sources.shared import staged
from geostream.sources.sinks import Sink
from geostream.streaming import telemetry as live


def ingest(spark: SparkSession, root: str, log: DataFrame, stations: DataFrame, qc: DataFrame | None = None, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new catalog rows, failures with error_message, log with an event for each): discovered files that aren't done.

    A file fails without the format's mark in its first ten lines, without a station, or with an unknown one. qc: quality
    figures by file_path (scan_qc_reports with_path of reports that bear the files' paths); catalog: rows that are there.
    Each file is read once, for its header and its hash, into a table that all results share.
    """
    headers = reports.scan_rinex_headers(spark, root, with_hash=True).filter(archive.is_observation_file(F.col("file_name")))
    joined = network.pending_files(staged(headers.withColumnRenamed("file_path", "filepath").withColumnRenamed("file_name", "filename"), "headers"), log)
    found = joined.select("filename", "filepath", "file_hash")
    if qc is not None:
        joined = joined.join(qc.withColumn("filepath", F.regexp_replace("file_path", "^file:/*", "/")).drop("file_path", "file_name"), "filepath", "left")
    marked = F.coalesce("has_marker", F.lit(False))
    good, failed = network.resolve_stations(joined.filter(marked), stations)
    failed = failed.unionByName(joined.filter(~marked).withColumn("error_message", F.lit("no format marker")))
    new = good.dropDuplicates(["file_hash"]) if catalog is None else network.new_catalog_rows(good, catalog)
    qc_columns = [(F.col(c) if c in joined.columns else F.lit(None)).cast("int" if i < 2 else "double").alias(c) for i, c in enumerate(("obs_count", "cycle_slips", "mp1_rms", "mp2_rms"))]
    queued = found.dropDuplicates(["file_hash"]).join(network.current_state(log).select("file_hash", F.col("seq").alias("_seq")), "file_hash", "left")
    queued = queued.select("file_hash", "filename", "filepath", F.lit("pending").alias("status"), (F.coalesce("_seq", F.lit(0)) + 1).cast("long").alias("seq"))
    results = good.select("file_hash", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error_message"), *qc_columns).unionByName(failed.select("file_hash", F.lit(False).alias("ok"), "error_message", *qc_columns)).dropDuplicates(["file_hash"])
    return new, failed, network.advance_log(log.unionByName(queued, allowMissingColumns=True), results)


def velocities_from_coordinates(spark: SparkSession, crd_path: str, ref: str, offsets: DataFrame, selection: DataFrame | None = None, **params) -> DataFrame:
    """Final velocities of all stations of a coordinate corpus."""
    local = series.to_local(coordinates.read_crd(spark, crd_path), ref).withColumnRenamed("decimal_year", "t")
    local = series.strip_outliers(local, selection) if selection is not None else local
    return series.final_velocity(series.estimate_velocity(local.select("station", "t", *series.ENU), offsets, **params))


ARRIVAL = ("file_name", "file_path", "line_no")


def telemetry_backfill(spark: SparkSession, path: str, stations: DataFrame | None = None, **params) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(velocities, displacements, events, rejects) of a folder of sentences; the station is the file name's first part.

    stations: threshold and decay of each (see sources.telemetry.read_stations); the given mm_s and decay hold for others.
    """
    lines = sentences.route_sentences(sentences.read_nmea(spark, path))
    lvm, bad_v = sentences.parse_lvm(lines.filter("kind = 'LVM'"))
    ldm, bad_d = sentences.parse_ldm(lines.filter("kind = 'LDM'"))
    station = F.substring_index("file_name", "_", 1)
    rows = [x.withColumn("station_code", station) for x in (lvm, ldm)]
    if stations is not None:
        config = {k: params.pop(k) for k in ("mm_s", "decay") if k in params}
        rows = [telemetry.with_config(x, stations, **config) for x in rows]
        params |= {"mm_s": "mm_s", "decay": "decay"}
    v, d = telemetry.process_telemetry(*rows, order=ARRIVAL, **params)
    return v, d, telemetry.detect_events(v, d, params.get("mm_s", 15.0), ARRIVAL), bad_v.unionByName(bad_d)


#: Tables of the live job: keys, time, and the order in which a station's output was made.
LIVE = {"velocities": Table(("time", "station_code"), "time", ("seq",)), "displacements": Table(("time", "station_code"), "time", ("seq",)), "events": Table(("station_code", "detection_time"), "detection_time", ("seq",)), "late": Table(("time", "station_code", "kind"), "time", ("seq",))}


def live_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The rows of process_station_stream by table of LIVE, in the names of the tables."""
    of = lambda kind: results.filter(F.col("kind") == kind)
    axes = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("east", "north", "up", "horizontal")]
    return {
        "velocities": of("velocity").select("time", "station_code", *axes("v"), "seq"),
        "displacements": of("displacement").select("time", "station_code", *axes("d"), F.col("source").alias("displacement_source"), "seq"),
        "events": of("event").select("station_code", F.col("time").alias("detection_time"), F.col("peak_velocity").alias("peak_velocity_horizontal"), F.col("peak_displacement").alias("peak_displacement_horizontal"), F.col("duration").alias("duration_seconds"), "seq"),
        "late": of("late").select("time", "station_code", F.col("source").alias("kind"), "east", "north", "up", "seq"),
    }


def live_telemetry(spark: SparkSession, path: str, out: str, checkpoint: str, stations: DataFrame, every: str | None = "1 second", files_per_trigger: int = 100, delay: float = 600.0, reorder: float | None = None, sinks: Sequence[Sink] = (), **params) -> list[StreamingQuery]:
    """Start the live job over a folder into which files of sentences fall, and return its two queries.

    The first parses, holds each station's state, and publishes every batch to the tables of LIVE under out at once (see
    sources.ledger; live_ledger reads them), then gives it to the sinks given. The second counts rejected sentences by reason
    under out/rejects. Replays within delay seconds of a station's latest row do nothing, older rows and those that come
    after reorder seconds, if given, stand in the table late. every: interval of batches; None runs over what is there and
    stops, with the same logic. Both are idempotent after a restart: the checkpoint holds the state, and a batch that is
    in the ledger isn't published again.
    """
    parsed = live.parse_stream(sentences.stream_nmea(spark, path, files_per_trigger))
    rejected = live.rejects_stream(live.parse_stream(sentences.stream_nmea(spark, path, files_per_trigger))[1])
    results = live.process_station_stream(telemetry.with_config(parsed[0], stations), remember=delay, reorder=reorder, **params)
    ledger = live_ledger(spark, out)
    run = f"{crc32(checkpoint.encode()):08x}"  # batch numbers are those of a checkpoint

    def publish(df: DataFrame, batch: int) -> None:
        ledger.append(f"{run}-{batch:012d}", live_tables(df))

    def counts(df: DataFrame, batch: int) -> None:
        replace_file(df, f"{out}/rejects", "counts.parquet")  # a row for each reason

    trigger = {"processingTime": every} if every else {"availableNow": True}
    first = results.writeStream.foreachBatch(files.fan_out([publish, *sinks])).option("checkpointLocation", f"{checkpoint}/telemetry").trigger(**trigger).start()
    second = rejected.writeStream.outputMode("complete").foreachBatch(counts).option("checkpointLocation", f"{checkpoint}/rejects").trigger(**trigger).start()
    return [first, second]


def live_ledger(spark: SparkSession, out: str) -> Ledger:
    """The published tables of a live job, to read and to compact."""
    return Ledger(spark, out, LIVE)


def bootstrap_uncertainty(profile: DataFrame, ref: DataFrame, axes: Mapping[str, Sequence[float]], rates: Sequence[float], n_draws: int = 100, size: int | None = None, seed: int = 1, length: float = 1000.0, most: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """(best models of each draw, 16 and 84 % bounds). profile: sites, dist_km, v_across, err; axes: depth, width, dip, east if wanted.

    Up to most stations x draws the draws are a matrix of counts and blocks of grid points are multiplied with it; beyond that
    the kernel is computed for each grid point and station and joined with the draws. Both give the same models.
    """
    grid = faults.parameter_grid(profile.sparkSession, axes)
    w = draws.weights(profile, ref, n_draws, size, seed, most=most)
    if w is not None:
        best = draws.best_by_draw(grid, w, draws.strike_slip(length), list(axes), rates)
    else:
        stations = profile.select("sites", "dist_km").unionByName(ref.select("sites", "dist_km")).distinct()
        names = {"length": length, "width": "width", "depth": "depth", "dip": "_dip", "strike": 0.0, "east": "east" if "east" in axes else 0.0, "north": 0.0, "x": "dist_km", "y": 0.0}
        kernel = faults.with_green(faults.expand_grid(stations, grid).withColumn("_dip", F.col("dip") - 180), names).select("grid_id", "sites", "green_n", *axes)
        drawn = faults.with_reference(faults.bootstrap(profile.select("sites", "dist_km", "v_across", "err"), n_draws, size, seed), ref.select("sites", "dist_km", "v_across", "err"))
        best = draws.best_by_join(kernel, drawn, list(axes), rates)
    best = staged(best, "best-models")
    return best, faults.confidence_bounds(best, [*axes, "rate", "slip"])
