"""Ingestion log, header cross-checks, coverage, equipment history, field records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostream.functions.geodesy import antenna_height
from geostream.functions.times import LONG_NAME_WEEK, gps_week, product_name, year_length
from geostream.operators.rollups import days_of
from geostream.operators.series import any_larger, dealt
from geostream.sources.shared import staged

METHODS = ("campaign", "continuous")
MEASURED_BY = ("manual", "sensor")


def current_state(log: DataFrame) -> DataFrame:
    """The last state of each file_hash by seq."""
    rest = [c for c in log.columns if c != "file_hash"]
    return log.groupBy("file_hash").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("file_hash", "s.*")


def pending_files(found: DataFrame, log: DataFrame, skip: Sequence[str] = ("success",)) -> DataFrame:
    """Found files whose hash isn't in one of the states to skip: all but success for scans; a dispatcher also skips pending and processing."""
    done = current_state(log).filter(F.col("status").isin(*skip)).select("file_hash")
    return found.join(done, "file_hash", "left_anti")


def scan_counts(found: DataFrame, log: DataFrame, skip: Sequence[str] = ("success",)) -> DataFrame:
    """outcome (queued, skipped, error for files without hash) and count."""
    state = current_state(log).select("file_hash", F.col("status").isin(*skip).alias("done"))
    outcome = F.when(F.col("file_hash").isNull(), "error").when(F.coalesce("done", F.lit(False)), "skipped").otherwise("queued")
    return found.join(state, "file_hash", "left").groupBy(outcome.alias("outcome")).count()


def new_catalog_rows(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.dropDuplicates(["file_hash"]).join(existing.select("file_hash"), "file_hash", "left_anti")


def resolve_stations(files: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, failed with error_message) by station_code of the header; an empty code fails."""
    joined = files.join(stations.select("station_code", F.lit(True).alias("_known")), "station_code", "left")
    message = F.when(F.col("station_code").isNull(), "no station in header").otherwise(F.concat(F.lit("unknown station "), "station_code"))
    return joined.filter("_known").drop("_known"), joined.filter("_known is null").withColumn("error_message", message).drop("_known")


def advance_log(log: DataFrame, results: DataFrame) -> DataFrame:
    """log with an event for each result (file_hash, ok, error_message, qc columns): success with its figures, else failed with its error."""
    last = current_state(log)
    names = [c for c in log.columns if c not in ("status", "error_message", "seq", "qc_obs_count", "qc_cycle_slips", "qc_mp1_rms", "qc_mp2_rms")]
    qc = [F.when(F.col("r.ok"), F.col(f"r.{c}")).alias(f"qc_{c}") for c in ("obs_count", "cycle_slips", "mp1_rms", "mp2_rms")]
    events = last.alias("l").join(results.alias("r"), "file_hash").select("file_hash", *[F.col(f"l.{c}") for c in names if c != "file_hash"], F.when(F.col("r.ok"), "success").otherwise("failed").alias("status"), (F.col("l.seq") + 1).alias("seq"), F.when(~F.col("r.ok"), F.col("r.error_message")).alias("error_message"), *qc)
    return log.unionByName(events, allowMissingColumns=True)


def crosscheck_headers(headers: DataFrame, sta: DataFrame) -> DataFrame:
    """station_code, finding: receiver or antenna mismatch, missing on either side, ok. Antennas compare by their first token."""
    joined = headers.select("station_code", F.col("receiver_type").alias("h_rec"), F.col("antenna_type").alias("h_ant"), F.lit(1).alias("h")).join(sta.select("station_code", F.col("receiver_type").alias("s_rec"), F.col("antenna_type").alias("s_ant"), F.lit(1).alias("s")), "station_code", "full_outer")
    rec = ~F.col("h_rec").eqNullSafe(F.col("s_rec"))
    ant = ~F.substring_index("h_ant", " ", 1).eqNullSafe(F.substring_index("s_ant", " ", 1))
    finding = F.when(F.col("s").isNull(), "missing in station information").when(F.col("h").isNull(), "no header").when(rec & ant, "receiver and antenna mismatch").when(rec, "receiver mismatch").when(ant, "antenna mismatch").otherwise("ok")
    return joined.select("station_code", finding.alias("finding"), "h_rec", "s_rec", "h_ant", "s_ant")


def uncalibrated(headers: DataFrame, antennas: DataFrame) -> DataFrame:
    """Headers whose antenna model (first token, whole) is in no calibration."""
    known = antennas.select(F.substring_index("antenna_type", " ", 1).alias("_model")).distinct()
    return headers.filter("antenna_type is not null").withColumn("_model", F.substring_index("antenna_type", " ", 1)).join(known, "_model", "left_anti").drop("_model")


def validation_report(checked: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: mismatches, missing lists, calibration gaps, ok (false if nothing was checked)."""
    one = checked.agg(F.count("*").alias("checked"), F.count_if(F.col("finding").like("%mismatch")).alias("mismatches"), *[F.sort_array(F.collect_set(F.when(F.col("finding") == what, F.col("station_code")))).alias(name) for what, name in (("missing in station information", "missing_station_info"), ("no header", "missing_headers"))])
    lacking = gaps.agg(F.sort_array(F.collect_set("station_code")).alias("uncalibrated"))
    both = one.crossJoin(lacking)  # one row each
    ok = (F.col("checked") > 0) & (F.col("mismatches") == 0) & (F.size("missing_station_info") == 0) & (F.size("uncalibrated") == 0)
    return both.withColumn("ok", ok)


def triage_positions(df: DataFrame, rms: float = 3.0, shift: float = 1.0) -> DataFrame:
    """df with shift_m and triage: unknown without RMS, ok up to rms, then bad_apriori from shift on, else bad_obs."""
    moved = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    out = F.when(F.col("rms_m").isNull(), "unknown").when(F.col("rms_m") <= rms, "ok").when(moved >= shift, "bad_apriori").otherwise("bad_obs")
    return df.withColumn("shift_m", moved).withColumn("triage", out)


def worst_stations(df: DataFrame) -> DataFrame:
    return df.agg(F.max("rms_m").alias("max_rms"), F.max_by("station", F.struct("rms_m", "station")).alias("max_rms_station"), F.max("bad_pct").alias("max_bad"), F.max_by("station", F.struct("bad_pct", "station")).alias("max_bad_station"))


def stations_per_solution(df: DataFrame) -> DataFrame:
    return df.groupBy("file_name").agg(F.count_distinct("station").alias("n_stations"))


def latest_solution(df: DataFrame, suffix: str = "") -> DataFrame:
    """The last file by name."""
    return df.filter(F.endswith(F.col("file_name"), F.lit(suffix))).agg(F.max("file_name").alias("file_name"))


def compact_ranges(df: DataFrame, by: Sequence[str], col: str, name: str = "ranges") -> DataFrame:
    """(by, ranges): distinct whole numbers as 'a---b, c'."""
    days = df.select(*by, col).distinct()
    islands = days.withColumn("_run", F.col(col) - F.row_number().over(Window.partitionBy(*by).orderBy(col)))
    runs = islands.groupBy(*by, "_run").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return runs.groupBy(*by).agg(range_text(F.sort_array(F.collect_list(F.struct("lo", "hi")))).alias(name))


def distinct_days(df: DataFrame, by: Sequence[str] = ("station", "year", "doy")) -> DataFrame:
    return df.select(*by).distinct()


def gap_ranges(days: DataFrame, by: Sequence[str] = ("station", "year")) -> DataFrame:
    """(by, gaps): the ranges (lo, hi) of days that each station-year present lacks, between the days (by, doy) that it has.

    A station-year has 366 days at most, so that its days fit a row: one shuffle of the distinct days, without a row for
    each day that is missing.
    """
    had = days.filter("doy is not null").groupBy(*by).agg(F.sort_array(F.collect_set("doy")).alias("_had")).withColumn("_end", year_length(F.col("year")) + 1)
    ends = had.withColumn("_ends", F.concat(F.array(F.lit(0)), "_had", F.array("_end")))
    steps = F.zip_with(F.slice("_ends", F.lit(1), F.size("_ends") - 1), F.slice("_ends", F.lit(2), F.size("_ends") - 1), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi")))
    return ends.select(*by, F.filter(steps, lambda x: (x["lo"] <= x["hi"])).alias("gaps"))


def day_gaps(days: DataFrame, by: Sequence[str] = ("station", "year")) -> DataFrame:
    """(by, doy) of all days of each station-year present that days (by, doy) lacks."""
    gaps = gap_ranges(days, by).select(*by, F.explode("gaps").alias("_gap"))
    return gaps.select(*by, F.explode(F.sequence("_gap.lo", "_gap.hi")).alias("doy"))


def range_text(ranges: Column) -> Column:
    """Ranges (lo, hi) in order as 'a---b, c'."""
    return F.array_join(F.transform(ranges, lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat_ws("---", r["lo"].cast("string"), r["hi"].cast("string")))), ", ")


def coverage(days: DataFrame, by: Sequence[str] = ("station", "year")) -> DataFrame:
    """(by, n_days, year_days, share) of distinct days with data."""
    return days.groupBy(*by).agg(F.count_distinct("doy").alias("n_days")).withColumn("year_days", year_length(F.col("year"))).withColumn("share", F.col("n_days") / F.col("year_days"))


def coverage_report(days: DataFrame, by: Sequence[str] = ("station", "year")) -> DataFrame:
    """coverage with the ranges of days with data and of gaps."""
    out = coverage(days, by).join(compact_ranges(days, by, "doy", "with_data"), list(by))
    return out.join(gap_ranges(days, by).withColumn("gaps", range_text(F.col("gaps"))), list(by))


def coverage_of_bits(stored: DataFrame, by: Sequence[str] = ("station", "year")) -> DataFrame:
    """The columns of coverage_report from bitmaps (by, bits; see operators.rollups), in one pass without a shuffle: ranges are read off the bits."""
    had = stored.withColumn("_days", days_of(F.col("bits"))).withColumn("year_days", year_length(F.col("year")))
    before = lambda i: F.get("_days", i - 1)
    starts = F.filter("_days", lambda d, i: (i == 0) | (before(i) < d - 1))
    ends = F.filter("_days", lambda d, i: (i == F.size("_days") - 1) | (F.get("_days", i + 1) > d + 1))
    runs = F.arrays_zip(starts.alias("lo"), ends.alias("hi"))
    # Each day begins what lies between it and the day before, and the end of the year what lies behind the last.
    bounds = F.concat("_days", F.array(F.col("year_days") + 1))
    lacking = F.transform(bounds, lambda d, i: F.struct((F.when(i == 0, 0).otherwise(before(i)) + 1).alias("lo"), (d - 1).alias("hi")))
    shown = had.withColumn("n_days", F.bitmap_count("bits"))
    return shown.select(*by, "n_days", "year_days", (F.col("n_days") / F.col("year_days")).alias("share"), range_text(runs).alias("with_data"), range_text(F.filter(lacking, lambda x: x["lo"] <= x["hi"])).alias("gaps"))


#: Days are counted from this many before 1970, so that all dates lie in 0 ... 2**_LEVELS - 1.
_BEFORE, _LEVELS = 1 << 20, 22


def _day(date: Column) -> Column:
    return (F.unix_date(date) + _BEFORE).cast("long")


def cover(lo: Column, hi: Column) -> Column:
    """Array of (level, node): the fewest aligned blocks of 2**level days that make up the days lo <= d < hi, two of a level at most."""

    def of(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left, right = F.call_function("shiftright", lo + size - 1, k), F.call_function("shiftright", hi, k)
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        return F.array(F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), of)))


def equipment_at(history: DataFrame, probes: DataFrame, few: int = 64) -> DataFrame:
    """probes (station_code, date) with the equipment in place: installed by then, not yet removed; an open end is null, an open start never matches.

    Where no station has more than few spells, each probe meets all of its station's. Else spells, within the probes' dates, are
    cut into aligned blocks of days, some 2 log2 of their length, and a probe lies in one block of each level: the two
    meet by station, level and block, in exactly one block if at all. A station with many spells and probes makes no
    product of them, and its rows are dealt by block. Levels that no spell uses have no probes (one row tells which).
    """
    spells = history.filter("date_installed is not null")
    own = [c for c in history.columns if c not in probes.columns]
    if not any_larger(spells, ("station_code",), few):
        h, p = spells.alias("h"), probes.alias("p")
        inside = (F.col("p.date") >= F.col("h.date_installed")) & (F.col("h.date_removed").isNull() | (F.col("p.date") < F.col("h.date_removed")))
        return p.join(h, (F.col("p.station_code") == F.col("h.station_code")) & inside).select("p.*", *[F.col(f"h.{c}") for c in own])
    first, last, n = probes.agg(F.min(_day(F.col("date").cast("date"))), F.max(_day(F.col("date").cast("date"))), F.count("date")).first()
    begin = F.greatest(_day(F.col("date_installed").cast("date")), F.lit(first))
    end = F.least(_day(F.col("date_removed").cast("date")), F.lit(None if last is None else last + 1))  # a null is left out
    blocks = staged(spells.select("station_code", *own, F.explode(cover(begin, end)).alias("_block")).select("station_code", *own, F.col("_block.level").alias("_level"), F.col("_block.node").alias("_node")), "spell-blocks")
    levels = sorted(r[0] for r in blocks.select("_level").distinct().collect())  # 23 at most
    if not levels:
        return probes.join(spells.select("station_code", *own), "station_code").filter(F.lit(False)).select(*probes.columns, *own)
    day = _day(F.col("date").cast("date"))
    met = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(day / (1 << k)).cast("long").alias("node")) for k in levels]))
    placed = probes.filter("date is not null").withColumn("_at", met).withColumn("_level", F.col("_at.level")).withColumn("_node", F.col("_at.node")).drop("_at")
    keys = ["station_code", "_level", "_node"]
    return dealt(placed, *keys, rows=n * len(levels)).join(blocks, keys).select(*probes.columns, *own)


def day_available(status: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (station_code, year, doy) with available: the day is inside a range of its station-year."""
    known = status.select("station_code", F.col("processing_year").alias("year"), "available_days")
    inside = F.exists("available_days", lambda r: F.col("doy").between(r["lo"], r["hi"]))
    return probes.join(known, ["station_code", "year"], "left").withColumn("available", F.coalesce(inside, F.lit(False))).drop("available_days")


def missing_products(spark: SparkSession, first: str, last: str, files: DataFrame, products: Sequence[tuple[str, str]] = (("COD", "ORB"), ("COD", "CLK"))) -> DataFrame:
    """(date, content, file_name) expected from first to last, in the era of long names, and not among files (file_name)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).filter(gps_week(F.col("date")) >= LONG_NAME_WEEK)
    names = F.array(*[F.struct(F.lit(content).alias("content"), product_name(centre, content, F.col("date")).alias("file_name")) for centre, content in products])
    expected = days.select("date", F.explode(names).alias("x")).select("date", "x.*")
    return expected.join(files.select("file_name").distinct(), "file_name", "left_anti").select("date", "content", "file_name")


def upsert_stations(current: DataFrame, incoming: DataFrame, updatable: Sequence[str] = ("name", "lat", "lon", "elevation", "host", "port", "fault_segment")) -> DataFrame:
    """current with incoming rows: new stations whole, known ones in their updatable columns only."""
    joined = current.withColumn("_old", F.lit(True)).alias("c").join(incoming.withColumn("_new", F.lit(True)).alias("i"), F.col("c.station_code") == F.col("i.station_code"), "full_outer")
    def pick(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"c.{c}").alias(c)
        fresh = F.col("_new") if c in updatable else F.col("_new") & F.col("_old").isNull()
        return F.when(fresh, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    return joined.select(F.coalesce("c.station_code", "i.station_code").alias("station_code"), *[pick(c) for c in current.columns if c != "station_code"])


def active_stations(df: DataFrame) -> DataFrame:
    return df.filter("status = 'active'").select("station_code", "name", "lat", "lon").orderBy("station_code")


def active_staff(df: DataFrame) -> DataFrame:
    return df.filter("is_active").orderBy("full_name")


def lookup_equipment(df: DataFrame, code: str | None = None) -> DataFrame:
    """The item with a code; without one, the inventory by type and code."""
    return df.filter(F.col("qr_code") == code) if code is not None else df.orderBy("equipment_type", "qr_code")


def validate_logsheets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reasons): campaign sheets need an antenna and four slants; the method and, where a value is set, its source have vocabularies."""
    campaign = F.coalesce(F.col("monitoring_method") == "campaign", F.lit(False))
    rules = [F.when(F.col("monitoring_method").isNotNull() & ~F.col("monitoring_method").isin(*METHODS), "monitoring_method")]
    rules += [F.when(campaign & F.col(c).isNull(), f"{c} missing") for c in ("antenna_model", *(f"slant_{d}_m" for d in "nesw"))]
    for value, source in (("battery_voltage_v", "battery_voltage_source"), ("temperature_c", "temperature_source")):
        rules.append(F.when(F.col(value).isNotNull() & F.col(source).isNotNull() & ~F.col(source).isin(*MEASURED_BY), source))
    checked = df.withColumn("reasons", F.array_compact(F.array(*rules)))
    return checked.filter("size(reasons) = 0").drop("reasons"), checked.filter("size(reasons) > 0")


def enrich_campaign(df: DataFrame) -> DataFrame:
    """Campaign sheets with antenna_height_m and session_id (station and unpadded day of year)."""
    height = antenna_height(F.col("antenna_model"), [F.col(f"slant_{d}_m") for d in "nesw"])
    return df.withColumn("antenna_height_m", height).withColumn("session_id", F.concat(F.upper("station_code"), F.dayofyear("visit_date").cast("string")))


def submitted(logsheets: DataFrame, ids: DataFrame) -> DataFrame:
    return logsheets.join(ids.select("client_uuid").distinct(), "client_uuid", "left_semi")


def logsheet_observers(logsheets: DataFrame, links: DataFrame, staff: DataFrame) -> DataFrame:
    """client_uuid with its observers' names in order."""
    named = links.join(staff.select("staff_id", "full_name"), "staff_id")
    return logsheets.join(named, "client_uuid").groupBy("client_uuid").agg(F.sort_array(F.collect_list("full_name")).alias("observers"))


def latest_logsheets(df: DataFrame, station: str | None = None, n: int = 50) -> DataFrame:
    rows = df.filter(F.col("station_code") == station) if station else df
    return rows.orderBy(F.desc("visit_date"), "client_uuid").limit(n)


def latest_product(df: DataFrame) -> DataFrame:
    """Each station's velocity product of the last date."""
    last = Window.partitionBy("station_code").orderBy(F.desc("date_computed"), F.desc("solution_id"))
    return df.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")
