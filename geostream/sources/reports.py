"""Observation headers, station information, antenna lists and the reports of processing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostream.functions.text import first_token
from geostream.functions.times import header_time
from geostream.sources.headers import read_headers
from geostream.sources.lines import read_lines, whole_files

#: Labels and marks of the formats, and how reports word their figures.
MARKER = "RINEX VERSION / TYPE"
OBSERVATIONS = r"(?i)#[ \t]*obs[ \t]*:[ \t]*([0-9]+)"
ALL_OBSERVATIONS = r"(?i)total[ \t]+obs[ \t]*:[ \t]*([0-9]+)"
SLIPS = r"(?i)slips[^:\n]*:[ \t]*([0-9]+)"
MULTIPATH = r"(?i)MP{0}\s*:\s*([0-9.]+)"
UNIT_WEIGHT = r"RMS OF UNIT WEIGHT\s*:\s*([0-9.]+)"
BAD_SHARE = r"BAD OBSERVATIONS\s*:\s*([0-9.]+)"
USED = r"USED OBSERVATIONS\s*:\s*([0-9]+)"
ACCEPTED = r"(?i)stations\s+accepted\s*:\s*([0-9]+)"
FIXING = r"(?i)fixing\s+rate\s*:\s*([0-9.]+)"
FINISHED, HELMERT, COMPARISON = r"(?i)BPE\s+finished", r"(?i)HELMCHK\s*:\s*failed", r"(?i)COMPARF\s*:\s*failed"


def _found(pattern: str, kind: str = "string", text: str = "text") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(kind)


def _names(with_path: bool) -> list[str]:
    return ["file_path", "file_name"] if with_path else ["file_name"]


def scan_rinex_headers(spark: SparkSession, path: str, glob: str | None = None, with_hash: bool = False) -> DataFrame:
    """(file_path, file_name, station_code, sampling_interval, receiver_type, antenna_type, start_time, end_time, has_marker) of each file, with_hash behind file_hash.

    A header line has its value in columns 1-60 and its label in 61-80; types stand in 21-40; station codes are put in upper
    case, as everywhere here. Of each label the first line counts. has_marker: the format's mark is in the first ten lines. A file is read to the end of its
    header, or once to its own for the hash; see sources.headers.
    """
    headers = read_headers(spark, path, glob, with_hash)
    value, kind, time = (lambda line, a=a, n=n: F.substring(line, a, n) for a, n in ((1, 60), (21, 20), (1, 43)))

    def first(label: str, col) -> Column:
        return col(F.get(F.filter("lines", lambda line: F.trim(F.substring(line, 61, 20)) == label), F.lit(0)))

    columns = {
        "station_code": first("MARKER NAME", lambda x: F.upper(first_token(value(x)))), "sampling_interval": first("INTERVAL", lambda x: F.trim(F.substring(x, 1, 10)).try_cast("double")),
        "receiver_type": first("REC # / TYPE / VERS", lambda x: F.trim(kind(x))), "antenna_type": first("ANT # / TYPE", lambda x: F.trim(kind(x))),
        "start_time": first("TIME OF FIRST OBS", lambda x: header_time(time(x))), "end_time": first("TIME OF LAST OBS", lambda x: header_time(time(x))),
    }
    marked = F.exists(F.slice("lines", 1, 10), lambda line: F.contains(line, F.lit(MARKER)))
    return headers.select("file_path", "file_name", *[c.alias(name) for name, c in columns.items()], marked.alias("has_marker"), *(["file_hash"] if with_hash else []))


def scan_station_info(spark: SparkSession, path: str) -> DataFrame:
    """(station_code, receiver_type, antenna_type) of the TYPE 002 section; rows of under 141 characters are skipped."""
    in_file = Window.partitionBy("file_path").orderBy("line_no")
    section = F.last(F.when(F.regexp_like("line", F.lit(r"^TYPE [0-9]{3}:")), F.substring("line", 6, 3)), ignorenulls=True).over(in_file)
    rows = read_lines(spark, path).withColumn("section", section).filter("section = '002' and length(line) >= 141 and line not like 'TYPE %' and line not like '*%' and line not like 'STATION NAME%'")
    cut = [("station_code", 1, 4), ("receiver_type", 70, 20), ("antenna_type", 122, 20)]
    return rows.select(*[F.trim(F.substring("line", a, n)).alias(name) for name, a, n in cut]).filter("station_code != ''")


def scan_antenna_types(spark: SparkSession, path: str) -> DataFrame:
    """Distinct antenna_type of calibration records."""
    rows = read_lines(spark, path).filter(F.contains("line", F.lit("TYPE / SERIAL NO")))
    return rows.select(F.trim(F.substring("line", 1, 20)).alias("antenna_type")).filter("antenna_type != ''").distinct()


def scan_qc_reports(spark: SparkSession, path: str, glob: str | None = None, with_path: bool = False) -> DataFrame:
    """(file_name, obs_count, cycle_slips, mp1_rms, mp2_rms) of quality reports, with_path behind file_path; what a report lacks is null.

    Observations stand behind '# obs :' or 'total obs :'; of several columns the first counts.
    """
    count = F.coalesce(_found(OBSERVATIONS, "int"), _found(ALL_OBSERVATIONS, "int"))
    slips = _found(SLIPS, "int")
    paths = [_found(MULTIPATH.format(i), "double").alias(f"mp{i}_rms") for i in (1, 2)]
    return whole_files(spark, path, glob).select(*_names(with_path), count.alias("obs_count"), slips.alias("cycle_slips"), *paths)


def scan_spp_reports(spark: SparkSession, path: str, glob: str | None = None, with_path: bool = False) -> DataFrame:
    """(file_name, station, rms_m, bad_pct, used_obs, dx, dy, dz); a truncated report has nulls.

    The shift is the third of the four numbers behind an axis; the station's code begins the X row.
    """
    number = r"\s+-?[0-9]+\.[0-9]+"
    shifts = [_found(rf"(?m)\b{axis}{number}{number}\s+(-?[0-9]+\.[0-9]+){number}", "double").alias(f"d{axis.lower()}") for axis in "XYZ"]
    return whole_files(spark, path, glob).select(
        *_names(with_path),
        _found(rf"(?m)^\s*([A-Z0-9]{{4}})\b[^\n]*?\bX{number}{number}{number}").alias("station"),
        _found(UNIT_WEIGHT, "double").alias("rms_m"),
        _found(BAD_SHARE, "double").alias("bad_pct"),
        _found(USED, "int").alias("used_obs"),
        *shifts,
    )


def scan_spp_summary(spark: SparkSession, path: str, glob: str | None = None, with_path: bool = False) -> DataFrame:
    """(file_name, max_rms, max_rms_station, max_bad, max_bad_station) of combined summaries."""
    columns = []
    for name, unit in (("RMS", "M"), ("BAD", "%")):
        head = rf"MAX\. {name}:\s*"
        columns += [_found(head + r"([0-9.]+)", "double").alias(f"max_{name.lower()}"), _found(head + rf"[0-9.]+\s*{unit}\s+FOR STATION:\s*([A-Z0-9]{{4}})").alias(f"max_{name.lower()}_station")]
    return whole_files(spark, path, glob).select(*_names(with_path), *columns)


def scan_run_logs(spark: SparkSession, path: str, glob: str | None = None, with_path: bool = False) -> DataFrame:
    """(file_name, finished, stations_accepted, fixing_rate in 0..1, helmert_failed, comparison_failed) of processing runs."""
    rate = _found(FIXING, "double")
    percent = F.regexp_like("text", F.lit(FIXING + r"\s*%"))
    return whole_files(spark, path, glob).select(
        *_names(with_path),
        F.regexp_like("text", F.lit(FINISHED)).alias("finished"),
        _found(ACCEPTED, "int").alias("stations_accepted"),
        F.when(percent | (rate > 1), rate / 100).otherwise(rate).alias("fixing_rate"),
        F.regexp_like("text", F.lit(HELMERT)).alias("helmert_failed"),
        F.regexp_like("text", F.lit(COMPARISON)).alias("comparison_failed"),
    )


def has_format_marker(text: Column, marker: str = MARKER) -> Column:
    """True if the marker stands in the first ten lines."""
    return F.exists(F.slice(F.split(text, "\n"), 1, 10), lambda line: F.contains(line, F.lit(marker)))
