"""Dates, sessions and the several decimal years (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GPS_EPOCH = 315964800  # 1980-01-06 00:00:00 as Unix seconds
LONG_NAME_WEEK = 2238  # products have long names from this week on


def sentence_time(clock: Column, date: Column) -> Column:
    """hhmmss.ss and mmddyy -> UTC timestamp in the century of 2000; null if malformed or if the microseconds round up to a million."""
    shape = F.regexp_like(clock, F.lit(r"^[0-9]{6}(\.[0-9]+)?$")) & F.regexp_like(date, F.lit(r"^[0-9]{6}$"))
    micros = F.round(F.concat(F.lit("0"), F.regexp_extract(clock, r"(\.[0-9]+)$", 1)).try_cast("double") * 1_000_000).cast("int")

    def part(col: Column, at: int) -> Column:
        return F.substring(col, at, 2).try_cast("int")

    seconds = part(clock, 5) + (micros / 1_000_000).cast("decimal(8,6)")
    made = F.try_make_timestamp(2000 + part(date, 5), part(date, 1), part(date, 3), part(clock, 1), part(clock, 3), seconds)
    return F.when(shape & (micros < 1_000_000) & (part(clock, 5) < 60), made)


def header_time(value: Column) -> Column:
    """'YYYY MM DD hh mm ss.s' -> UTC timestamp, or null."""
    parts = F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")
    number = [F.get(parts, F.lit(i)).try_cast("int") for i in range(5)]
    return F.try_make_timestamp(*number, F.get(parts, F.lit(5)).try_cast("decimal(9,6)"))


def session_of(name: Column) -> Column:
    """Five-digit session YYDDD of a file name: the run of five digits at its end, else the first, else null."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    last = F.nullif(F.regexp_extract(stem, r"([0-9]{5})$", 1), F.lit(""))
    return F.coalesce(last, F.nullif(F.regexp_extract(stem, r"([0-9]{5})", 1), F.lit("")))


def full_year(two_digits: Column, last_of_2000: int = 79) -> Column:
    """Two-digit year: up to last_of_2000 it is 20xx, beyond 19xx."""
    return F.when(two_digits > last_of_2000, two_digits + 1900).otherwise(two_digits + 2000)


def session_year(session: Column, legacy: bool = False) -> Column:
    """YYDDD -> decimal year (doy - 1) / 365.25, with 80 as 2080; null unless the day is 1 to 366. legacy: doy / 365.25."""
    year, doy = F.substring(session, 1, 2).try_cast("int"), F.substring(session, 3, 3).try_cast("int")
    return F.when(doy.between(1, 366), full_year(year, 80) + (doy - (0 if legacy else 1)) / 365.25)


def year_length(year: Column) -> Column:
    """366 where the year divides by four."""
    return F.when(year % 4 == 0, 366).otherwise(365)


def calendar_decimal_year(date: Column) -> Column:
    """Year plus (day of year - 1) / days in that year."""
    year = F.year(date)
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return year + (F.dayofyear(date) - 1) / days


def julian_decimal_year(date: Column) -> Column:
    """Year plus (day of year - 1) / 365.25."""
    return F.year(date) + (F.dayofyear(date) - 1) / 365.25


def gps_week(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit("1980-01-06").cast("date")) / 7).cast("int")


def gps_day(date: Column) -> Column:
    """Day of the GPS week, Sunday being 0."""
    return F.pmod(F.datediff(date, F.lit("1980-01-06").cast("date")), F.lit(7))


def gps_time(week: Column, seconds: Column) -> Column:
    """GPS week and seconds -> timestamp, without leap seconds."""
    return F.timestamp_seconds(F.lit(GPS_EPOCH) + week * 604800 + seconds)


def local_civil(time: Column, zone: str = "+08:00") -> Column:
    return F.from_utc_timestamp(time, zone)


#: Fixed values: (centre, content) -> (sampling, format).
PRODUCTS = {("IGS", "ORB"): ("15M", "SP3"), ("IGS", "CLK"): ("05M", "CLK"), ("COD", "ORB"): ("05M", "SP3"), ("COD", "CLK"): ("30S", "CLK")}


def product_name(centre: str, content: str, date: Column) -> Column:
    """Name of a day's product: long from GPS week 2238 on, short before."""
    sampling, kind = PRODUCTS[centre, content]
    long_name = F.format_string(f"{centre}0OPSFIN_%04d%03d0000_01D_{sampling}_{content}.{kind}.gz", F.year(date), F.dayofyear(date))
    short_name = F.format_string(f"{centre.lower()}%d%d.{kind.lower()}.Z", gps_week(date), gps_day(date))
    return F.when(gps_week(date) >= LONG_NAME_WEEK, long_name).otherwise(short_name)
