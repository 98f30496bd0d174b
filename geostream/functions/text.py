"""Instrument sentences, names and paths (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Blank-separated tokens of a line, without empty ones."""
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def token(line_tokens: Column, place: int) -> Column:
    """Token at a place from 0, or null."""
    return F.get(line_tokens, F.lit(place))


def xor_checksum(body: Column) -> Column:
    """XOR of the bytes of an ASCII string as two upper-case hex digits."""
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    return F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda acc, x: acc.bitwiseXOR(x))), 2, "0")


def checksum_ok(sentence: Column) -> Column:
    """True if the two hex digits after the last * are the XOR of what stands between $ and *; no * is invalid."""
    body = F.regexp_extract(sentence, r"^\$?(.*)\*[^*]*$", 1)
    given = F.upper(F.trim(F.regexp_extract(sentence, r"\*([^*]*)$", 1)))
    return F.contains(sentence, F.lit("*")) & (F.length(given) == 2) & (xor_checksum(body) == given)


def station_of(name: Column) -> Column:
    """First four characters in upper case."""
    return F.upper(F.substring(F.trim(name), 1, 4))


def first_token(text: Column) -> Column:
    """What stands before the first blank."""
    return F.substring_index(F.trim(text), " ", 1)


def windows_relative(path: Column) -> Column:
    r"""D:\\Backups\\f.22o -> D/Backups/f.22o: the drive letter becomes a folder, leading separators go."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.concat(F.upper(F.substring(slashed, 1, 1)), F.lit("/"), F.regexp_replace(F.substring(slashed, 3, 1 << 20), r"^/+", ""))
    return F.regexp_replace(F.when(F.substring(slashed, 2, 1) == ":", drive).otherwise(slashed), r"^/+", "")


def size_mb(size: Column) -> Column:
    return F.round(size / (1024 * 1024), 2)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
