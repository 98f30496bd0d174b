"""Archive survey: scope, corruption, classes, names, verdicts, duplicates, deleted-file pairing."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostream.functions.text import windows_relative
from geostream.operators.ordered import running_sum

#: Categories and their extensions.
PROFILES: dict[str, str] = {
    "GNSS Data": ".gns .gps .nav .obs .rinex .crx .crinex .rnx .sp3 .clk .ion .bia .erp .snx .15o .16o .17o .18o .19o .20o .21o .22o .15n .16n .17n .18n .19n .20n .21n .22n .15g .16g .17g .18g .19g .20g .21g .22g",
    "GNSS Raw (Trimble)": ".t01 .t02 .t04 .tgd",
    "GIS Data": ".shp .shx .dbf .prj .sbn .sbx .gpx .kml .kmz .geojson .topojson .gml .gpkg .mbtiles .fgb .pmtiles",
    "Seismic Data": ".segy .sgy .mseed .sac",
    "Scientific & Numeric Data": ".csv .tsv .json .xml .hdf5 .h5 .nc .fits .dat .log",
    "Image": ".jpg .jpeg .png .gif .bmp .tiff .tif .webp .svg .heic .heif .raw .cr2 .nef .arw .dng .psd .ai .eps",
    "Video": ".mp4 .mov .avi .mkv .wmv .flv .webm .mpg .mpeg .m4v",
    "Audio": ".mp3 .wav .ogg .flac .aac .m4a .wma",
    "Document": ".pdf .doc .docx .odt .rtf .wpd .xls .xlsx .ods .ppt .pptx .odp",
    "Text": ".txt .md .markdown .html .htm .tex",
    "Ebook": ".epub .mobi .azw3",
    "Source Code": ".py .js .ts .java .c .cpp .h .hpp .cs .go .rs .php .rb .swift .kt .kts .sh .bash .ps1",
    "Web Frontend": ".css .scss .sass .less .jsx .tsx .vue",
    "Configuration": ".yaml .yml .ini .cfg .conf .toml .editorconfig .gitignore .gitattributes",
    "Database": ".db .sqlite .sqlite3 .sql .dump .bak",
    "Archive": ".zip .rar .7z .tar .gz .bz2 .xz .tgz",
    "Executable": ".exe .msi .bat .com",
    "Application Library": ".dll .so .dylib",
    "Disk Image": ".iso .img .dmg .vhd .vhdx",
    "Font": ".ttf .otf .woff .woff2",
}
GNSS = ("GNSS Data", "GNSS Raw (Trimble)", "GNSS Raw (Leica)")
SYSTEM = ("$RECYCLE.BIN", "System Volume Information", ".Trash", ".Trashes", "__MACOSX")
_SHORT = r"(?i)^[a-z0-9]{4}[0-9]{3}[a-x0-9]\.[0-9]{2}[ondgm]$"
_LEICA = r"(?i)\.m[0-9]{2}$"


def scope_catalog(df: DataFrame, include_hidden: bool = False, excludes: Sequence[str] = (), system: Sequence[str] = SYSTEM) -> DataFrame:
    """Catalog rows in scope: neither hidden nor in a system directory (unless asked for), nor matched by a glob."""
    keep = F.lit(True)
    if not include_hidden:
        keep = ~F.startswith(F.col("name"), F.lit(".")) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, system)))
    for glob in excludes:
        pattern = "(^|/)" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob) + "(/|$)"
        keep = keep & ~F.regexp_like("path", F.lit(pattern))
    return df.filter(keep)


def classify_files(df: DataFrame, profiles: dict[str, str] = PROFILES) -> DataFrame:
    """df (name, extension) with category: by extension, then short observation names, then raw files, else null."""
    table = df.sparkSession.createDataFrame([(ext, c) for c, group in profiles.items() for ext in group.split()], "extension string, _category string")
    joined = df.join(F.broadcast(table), "extension", "left")  # the profile table is fixed
    rest = F.when(F.regexp_like("name", F.lit(_SHORT)), "GNSS Data").when(F.regexp_like("name", F.lit(_LEICA)), "GNSS Raw (Leica)")
    return joined.withColumn("category", F.coalesce("_category", rest)).drop("_category")


def flag_corrupt(df: DataFrame, capacity: int | None = None) -> DataFrame:
    """df with corrupt_reason (control characters or undecodable names; sizes over the capacity), which overrides category."""
    reason = F.when(F.regexp_like("name", F.lit("[\\x00-\\x1f\\x7f\\uFFFD]")), "suspect name")
    if capacity is not None:
        reason = reason.when(F.col("size_bytes") > capacity, "size over capacity")
    category = F.when(F.col("corrupt_reason").isNotNull(), "Corrupt").otherwise(F.col("category")) if "category" in df.columns else F.when(F.col("corrupt_reason").isNotNull(), "Corrupt")
    return df.withColumn("corrupt_reason", reason).withColumn("category", category)


Extractor = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def rinex_name(name: Column) -> Column:
    pattern = r"^([A-Za-z0-9]{4})([0-9]{3})([A-Za-z0-9])\.([0-9]{2})([oOnNgG])$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.map_from_arrays(F.array(*map(F.lit, ("type", "station", "doy", "session", "year", "file_type"))), F.array(F.lit("gnss_rinex"), part(1), part(2).try_cast("int").cast("string"), part(3), part(4).try_cast("int").cast("string"), part(5)))


def media_name(name: Column) -> Column:
    pattern = r"(.+?)[._\s][Ss]([0-9]{1,2})[Ee]([0-9]{1,2})"
    part = lambda i: F.regexp_extract(name, pattern, i)
    show = F.map_from_arrays(F.array(*map(F.lit, ("type", "series", "season", "episode"))), F.array(F.lit("tv_show"), F.trim(F.replace(part(1), F.lit("."), F.lit(" "))), part(2).try_cast("int").cast("string"), part(3).try_cast("int").cast("string")))
    return F.when(F.regexp_like(name, F.lit(pattern)), show).otherwise(F.create_map(F.lit("type"), F.lit("video_unknown"), F.lit("filename"), name))


EXTRACTORS: list[Extractor] = [
    (lambda name: F.regexp_like(name, F.lit(r"(?i)\.(t01|t02|t04|tgd)$")), lambda name: F.create_map(F.lit("type"), F.lit("gnss_trimble_raw"), F.lit("filename"), name, F.lit("requires_conversion"), F.lit("true"))),
    (lambda name: F.regexp_like(name, F.lit(r"^[A-Za-z0-9]{7}[A-Za-z0-9]\.[0-9]{2}[oOnNgG]$")) & F.regexp_like(name, F.lit(r"^.{4}[0-9]{3}")), rinex_name),
    (lambda name: F.regexp_like(name, F.lit(r"\.[0-9]{2}[oO]$")), lambda name: F.create_map(F.lit("type"), F.lit("gnss_rinex_possible"), F.lit("filename"), name)),
    (lambda name: F.regexp_like(name, F.lit(r"(?i)\.(mkv|mp4|avi|mov)$")), media_name),
]


def register_extractor(match: Callable[[Column], Column], extract: Callable[[Column], Column]) -> None:
    """Add a pair of column functions, name -> boolean and name -> map of strings, before the others."""
    EXTRACTORS.insert(0, (match, extract))


def extract_name_fields(df: DataFrame, name: str = "name") -> DataFrame:
    """df with fields, a map made by the first extractor that matches, or null."""
    out = F.lit(None).cast("map<string,string>")
    for match, extract in reversed(EXTRACTORS):
        out = F.when(match(F.col(name)), extract(F.col(name))).otherwise(out)
    return df.withColumn("fields", out)


def for_each_classified(df: DataFrame, fn: Callable[[dict], None]) -> DataFrame:
    """One row (done, failed): fn called for each classified row, as a dict, on executors; a failure is counted and the scan goes on."""
    def run(batches):
        done = failed = 0
        for batch in batches:
            for row in batch.to_dict("records"):
                try:
                    fn(row)
                    done += 1
                except Exception:  # noqa: BLE001  whatever a callback raises is counted
                    failed += 1
        yield pd.DataFrame({"done": [done], "failed": [failed]})

    counts = df.filter("category is not null").mapInPandas(run, "done long, failed long")
    return counts.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def dispatchable(df: DataFrame) -> DataFrame:
    """GNSS files that aren't inside an archive."""
    return df.filter(F.col("category").isin(*GNSS) & ~F.coalesce("in_archive", F.lit(False)))


def survey(catalog: DataFrame) -> DataFrame:
    """category, files, bytes, sane_bytes (without corrupt entries); category null being the total."""
    sane = F.sum(F.when(F.col("corrupt_reason").isNull(), F.col("size_bytes")).otherwise(0)) if "corrupt_reason" in catalog.columns else F.sum("size_bytes")
    rows = catalog.withColumn("category", F.coalesce("category", F.lit("Unclassified")))
    return rows.rollup("category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), sane.alias("sane_bytes"))


def verdict(catalog: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row: gnss_files, corrupt_entries, inconsistent, verdict (keep, unreliable or wipe candidate) and warnings."""
    one = catalog.agg(F.count_if(F.col("category").isin(*GNSS)).alias("gnss_files"), F.count_if(F.col("corrupt_reason").isNotNull()).alias("corrupt_entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("claimed"), F.count_if(F.col("category") == "Archive").alias("archives"))
    one = one.withColumn("inconsistent", F.col("claimed") > capacity if capacity is not None else F.lit(False))
    said = F.when(F.col("gnss_files") > 0, F.format_string("%d GNSS files: keep", "gnss_files")).when(F.col("inconsistent"), "unreliable metadata: inspect by hand").otherwise("no GNSS files: wipe candidate")
    warn = F.array_compact(F.array(F.when(F.col("inconsistent") | (F.col("corrupt_entries") > 0), F.format_string("%d corrupt entries; sizes can't be trusted", "corrupt_entries")), F.when(F.col("archives") > 0, F.format_string("%d archives not opened", "archives"))))
    return one.select("gnss_files", "corrupt_entries", "inconsistent", said.alias("verdict"), warn.alias("warnings"))


def top_categories(df: DataFrame, k: int = 10, extensions: int = 4) -> DataFrame:
    """The k categories with most files, each with its most frequent extensions; ties by name."""
    rows = df.groupBy("category", "extension").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "extension"))).filter(F.col("rank") <= extensions)
    totals = df.groupBy("category").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "category").limit(k)
    return totals.join(ranked, "category").groupBy("category", "files").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "extension"))), lambda x: x["extension"]), ",").alias("top_extensions"))


def itemise(df: DataFrame, by: str = "category", n: int = 5, kept: int = 200) -> DataFrame:
    """by, paths: the first n of the first kept paths of each bucket."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("path"))).filter(F.col("_rank") <= min(n, kept))
    return ranked.groupBy(by).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def flag_duplicates(df: DataFrame, key: str = "file_hash", order: str = "path") -> DataFrame:
    """df with duplicate: true for all rows of a content but the first."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def flag_inconsistent(df: DataFrame, capacity: int, order: str = "path") -> DataFrame:
    """df with claimed_bytes, the running sum of sizes in order (a null counts as 0), and inconsistent from the row on at which they exceed the capacity."""
    claimed = running_sum(df, (order,), F.coalesce("size_bytes", F.lit(0)), "claimed_bytes")
    return claimed.withColumn("inconsistent", F.col("claimed_bytes") > capacity)


def pair_deleted(catalog: DataFrame, metadata: DataFrame, dest_root: str = "", categories: Sequence[str] = GNSS) -> DataFrame:
    """Recovery manifest of $R payloads: src_path, original_path, deleted_at, size_bytes, category, dest_path, status.

    metadata: see sources.archive.scan_deleted_metadata. A payload whose metadata is missing, bad, or would climb out of
    the destination is recovered under _orphaned/; metadata stubs aren't payload.
    """
    place = r"^(.*\$RECYCLE\.BIN/[^/]+)/\$R([^/]*)(/.*)?$"
    payload = catalog.filter(F.col("category").isin(*categories) & F.regexp_like("path", F.lit(place)))
    payload = payload.withColumn("meta_path", F.concat(F.regexp_extract("path", place, 1), F.lit("/$I"), F.regexp_extract("path", place, 2)))
    joined = payload.join(metadata.select("meta_path", "original_path", "deleted_at", "error"), "meta_path", "left")
    inside = windows_relative(F.col("original_path"))
    good = F.col("original_path").isNotNull() & F.col("error").isNull() & ~F.array_contains(F.split(inside, "/"), "..")
    good = F.coalesce(good, F.lit(False))
    top = F.when(good, inside).otherwise(F.concat(F.lit("_orphaned/$R"), F.regexp_extract("path", place, 2)))
    dest = F.concat(F.lit(dest_root.rstrip("/") + "/" if dest_root else ""), top, F.regexp_extract("path", place, 3))
    return joined.select(F.col("path").alias("src_path"), F.when(good, F.col("original_path")).otherwise("").alias("original_path"), F.when(good, F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss")).otherwise("").alias("deleted_at"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "category", dest.alias("dest_path"), F.when(good, "ok").otherwise("orphan").alias("status"))


def manifest_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "orphan").alias("orphans"), F.sum("size_bytes").alias("total_bytes"), (F.count("*") - F.count_distinct("dest_path")).alias("dest_collisions"))


def remaining(paths: DataFrame, done: DataFrame) -> DataFrame:
    return paths.join(done.select("path").distinct(), "path", "left_anti")


def merge_done(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("path").union(new.select("path")).distinct()
