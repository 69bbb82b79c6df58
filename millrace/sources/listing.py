"""Folders as tables of file metadata: candidates resolved against a listing, files sorted into dated folders, and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A date in a file's name, its month and day padded or not.
DATE = r"(\d{4})-(\d{1,2})-(\d{1,2})"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, modified) of all files below a folder, subfolders too; nothing of their content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select("path", _name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"))


def _name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)$", 1))


def day_variants(name: Column) -> Column:
    """A dated name as it is, then with its day padded to two digits, then without the padding; names without a date have one variant."""
    pattern = r"^(.*_)?(\d{4}-\d{2}-)(0?)(\d)(\.json)$"
    padded = F.regexp_replace(name, pattern, "$1$20$4$5")
    bare = F.regexp_replace(name, pattern, "$1$2$4$5")
    return F.array_distinct(F.array(name, padded, bare))


def resolved(items: DataFrame, found: DataFrame, item: str, candidates: str, name: str = "name") -> DataFrame:
    """items (without the candidates) with `used`, its place among the candidates from 0, and the columns of found: of each item's candidates the first that is found.

    candidates: an array of names in order of preference. found: a row per name that is there and could be
    read; of several the least by its columns. An item for which none is found has nulls; repeated items are one.
    """
    more = [c for c in found.columns if c != name]
    one = found.groupBy(name).agg(F.min(F.struct(*more)).alias("__row")) if more else found.select(name, F.struct(F.lit(1)).alias("__row")).distinct()
    tried = items.select(item, F.posexplode(candidates).alias("place", "used"))
    met = tried.join(one, tried["used"] == one[name]).groupBy(item).agg(F.min_by(F.struct("used", "place", "__row"), "place").alias("__best"))
    rest = [c for c in items.columns if c not in (candidates, "used", "place", *more)]
    return items.select(*rest).distinct().join(met, item, "left").select(*rest, "__best.used", "__best.place", *[F.col(f"__best.__row.{c}").alias(c) for c in more])


def json_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(name, doc) of the files below a folder whose whole text is a JSON document of this schema; others are left out."""
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", _name(F.col("_metadata.file_path")).alias("name"))
    parsed = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    rows = text.select("name", parsed.alias("p")).where("p IS NOT NULL AND p.__bad IS NULL")
    names = [f.name for f in rows.schema["p"].dataType.fields if f.name != "__bad"]
    return rows.select("name", F.struct(*[F.col(f"p.{c}").alias(c) for c in names]).alias("doc"))


def with_fallback(spark: SparkSession, items: DataFrame, folder: str, schema: str, item: str, path: str) -> DataFrame:
    """items with used, place and doc: the first of a path's day variants that exists in the folder and parses."""
    named = items.withColumn("__candidates", day_variants(F.col(path)))
    return resolved(named, json_files(spark, folder, schema), item, "__candidates")


def padded_date(name: Column) -> Column:
    """The date in a name, padded; null where there is none."""
    at = [F.regexp_extract(name, DATE, k) for k in (1, 2, 3)]
    return F.when(name.rlike(DATE), F.concat_ws("-", at[0], F.lpad(at[1], 2, "0"), F.lpad(at[2], 2, "0")))


def index(names: DataFrame, root: str, title: str, name: str = "name") -> DataFrame:
    """(date, filename, label, path) of dated JSON files as they lie in their folders; index_document has them newest first."""
    date = padded_date(F.col(name))
    kept = names.where(F.lower(name).endswith(".json") & date.isNotNull()).select(F.col(name).alias("filename"), date.alias("date")).distinct()
    return kept.select("date", "filename", F.concat(F.lit(f"{title} — "), "date").alias("label"), F.concat(F.lit(f"/{root}/"), "date", F.lit("/"), "filename").alias("path"))


def index_document(entries: DataFrame) -> DataFrame:
    """One row, the JSON list of an index: newest first, files of a day by name. A row per day and file, so it fits a document."""
    newest = F.struct((-F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date"))).alias("o"), "filename", "label", "path")
    listed = F.transform(F.array_sort(F.collect_list(newest)), lambda e: F.struct(e["filename"].alias("filename"), e["label"].alias("label"), e["path"].alias("path")))
    return entries.agg(F.to_json(listed).alias("value"))


def sort_into_days(spark: SparkSession, folder: str, images: tuple[str, ...] = ("_Obs.jpg", "_Tower.jpg")) -> int:
    """Move a folder's dated JSON files, and the images of their days, into a subfolder per day; returns how many were moved.

    Images get the padded date as their name. What lies in subfolders stays, and so do files without a date and images
    of days without a JSON file; a name that is taken in the subfolder already is not overwritten. Repeating it moves nothing.
    """
    top = files(spark, folder).where(~F.regexp_replace("path", r"/[^/]+$", "").rlike(r"/\d{4}-\d{2}-\d{2}$"))
    date = padded_date(F.col("name"))
    rows = top.withColumn("date", date).where("date IS NOT NULL")
    days = rows.where(F.lower("name").endswith(".json")).select("date").distinct()
    shown = F.array(*[F.lit(s) for s in images])
    end = F.regexp_extract("name", DATE + r"(.*)$", 4)
    image = F.array_contains(shown, end) & F.col("name").rlike("^" + DATE)
    moved = rows.where(F.lower("name").endswith(".json") | image).join(days, "date", "left_semi")
    target = F.when(image, F.concat("date", end)).otherwise(F.col("name"))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = 0
    for r in moved.select("path", "date", target.alias("name")).orderBy("date", "name", F.desc("path")).toLocalIterator():
        old = fs_path(r.path)
        new = fs_path(fs_path(old.getParent(), r.date), r.name)
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(new.getParent())
        n += bool(not fs.exists(new) and fs.rename(old, new))
    return n
