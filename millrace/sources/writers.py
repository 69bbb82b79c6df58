"""Writers and text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import escape_quotes


def write_if_changed(df: DataFrame, path: str, ignore: tuple[str, ...] = ("updated",)) -> bool:
    """Write Parquet only if the rows differ from those there, some columns aside. The comparison is two counts of a hash, no collect."""
    spark, cols = df.sparkSession, sorted(c for c in df.columns if c not in ignore)
    sign = lambda x: x.select(F.xxhash64(*cols).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.parquet(path)
        if set(cols) <= set(old.columns) and sign(old) == sign(df):
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_json_lines(df: DataFrame, path: str, key: str) -> None:
    """One compact object per line, sorted by key over the whole output."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_dated_csv(df: DataFrame, path: str, date: str, place: str) -> None:
    """CSV files by date and place, blanks for missing values."""
    df.write.mode("overwrite").partitionBy(date, place).option("header", True).option("nullValue", "").csv(path)


def json_text(*cols: str) -> Column:
    """A JSON object that keeps nulls."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def geojson_line(track: Column, properties: Column) -> Column:
    """A LineString feature, lon before lat, five decimals."""
    points = F.transform(track, lambda p: F.array(F.round(p["lon"], 5), F.round(p["lat"], 5)))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def page(title: Column, date: Column, fields: dict[str, Column], body: Column) -> Column:
    """A page with front matter: title and date, then the fields that have something to say, then the body."""
    lines = [F.concat(F.lit('title: "'), escape_quotes(title), F.lit('"')), F.concat(F.lit("date: "), date)]
    lines += [F.when(F.length(F.coalesce(c, F.lit(""))) > 3, F.concat(F.lit(f"{k}: '"), escape_quotes(c), F.lit("'"))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def bibtex_record(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """A BibTeX record; fields without a value are left out."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {k} = {{"), c, F.lit("}"))) for k, c in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), F.concat_ws(",\n", key, *lines), F.lit("\n}"))


def write_records(df: DataFrame, record: str, path: str, key: str) -> None:
    """Text records one after the other, a blank line between, in order of the key over the whole output."""
    sorted_rows = df.repartitionByRange(key).sortWithinPartitions(key)
    sorted_rows.select(record).write.mode("overwrite").option("lineSep", "\n\n").text(path)
