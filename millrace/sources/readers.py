"""Readers with explicit schemas or names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_ROWS = "event_id string, start string, duration string, trip_name string, race string, first_name string, last_name string, status string"


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """Header-named rows; 'nan' is null, and with it numbers stay numbers."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "nan").option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def dated_csv(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """A folder of CSV files named by date, with date, month and day from the name. Files may differ in their columns: give a schema that has all."""
    reader = spark.read.option("header", True).option("nullValue", "nan").option("enforceSchema", False)
    rows = reader.schema(schema).csv(folder) if schema else reader.option("inferSchema", True).csv(folder)
    date = F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{1,2}-\d{1,2})", 1))
    return rows.withColumn("date", date).withColumn("month", F.month("date")).withColumn("day", F.dayofmonth("date"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, sep="\t")


def keyed_json(spark: SparkSession, path: str, value: str, field: str | None = None) -> DataFrame:
    """A JSON object that maps ids to records of type `value` (DDL) -> a row per id. `field` picks a member of the document."""
    text = spark.read.text(path, wholetext=True)
    kind = f"map<string,{value}>" if field is None else f"struct<`{field}`:map<string,{value}>>"
    parsed = F.from_json("value", kind)
    return text.select(F.explode(parsed if field is None else parsed[field]).alias("id", "__v")).select("id", "__v.*")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or no rows where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).json(path, multiLine=True) if there else spark.createDataFrame([], schema)


def published_events(doc: DataFrame) -> DataFrame:
    """Events whose participants point into an array of people -> (event, date, title, hours, race, person, name, role, status) rows."""
    people = F.col("sailors")
    rows = doc.select(people, F.explode("events").alias("e")).select("sailors", "e", F.explode_outer("e.p").alias("p"))
    who = F.get("sailors", F.col("p.i"))
    return rows.select(F.col("e.e").alias("event"), F.col("e.d").alias("date"), F.col("e.t").alias("title"), F.col("e.h").alias("hours"), (F.col("e.r") == 1).alias("race"), who["id"].alias("person"), who["n"].alias("name"), F.col("p.role").alias("role"), F.col("p.status").alias("status"))


def front_matter(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Markdown files with a leading block of key: value lines -> path, one column per key, body. Keys that a file lacks are null."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---", 1)
    lines = F.map_from_entries(F.transform(F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+\s*:")), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^['\"]|['\"]$", ""))))
    cells = [F.try_element_at("m", F.lit(k)).alias(k) for k in keys]
    return text.select("path", lines.alias("m"), F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*", "").alias("body")).select("path", *[F.when(c != "", c).alias(k) for k, c in zip(keys, cells)], "body")


def bibtex(spark: SparkSession, path: str, venue_key: str = "journal") -> DataFrame:
    """BibTeX files -> key, kind, title, venue, year, month, authors (array of struct first, last)."""

    def value(text: str, at: int) -> tuple[str, int]:
        close = {"{": "}", '"': '"'}.get(text[at])
        if close is None:
            m = re.compile(r"[^,}\s]+").match(text, at)
            return m[0], m.end()
        depth, i = 0, at + 1
        while i < len(text) and (depth or text[i] != close):
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        return re.sub(r"\s+", " ", text[at + 1 : i]).strip(), i + 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["value"]:
                for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
                    fields, at = {}, m.end()
                    while f := re.compile(r"\s*,?\s*(\w+)\s*=\s*").match(text, at):
                        fields[f[1].lower()], at = value(text, f.end())
                    names = []
                    for a in re.split(r"\s+and\s+", fields.get("author", "")):
                        last, _, first = a.partition(",") if "," in a else (a.split() or [""])[-1:] + [""] + [" ".join(a.split()[:-1])]
                        if a.strip():
                            names.append({"first": first.strip().split(" ")[0], "last": last.strip()})
                    out.append((m[2], m[1].lower(), fields.get("title"), fields.get(venue_key), fields.get("year"), fields.get("month"), names))
            yield pd.DataFrame(out, columns=["key", "kind", "title", "venue", "year", "month", "authors"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "key string, kind string, title string, venue string, year string, month string, authors array<struct<first:string,last:string>>")


def secret(name: str, file: str | None = None, must: bool = False) -> str | None:
    """A setting from the environment, else from a file; where `must` is set and neither has it, an error rather than nothing."""
    if os.environ.get(name):
        return os.environ[name]
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            return f.read().strip()
    if must:
        raise RuntimeError(f"{name} isn't set")
    return None


def settings(spark: SparkSession, path: str) -> DataFrame:
    """A settings file of `name : value` lines and one level of indented ones below a name -> (name, value) rows, inner names as outer.inner.

    Comments and list items are skipped, quotes around a value dropped; a name given twice has its last value.
    """
    lines = F.filter(F.split(F.col("value"), r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][\w-]*\s*:"))
    parts = F.transform(lines, lambda x: F.struct(x.rlike(r"^\s").alias("inner"), F.regexp_extract(x, r"^\s*([\w-]+)", 1).alias("name"), F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), r"(^|\s)#.*$", "")), r"^['\"]|['\"]$", "").alias("value")))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(parts).alias("at", "x"))
    outer = F.last(F.when(~F.col("x.inner"), F.col("x.name")), ignorenulls=True).over(W.orderBy("at"))  # one file's lines
    full = rows.select("at", F.when(F.col("x.inner"), F.concat_ws(".", outer, "x.name")).otherwise(F.col("x.name")).alias("name"), F.col("x.value").alias("value"))
    return full.where("value <> ''").groupBy("name").agg(F.max_by("value", "at").alias("value"))
