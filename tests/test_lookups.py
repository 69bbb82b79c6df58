"""Lookups, orders with places, records and small readers against plain versions."""

import json
import random

from pyspark.sql import functions as F

from millrace.functions import cv, text
from millrace.operators import clusters, evaluation, lookups, ordering, series
from millrace.sources import readers, writers


def test_items_by_place(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("a", -1), ("a", None), ("b", 0), (None, 0), ("c", 0), ("a", 0)], "key string, at int")
    docs = spark.createDataFrame([("a", ["x", None, "z"]), ("b", []), ("c", None)], "key string, listed array<string>")
    got = sorted(((r.key, r.at, r.item) for r in lookups.item_at(rows, docs, "key", "listed", F.col("at")).collect()), key=repr)
    assert got == sorted([("a", 0, "x"), ("a", 2, "z"), ("a", 3, None), ("a", -1, None), ("a", None, None), ("b", 0, None), (None, 0, None), ("c", 0, None), ("a", 0, "x")], key=repr)
    assert lookups.item_at(rows.limit(0), docs, "key", "listed", F.col("at")).count() == 0


def test_named_row_or_totals(spark):
    rows = spark.createDataFrame([("n", 2, 1.5), ("s", 3, None)], "name string, trails long, miles double")
    find = lambda df, wanted: [tuple(r) for r in lookups.named(df, "name", wanted, ["trails", "miles"]).collect()]
    assert find(rows, "n") == [("n", 2, 1.5)]
    assert find(rows, "all") == [("all", 5, 1.5)]
    assert find(rows, "x") == []
    assert find(rows.limit(0), "all") == [("all", 0, 0.0)]


def test_places_over_many_ranges(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([1, 1, 1, 2, 5, None])) for i in range(2000)]
    rows = spark.createDataFrame(data, "seed long, size int").repartition(7)
    got = {r.place: (r.size, r.seed) for r in ordering.by_size(rows, "size", "seed").collect()}
    plain = sorted(data, key=lambda x: (-(x[1] or 0), x[0]))
    assert [got[k + 1] for k in range(len(data))] == [(n, i) for i, n in plain]
    assert ordering.by_size(rows.limit(0), "size", "seed").count() == 0


def test_coverage_and_tags_in_order(spark):
    rows = spark.createDataFrame([("b", 50.0, 3.0), ("a", 50.0, 3.0), ("c", 50.0, 4.0), ("d", 100.0, 0.1), ("e", 0.0, 9.0)], "name string, pct double, miles double")
    assert [r.name for r in ordering.by_coverage(rows, "pct", "miles", "name").orderBy("place").collect()] == ["d", "c", "a", "b", "e"]
    listed = spark.createDataFrame([(["b", "B", "a", ""],), (["b", "C"],), (None,), ([],)], "t array<string>")
    assert [r.tag for r in ordering.tags(listed, F.col("t")).orderBy("place").collect()] == ["a", "B", "b", "C"]


def test_entries_sorted_by_key(spark):
    rows = spark.createDataFrame([(1, {"2021-b": "x", "2020-a": "y"}), (2, {}), (3, None)], "id int, m map<string,string>")
    got = {r.id: [tuple(e) for e in r.e] for r in rows.select("id", ordering.by_key(F.col("m")).alias("e")).collect()}
    assert got == {1: [("2020-a", "y"), ("2021-b", "x")], 2: [], 3: []}


def test_author_profile(spark):
    rows = spark.createDataFrame([(1, "me", "", "Here", "Likes maps"), (2, None, "https://s/1", "", None), (3, "", None, "There", "")], "id int, github string, scholar string, employer string, bio string")
    links = {"Google Scholar": (F.col("scholar"), "", False), "GitHub": (F.col("github"), "https://github.com/", True)}
    got = {r.id: (r.s, [tuple(p) for p in r.p]) for r in rows.select("id", cv.summary(F.col("employer"), F.col("bio")).alias("s"), cv.profiles(links).alias("p")).collect()}
    assert got == {
        1: ("Currently employed at Here. Likes maps", [("GitHub", "me", "https://github.com/me")]),
        2: ("", [("Google Scholar", "", "https://s/1")]),
        3: ("Currently employed at There", []),
    }


def test_mapped_series(spark):
    rows = spark.createDataFrame([("t", [0.0, None, 10.0]), ("u", None)], "k string, y array<double>")
    got = {r.k: r.y for r in series.mapped(rows, lambda v: v * 9 / 5 + 32).collect()}
    assert got == {"t": [32.0, None, 50.0], "u": None}
    assert series.mapped(rows, None) is rows


def test_settings_of_two_levels(spark, tmp_path):
    (tmp_path / "c.yml").write_text('# head\nname: "A B"\nurl : https://x.y/z  # home\nempty:\nauthor:\n  name   : \'Q\'\n  bio: "a: b"\n  links:\nplugins:\n  - one\nname: "C"\n')
    got = {r.name: r.value for r in readers.settings(spark, str(tmp_path / "c.yml")).collect()}
    assert got == {"name": "C", "url": "https://x.y/z", "author.name": "Q", "author.bio": "a: b"}


def test_records_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("k2", "Second {T}", "2020"), ("k1", "First", None), ("k3", "", "2021")], "key string, title string, year string")
    record = writers.bibtex_record(F.lit("article"), F.col("key"), {"title": F.col("title"), "year": F.col("year")})
    path = str(tmp_path / "bib")
    writers.write_records(rows.withColumn("record", record), "record", path, "key")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "bib").glob("part-*")))
    assert whole == "@article{k1,\n  title = {First}\n}\n\n@article{k2,\n  title = {Second {T}},\n  year = {2020}\n}\n\n@article{k3,\n  year = {2021}\n}\n\n"
    got = {(r.key, r.kind, r.title, r.year) for r in readers.bibtex(spark, path).collect()}
    assert got == {("k1", "article", "First", None), ("k2", "article", "Second {T}", "2020"), ("k3", "article", None, "2021")}


def test_published_events_are_taken_apart(spark, tmp_path):
    doc = {"sailors": [{"id": "s0", "n": "Ann"}, {"id": "s1", "n": "Bob"}], "events": [{"e": "e1", "d": "2024-05-01", "t": "Cup", "h": 2.5, "r": 1, "p": [{"i": 1, "role": "lead", "status": "done"}, {"i": 0, "role": "crew", "status": "out"}, {"i": 7, "role": "crew", "status": "out"}]}, {"e": "e2", "d": "2024-06-01", "t": "Trip", "h": 1.0, "r": 0, "p": []}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    schema = "sailors array<struct<id:string,n:string>>, events array<struct<e:string,d:string,t:string,h:double,r:int,p:array<struct<i:int,role:string,status:string>>>>"
    got = {tuple(r) for r in readers.published_events(spark.read.schema(schema).json(str(tmp_path / "d.json"), multiLine=True)).collect()}
    assert got == {
        ("e1", "2024-05-01", "Cup", 2.5, True, "s1", "Bob", "lead", "done"),
        ("e1", "2024-05-01", "Cup", 2.5, True, "s0", "Ann", "crew", "out"),
        ("e1", "2024-05-01", "Cup", 2.5, True, None, None, "crew", "out"),
        ("e2", "2024-06-01", "Trip", 1.0, False, None, None, None, None),
    }


def test_compact_json_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None, 'q"'), (2, [1, None], None)], "a int, b array<int>, c string")
    assert [r.j for r in rows.orderBy("a").select(writers.json_text("a", "b", "c").alias("j")).collect()] == ['{"a":1,"b":null,"c":"q\\""}', '{"a":2,"b":[1,null],"c":null}']


def test_level_labels(spark):
    rows = spark.createDataFrame([(925, 762.0)], "p int, m double")
    metric, imperial = (text.level_label(F.col("p"), F.col("m"), F.lit("rap"), i) for i in (False, True))
    assert rows.select(metric, imperial).first() == ("925mb (~762m)<br>(rap)", "925mb (~2500ft)<br>(rap)")


def test_headings(spark):
    rows = [(0.4, 1.0, 0.5), (-0.4, 1.0, 0.5), (1.0, 2.0, 0.5), (1.0, -2.0, 0.5), (-1.0, 2.0, 0.02), (-3.0, -1.0, 0.9), (1.0, 1.0, 0.01), (-1.0, 1.0, 0.0), (0.5, 1.0, 0.3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, laps double, area double, circ double")
    got = [r.h for r in df.orderBy("i").select("i", clusters.heading(F.col("laps"), F.col("area"), F.col("circ")).alias("h")).collect()]
    assert got == ["unknown", "unknown", "ccw", "cw", "cw", "ccw", "forward", "reverse", "ccw"]


def test_youden_threshold(spark):
    rng = random.Random(4)
    data = [(round(min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2))), 3), y) for y in (0, 1) for _ in range(200)]
    swept = evaluation.sweep(spark.createDataFrame(data, "score double, label int"), "score", "label", 0.05, 0.95, 19)
    best = evaluation.youden(swept).first()

    def j(t):
        rate = lambda y: sum(s >= t for s, v in data if v == y) / sum(v == y for _, v in data)
        return rate(1) - rate(0)

    ts = [r.threshold for r in swept.collect()]
    assert abs(best.j - max(map(j, ts))) < 1e-9 and abs(j(best.threshold) - best.j) < 1e-9
