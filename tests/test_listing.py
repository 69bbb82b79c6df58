import datetime
import json
import re

from pyspark.sql import functions as F

from millrace.functions import cv
from millrace.sources import listing


def test_first_variant_that_exists_and_parses(spark, tmp_path):
    texts = {"w_2024-03-07.json": '{"v": 1}', "w_2024-03-8.json": '{"v": 2}', "w_2024-03-09.json": "broken {", "w_2024-03-9.json": '{"v": 3}', "w_2024-03-11.json": "[]", "plain.json": '{"v": 4}', "w_2024-03-05.json": '{"v": 5}', "w_2024-03-5.json": '{"v": 6}', "w_2024-03-06.json": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    wanted = ["w_2024-03-7.json", "w_2024-03-08.json", "w_2024-03-09.json", "w_2024-03-11.json", "plain.json", "none.json", "w_2024-03-05.json", "w_2024-03-5.json", "w_2024-03-06.json"]
    items = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)] + [(0, wanted[0])], "id int, path string")
    got = {r.id: (r.used, r.place, r.doc and r.doc.v) for r in listing.with_fallback(spark, items, str(tmp_path), "v int", "id", "path").collect()}
    assert got == {0: ("w_2024-03-07.json", 1, 1), 1: ("w_2024-03-8.json", 1, 2), 2: ("w_2024-03-9.json", 1, 3), 3: (None, None, None), 4: ("plain.json", 0, 4), 5: (None, None, None), 6: ("w_2024-03-05.json", 0, 5), 7: ("w_2024-03-5.json", 0, 6), 8: (None, None, None)}


def test_aliases_in_order(spark):
    items = spark.createDataFrame([("gust", ["10 m", "surface"]), ("wind", ["10 m"]), ("rain", []), ("snow", ["x", "surface"])], "variable string, aliases array<string>")
    found = spark.createDataFrame([("surface", 5.0), ("surface", 4.0), ("y", 1.0)], "name string, v double")
    got = {r.variable: (r.used, r.place, r.v) for r in listing.resolved(items, found, "variable", "aliases").collect()}
    assert got == {"gust": ("surface", 1, 4.0), "wind": (None, None, None), "rain": (None, None, None), "snow": ("surface", 1, 4.0)}


def test_files_are_sorted_into_days_and_listed_newest_first(spark, tmp_path):
    for name in ("a_2024-03-7.json", "b_2024-12-01.json", "c_2024-03-07.json", "2024-3-7_Obs.jpg", "2024-12-01_Tower.jpg", "2024-01-01_Obs.jpg", "notes.json", "2024-03-07_Other.jpg"):
        (tmp_path / name).write_text(name)
    assert listing.files(spark, str(tmp_path)).where("length > 0").count() == 8
    assert listing.sort_into_days(spark, str(tmp_path)) == 5
    assert listing.sort_into_days(spark, str(tmp_path)) == 0
    left = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert left == sorted(["2024-03-07/a_2024-03-7.json", "2024-03-07/c_2024-03-07.json", "2024-03-07/2024-03-07_Obs.jpg", "2024-12-01/b_2024-12-01.json", "2024-12-01/2024-12-01_Tower.jpg", "2024-01-01_Obs.jpg", "notes.json", "2024-03-07_Other.jpg"])
    assert (tmp_path / "2024-03-07/2024-03-07_Obs.jpg").read_text() == "2024-3-7_Obs.jpg"
    doc = json.loads(listing.index_document(listing.index(listing.files(spark, str(tmp_path)), "examples", "Mt")).first().value)
    assert [e["filename"] for e in doc] == ["b_2024-12-01.json", "a_2024-03-7.json", "c_2024-03-07.json"]
    assert doc[0] == {"filename": "b_2024-12-01.json", "label": "Mt — 2024-12-01", "path": "/examples/2024-12-01/b_2024-12-01.json"}
    assert listing.index_document(listing.index(listing.files(spark, str(tmp_path)).limit(0), "x", "y")).first().value == "[]"


SCHOOL = "* BSc Physics, MIT, 1999 with honours, GPA: 3.9\n* no year, here\n* PhD Maths , ETH Zürich, 2004\n  thesis, GPA: 1.0\n* x"
JOBS = "* Engineer, Acme, Berlin\n  2001 - Present\n  - built it\n  * sold it\n  plain line\n* Lead, Beta\n* Nobody\n* Chef, Café, 1990-1999"
SKILLS = "Languages: English, French\nTools and more:  hammer,\n saw , \nEmpty:\nLast: one"


def test_cv_entries_and_document(spark):
    one = spark.createDataFrame([(SCHOOL, JOBS, SKILLS, datetime.date(2024, 2, 3)), (None, "", None, None)], "a string, b string, c string, d date")
    made = one.select(cv.education(F.col("a")).alias("education"), cv.work(F.col("b")).alias("work"), cv.skills(F.col("c")).alias("skills"), cv.cv_json(education=cv.education(F.col("a")), updated=F.col("d")).alias("doc"))
    first, second = made.collect()
    assert [tuple(e) for e in first.education] == [("BSc Physics", "MIT", "1999", "3.9"), ("PhD Maths", "ETH Zürich", "2004", None)]
    assert [tuple(e) for e in first.work] == [("Engineer", "Acme", "2001", "Present", ["built it", "sold it"]), ("Lead", "Beta", "", "", []), ("Chef", "Café", "1990", "1999", [])]
    plain = [(n.strip(), [w.strip() for w in re.split(r",|\n", s) if w.strip()]) for n, s in re.findall(r"(?:^|\n)(\w+.*?):\s*(.*?)(?=\n\w+.*?:|\Z)", SKILLS, re.DOTALL)]
    assert [tuple(e) for e in first.skills] == plain
    assert (second.education, second.work, second.skills) == ([], [], [])
    assert json.loads(first.doc)["updated"] == "2024-02-03" and json.loads(first.doc)["education"][1]["grade"] is None
    assert json.loads(second.doc) == {"education": [], "updated": None}
