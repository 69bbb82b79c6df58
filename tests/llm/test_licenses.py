"""The scan against plain searches, texts with inserted words, and texts that only look like a license."""

import re

import pytest

from millrace.llm import licenses
from millrace.llm.license_texts import PHRASES, TEXTS


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def scanned(spark, texts):
    docs = spark.createDataFrame([(n, t, "clash", 3) for n, t in enumerate(texts)], "doc_id long, text string, label string, start int")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def plain_base(t):
    w, found = words(t), []
    for p, label in PHRASES.items():
        p = p.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = sorted(found)
    return len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


ODD = [None, "", "  ", "mit", "MIT License, mit\nlicense; GNU General Public License the apache-license. CC BY cc by", "gnu general public", "mit license " * 4000, "É mit LICENSE ü"]


def test_base_phrases_against_a_plain_search(spark):
    got = scanned(spark, ODD)
    for n, t in enumerate(ODD):
        r = got[n]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t) and r.n_words == len(words(t))


def test_parts_that_repeat_are_no_license(spark):
    got = scanned(spark, ["released under the mit released under the mit", "under the mit license under the mit license", "x released under the mit license y", " ".join(reversed(words(TEXTS["isc-text"])))])
    assert got[0].labels == "" and got[1].labels == "mit" and got[2].labels == "mit,mit-line" and got[3].labels == ""
    assert got[2].score == 1.0


@pytest.mark.parametrize("label", ["apache-notice", "gpl-notice", "bsd-text", "mit-text"])
def test_inserted_words_leave_the_label(spark, label):
    w = words(TEXTS[label])
    texts = [" ".join([*w[:i], *["zz"] * n, *w[i:]]) for i in range(0, len(w), 3) for n in (1, 3)]
    got = scanned(spark, texts)
    assert [n for n in range(len(texts)) if label not in got[n].labels.split(",")] == []


def test_a_third_of_a_text_is_not_enough(spark):
    got = scanned(spark, [" ".join(words(t)[: len(words(t)) // 3]) for t in TEXTS.values()])
    assert all(label not in got[n].labels.split(",") for n, label in enumerate(TEXTS))


def test_rows_stay_whole(spark):
    rows = [(1, "mit license"), (1, "mit license"), (1, "apache license"), (None, "cc by"), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.base_labels, r.n_base) for r in licenses.scan(docs).collect())
    assert got == sorted([("1", "mit", 1), ("1", "mit", 1), ("1", "apache", 1), ("None", "cc-by", 1), ("None", "", 0), ("2", "", 0)])
    assert licenses.scan(docs.limit(0)).count() == 0


def test_many_rows_of_one_text_vote_once(spark):
    docs = spark.createDataFrame([(None, TEXTS["isc-text"])] * 300, "doc_id long, text string")
    one = licenses.scan(docs.limit(1)).first()
    assert "isc-text" in one.labels and licenses.scan(docs).collect() == [one] * 300


def test_templates_of_ones_own(spark):
    known = licenses.templates({"house rules": "house"}, {"empty": "...", "don't": "You don't copy, you don't sell this."})
    docs = spark.createDataFrame([(1, "The House Rules: you don't copy you don't sell this")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs, known=known).collect()] == ["don't,house"]


def test_no_python_on_the_main_path(spark, sf):
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
