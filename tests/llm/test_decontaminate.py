import re

import pytest

from millrace.llm import decontaminate
from millrace.llm.shared import bitmap_longs


def words(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, n=10):
    grams = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                if g in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[g] - {None}
        out.append((str(d), len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit)))
    return sorted(out)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from it all"), (2, "short item"), (3, None), (4, "..."), (10, "É a B a b a b a b a b a b a"), (2, "other text of the same item"), (None, "nobody owns this"), (5, "short ITEM!")]
DOCS = [
    (1, "x the Quick, brown fox jumps over the lazy dog and runs home"),
    (1, "x the Quick, brown fox jumps over the lazy dog and runs home"),
    (2, None),
    (3, ""),
    (4, "A short item, a SHORT-ITEM and nobody owns this."),
    (None, "é a b a b a b a b a b a b a b É a b a b a b a b a b"),
    (5, "clean words only " * 5000 + "short item"),
    (6, "the quick brown fox jumps over the lazy dog"),
    (7, "$%& \n"),
]


@pytest.mark.parametrize("max_bytes", [64 << 20, 200])
def test_against_brute_force(spark, max_bytes):
    docs = spark.createDataFrame([(*d, 1, "y") for d in DOCS], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, gram int")
    got = decontaminate.scan(docs, items, max_bytes=max_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == plain(DOCS, ITEMS)
    left = decontaminate.clean(docs, items, max_bytes=max_bytes)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "6", "7"]


@pytest.mark.parametrize("max_bytes", [64 << 20, 200])
def test_empty_tables(spark, max_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs.limit(0), items, max_bytes=max_bytes).count() == 0
    assert decontaminate.clean(docs.limit(0), items, max_bytes=max_bytes).count() == 0
    assert decontaminate.clean(docs, items.limit(0), max_bytes=max_bytes).count() == len(DOCS)
    if max_bytes > 200:
        assert {r.n_hit for r in decontaminate.scan(docs, items.limit(0)).collect()} == {0}


def test_whole_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontaminate.scan(docs, items).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == want
    assert decontaminate.clean(docs, items).count() == sum(not w[5] for w in want)


@pytest.mark.parametrize("max_bytes", [64 << 20, 200])
def test_a_window_of_many_items(spark, max_bytes):
    """2,000 items share a window: all are listed, and none is in the broadcast."""
    items = spark.createDataFrame([(i, f"one shared window of words {i % 3}") for i in range(2000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "so one shared window of words 1 again") for i in range(50)] + [(None, "one shared window of words 2"), (99, "one shared window")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"][:2]) for r in decontaminate.scan(docs, items, max_bytes=max_bytes).collect()}
    assert got == {**{i: (6, 667, ["1", "10"]) for i in range(50)}, None: (6, 666, ["1001", "1004"]), 99: (0, 0, [])}


def test_bitmaps_grow_with_the_windows():
    assert [bitmap_longs(n) for n in (0, 65_535, 65_536, 300_000, 1 << 30)] == [1 << 14, 1 << 14, 1 << 15, 1 << 17, 1 << 17]


def test_a_grown_bitmap_misses_nothing(spark):
    """70,000 windows, so that the bitmap is twice its least size; each of them is found."""
    items = spark.range(70_000).selectExpr("id as item_id", "concat('item number ', id) as text")
    docs = spark.range(0, 70_000, 7).selectExpr("id as doc_id", "concat('here item number ', id, ' there') as text")
    got = decontaminate.scan(docs, items)
    assert got.where("n_hit = 3 and n_items = 1 and items[0] = cast(doc_id as string)").count() == 10_000
