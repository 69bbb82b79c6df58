"""The audit against a plain walk over two replicas, and its odd cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle_audit as m

COLS = "archive string, offset long, length long, copies long, key long, sha256 string"


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def laid(archive, bodies):
    """bodies: (key, body, length) in file order -> manifest rows."""
    out, at = [], 0
    for key, body, length in bodies:
        out.append((archive, at, length, 1, key, sha(body)))
        at += length
    return out


def run(spark, ours, theirs, **kw):
    roots, damage = m.audit(spark.createDataFrame(ours, COLS), spark.createDataFrame(theirs, COLS), **kw)
    return {r.archive: r for r in roots.collect()}, sorted((d.archive, d.kind, d.key, d.offset) for d in damage.collect())


def test_only_damaged_records_are_named(spark):
    bodies = [(k, f"b{k}", 100 + k) for k in range(400)]
    bad = [(k, "x" if k in (17, 333) else b, n) for k, b, n in bodies]
    roots, damage = run(spark, laid("a", bodies) + laid("b", bodies), laid("a", bad) + laid("b", bodies), widths=(1024, 8192))
    assert roots["b"].same and not roots["a"].same
    at = {r[4]: r[1] for r in laid("a", bodies)}
    assert damage == [("a", "changed", k, at[k]) for k in (17, 333)]


def test_shifted_records_are_moved(spark):
    bodies = [(k, f"b{k}", 50) for k in range(100)]
    cut = [(k, "cut" if k == 40 else b, 49 if k == 40 else n) for k, b, n in bodies if k != 60]
    _, damage = run(spark, laid("a", bodies), laid("a", cut), widths=(200, 1000))
    kinds = {k: [d[2] for d in damage if d[1] == k] for k in ("changed", "missing", "moved", "extra")}
    assert kinds["changed"] == [40] and kinds["missing"] == [60] and kinds["extra"] == []
    assert kinds["moved"] == [k for k in range(41, 100) if k != 60]


def test_missing_archive_extra_records_repeated_and_null_keys(spark):
    ours = laid("a", [(1, "x", 10), (1, "y", 10), (None, "z", 10)]) + laid("gone", [(9, "q", 5)])
    theirs = laid("a", [(1, "x", 10), (1, "w", 10), (None, "z", 10), (2, "new", 3)]) + laid("more", [(8, "r", 5)])
    roots, damage = run(spark, ours, theirs)
    assert roots["gone"].root_theirs is None and roots["more"].root_ours is None
    assert damage == [("a", "changed", 1, 10), ("a", "extra", 2, 30), ("gone", "missing", 9, 0), ("more", "extra", 8, 0)]


def test_empty_manifests(spark):
    assert run(spark, [], []) == ({}, [])
    empty = spark.createDataFrame([], COLS)
    assert m.report(empty, empty).count() == 0
    roots, damage = run(spark, laid("a", [(1, "x", 10)]), [])
    assert not roots["a"].same and [d[1] for d in damage] == ["missing"]


def test_no_archive_is_crowded_and_offsets_are_own(spark):
    rows = [(7, n, sha(n)) for n in range(1, 301)] + [(None, 5, sha(n)) for n in range(50)] + [(8, 4, sha("same"))] * 30
    records = spark.createDataFrame(rows, "key long, length long, sha256 string")
    a = m.archives(records, per_archive=4, per_shard=64).withColumn("offset", m.offsets(F.col("length"), "key", "sha256"))
    got = a.collect()
    assert len(got) == 300 + 50 + 1 and {r.copies for r in got if r.key == 8} == {30}
    by = {}
    for r in got:
        by.setdefault(r.archive, []).append(r)
    assert max(map(len, by.values())) <= 2 * 64
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0
        assert all(y.offset == x.offset + x.length * x.copies for x, y in zip(own, own[1:]))


def test_pages_with_nulls_repeats_and_long_bodies(spark):
    rows = [(7, "http://a", "x"), (7, "http://a", "x"), (None, None, None), (8, "u", ""), (9, None, "é" * 300_000), (5, "u", "lost"), (11, "u", "cut")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, archive string")
    got = {r.archive: r for r in m.report(*m.page_replicas(pages)).collect()}
    assert sum(r.n_records for r in got.values()) == len(rows)
    assert got["k0"].n_damaged == 3 and [d.rsplit(":", 1)[0] for d in got["k0"].damaged.split(",")] == ["missing:5", "changed:7", "changed:11"]
    assert got["k0"].n_moved == 2  # 8 and 9 stand before no damage but the lost page
    assert all(r.n_damaged == 0 for a, r in got.items() if a != "k0")


def test_plan_stays_small(spark, sf):
    df = m.report(*m.page_replicas(spark.read.parquet(f"{sf}/pages.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") + plan.count("BroadcastExchange") < 30


@pytest.mark.parametrize("side", ["ours", "theirs"])
def test_roots_depend_on_every_record(spark, side):
    base = laid("a", [(k, k, 10) for k in range(30)])
    other = [(*r[:5], sha("!")) if r[4] == 29 else r for r in base]
    roots, _ = run(spark, *((other, base) if side == "ours" else (base, other)))
    assert not roots["a"].same
