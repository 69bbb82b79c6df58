import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import sets
from millrace.streaming import incremental

SCHEMA = "id long, n int, s string"


def rows(rng, k, lo=0):
    return [(rng.randrange(40), lo + i, f"s{rng.randrange(99)}") for i in range(k)]


def state(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_merges_touch_only_their_buckets(spark, tmp_path):
    rng, table = random.Random(1), str(tmp_path / "t")
    seen = []
    for v in range(4):
        new = rows(rng, 60 if v == 0 else 3, 100 * v)
        seen += new
        before = {p for p in Path(table).rglob("*.parquet")} if v else set()
        assert incremental.merge(spark, table, spark.createDataFrame(new, SCHEMA), ["id"], ["n"], buckets=16) == v
        written = {p.parts[-3] for p in set(Path(table).rglob("*.parquet")) - before}
        assert v == 0 or len(written) <= 3
        want = sets.upsert(spark.createDataFrame(seen, SCHEMA), ["id"], ["n"])
        assert state(incremental.kept(spark, table, want.schema)) == state(want)
    incremental.merge(spark, table, spark.createDataFrame(seen[-3:], SCHEMA), ["id"], ["n"], version=3, buckets=16)  # a repeated batch
    assert state(incremental.kept(spark, table, want.schema)) == state(want)
    incremental.merge(spark, table, spark.createDataFrame([], SCHEMA), ["id"], ["n"], buckets=16)
    assert state(incremental.kept(spark, table, want.schema)) == state(want)


def test_a_merge_cut_short_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    first, second = spark.createDataFrame(rows(random.Random(2), 50), SCHEMA), spark.createDataFrame(rows(random.Random(3), 50, 100), SCHEMA)
    incremental.merge(spark, table, first, ["id"], ["n"], version=0)
    want = state(incremental.kept(spark, table, first.schema))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, f=type(spark).createDataFrame, **k: f(self, data, schema, **k) if schema != incremental._MANIFEST else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.merge(spark, table, second, ["id"], ["n"], version=1)
    assert state(incremental.kept(spark, table, first.schema)) == want
    incremental.merge(spark, table, second, ["id"], ["n"], version=1)
    assert state(incremental.kept(spark, table, first.schema)) == state(sets.upsert(first.union(second), ["id"], ["n"]))


def test_pulls_from_the_cursor(spark, tmp_path):
    table, asked = str(tmp_path / "t"), []
    data = [(i, f"2024-01-{1 + i // 2:02d} 12:00:00", i) for i in range(40)]

    def source(upto, extra=()):
        def get(since):
            asked.append(since)
            df = spark.createDataFrame([r for r in data if r[0] < upto] + list(extra), "id long, at string, n int").withColumn("at", F.to_timestamp("at"))
            return df if since is None else df.where(F.col("at") >= F.lit(since).cast("timestamp"))

        return get

    schema = source(1)(None).schema
    asked.clear()
    late = (99, "2024-01-09 00:00:00", 5)
    assert incremental.pull(spark, table, source(20), ["id"], ["n"], "at") == 20
    assert incremental.pull(spark, table, source(20), ["id"], ["n"], "at") == 6  # three days, two rows each
    assert incremental.pull(spark, table, source(24, [late]), ["id"], ["n"], "at") == 11
    assert asked == [None, "2024-01-08 12:00:00", "2024-01-08 12:00:00"]
    assert sorted(r.id for r in incremental.kept(spark, table, schema).collect()) == [*range(24), 99]
    assert incremental.pull(spark, str(tmp_path / "none"), lambda since: source(1)(None).limit(0), ["id"], ["n"], "at") == 0


def test_resumed_work_equals_work_done_once(spark, tmp_path):
    items = spark.createDataFrame([(i % 30, f"x{i % 30}") for i in range(40)], "id long, name string")
    log = spark.sparkContext.accumulator(0)

    def work(df):
        def run(batches):
            for b in batches:
                log.add(b.num_rows)
                yield b

        return df.distinct().where("id % 7 <> 3").mapInArrow(run, df.schema)

    fails = {"left": 4}

    def failing(df):
        if not fails["left"]:
            raise OSError("source is gone")
        fails["left"] -= 1
        return work(df)

    once = state(incremental.resumed(items, str(tmp_path / "once"), work, "id", "id long, name string", parts=8))
    assert len(once) == 30 and sum("None" in r for r in once) == 4
    done = log.value
    with pytest.raises(OSError):
        incremental.resumed(items, str(tmp_path / "c"), failing, "id", "id long, name string", parts=8)
    half = log.value - done
    assert 0 < half < done
    assert state(incremental.resumed(items, str(tmp_path / "c"), work, "id", "id long, name string", parts=8)) == once
    assert log.value == 2 * done  # nothing was worked on twice
    incremental.resumed(items, str(tmp_path / "c"), work, "id", "id long, name string", parts=8).count()
    assert log.value == 2 * done
    more = items.union(spark.createDataFrame([(501, "new")], items.schema))
    assert len(state(incremental.resumed(more, str(tmp_path / "c"), work, "id", "id long, name string", parts=8))) == 31
    assert log.value == 2 * done + 1
