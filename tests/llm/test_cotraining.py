import numpy as np

from millrace.llm import cotraining


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = cotraining.fit(docs, train)
    assert min(model.handed) > 0
    got = cotraining.score(docs, model).join(test, "doc_id").select("keep", "quality").collect()
    assert np.mean([r.keep for r in got if r.quality == 1]) > 0.97
    assert np.mean([not r.keep for r in got if r.quality == 0]) > 0.9


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    a, b = y[:, None] + rng.normal(0, 0.4, (2000, 3)), y[:, None] + rng.normal(0, 0.4, (2000, 2))
    model = cotraining.cotrain(a[:100], b[:100], y[:100], a[100:1000], b[100:1000])
    _, _, p = model.scores(a[1000:], b[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.97


def test_awkward_rows(spark):
    data = [(1, None, None, None, None), (1, "", "en", "s", 3), (None, "words | | |" * 20_000, "en", "s", -5), (4, "a b", "fr", "t", 0), (4, "a b", "fr", "t", 0)]
    docs = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for labels in ([(1, 0), (4, 1), (4, None), (None, 1)], [(1, 1)], []):
        model = cotraining.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = cotraining.score(docs, model).collect()
        assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
        left = cotraining.kept(docs, model)
        assert left.columns == docs.columns and left.count() == sum(r.keep for r in got)
    assert cotraining.score(docs.limit(0), model).count() == 0
    assert cotraining.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).views is None
