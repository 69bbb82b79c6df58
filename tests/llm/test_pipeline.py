import re

import corpus_pipeline
from millrace.llm import bpe
from millrace.llm.shared import stored


def test_stages_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen, at = docs, []
    for name, stage in corpus_pipeline.STAGES:
        seen = stored(stage(spark, seen, sf_dir), "test")
        rows = seen.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
        at.append({r.doc_id: r for r in rows})
        assert len(at[-1]) == len(rows)
    quality, near, clean, masked, encoded = at
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in quality for d in good) >= 0.97 * len(good)
    texts = [r.text for r in near.values()]
    assert len(set(texts)) == len(texts) and len(near) < len(quality)
    assert set(clean) < set(near) and all(clean[d].text == start[d].text for d in clean)
    assert set(masked) == set(clean)
    assert not [r for r in masked.values() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)]
    assert all(r.text == clean[d].text for d, r in masked.items() if "[" not in r.text)
    tok = bpe.loaded(bpe.default_path())
    assert all(r.ids == tok.encode(r.text) and r.n_tokens == len(r.ids) for r in encoded.values())
