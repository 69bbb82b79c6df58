import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = bpe.default_path()
LIB = Tokenizer.from_file(PATH)
OWN = bpe.PieceBpe(PATH, leaf=16)


def same(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIB.decode(ids, skip_special_tokens=False)
    assert " ".join(OWN.coded(text)[1]) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehinorstéñ'</w>!., \n\x1c ́Σσİ|<>12", max_size=120))
def test_likely_text(text):
    same(text)


@pytest.mark.parametrize("letters", ["a", "ab", "theing", "abcdefghijklmnopqrstuvwxyz", "éèñß", "!%*#", "日本語"])
def test_long_runs_join_as_the_library_encodes(letters):
    rng = random.Random(3)
    for n in (15, 16, 17, 31, 33, 64, 257, 1000, 5000):
        same("".join(rng.choices(letters, k=n)))
        same("x " + "".join(rng.choices(letters, k=n)) + " y's")


def test_special_tokens_and_odd_blanks():
    for t in ("", "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|> c", "<|endoftext|", "It's we'LL I'd", "\x85a b　c\x1cd\x0be", "ΑΣ ΣΑΣ", "a﻿b­c​d"):
        same(t)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "ids")
    got = bpe.digests(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        e = LIB.encode(texts[r.doc_id], add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(spark):
    data = [(1, None), (1, None), (None, ""), (2, "ab" * 200_000), (3, "x" * 50 + " é")]
    docs = spark.createDataFrame([(*r, "z") for r in data], "doc_id long, text string, decoded string")
    got = bpe.encode(docs)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(d), LIB.encode(t or "", add_special_tokens=False).ids) for d, t in data)
    back = bpe.decode(got.select("doc_id", "ids")).collect()
    assert all(r.decoded == LIB.decode(r.ids, skip_special_tokens=False) for r in back)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_documents_come_through_the_tree(sf, spark):
    """Most documents are longer than a leaf; their parts join at seams inside runs too, and the ids stay the library's."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bpe_ = bpe.PieceBpe(PATH)
    joined = 0
    for t in texts:
        before = bpe_.seams
        assert bpe_.encode(t) == LIB.encode(t or "", add_special_tokens=False).ids
        joined += bpe_.seams > before
        assert bpe_.seams - before == max(0, -(-len(t or "") // bpe_.leaf) - 1)
    assert joined > 0.3 * len(texts)
    assert bpe_.windows > 1.3 * bpe_.seams  # many seams fall inside a run and need a wider window


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the ", " ", "'s", "'", "re", "\n", "é", "é", "ñ", "!", "12", "\u3000", "日本", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", "İ", "Σ"]), max_size=60), st.integers(1, 9))
def test_any_seam(parts, leaf):
    text, own = "".join(parts), bpe.PieceBpe.__new__(bpe.PieceBpe)
    own.__dict__ = OWN.__dict__ | {"leaf": leaf, "seen": {}, "older": {}}
    assert own.encode(text) == LIB.encode(text, add_special_tokens=False).ids
