import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    """The contract, token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(7)
    parts = ["a", "Bc", "é", "日本", "😀", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", " ", " ", "<", ">", "<P", "S>", "M>", "<S"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]


def key(row):
    return tuple(str(v) for v in row)


def test_against_plain_tokens_and_round_trip(spark):
    long = " ".join(random.Random(1).choices(["a", "bé", "日"], k=200_000))
    data = [*enumerate(texts()), (1000, None), (1001, ""), (1002, " \n"), (1003, "x <P> y"), (1004, "x<M>y"), (None, "no id here"), (None, None), (7, "twice"), (7, "twice"), (1005, long), (1006, "w" * 300_000)]
    docs = spark.createDataFrame([(d, t, 1, "old") for d, t in data], "doc_id long, text string, n int, output string")
    for rate, spm in ((50, 80), (100, 0), (100, 100), (0, 80)):
        made = fim.transform(docs, rate=rate, spm_rate=spm)
        assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
        rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(map(key, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows))) == sorted(map(key, (plain(d, t, 42, rate, spm) for d, t in data)))
        assert all(r.back == (r.text or "") for r in rows)
    assert fim.transform(docs.limit(0)).count() == 0


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", None, [1, 2])], "doc_id long, text string, lang string, ids array<int>")
    made = fim.transform(docs, seed=3)
    assert made.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.first().ids == [1, 2]


def test_whole_table_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(d, n, f, p, m, sha(o), sha(r.text or "")) for r in docs.collect() for d, n, f, p, m, o in [plain(r.doc_id, r.text)]]
    assert sorted(map(key, map(tuple, fim.digests(docs).collect()))) == sorted(map(key, want))


def test_empty_pieces():
    """Ranks may fall together and at either end."""
    assert {fim.transformed("a b", d, rate=100)[2:4] for d in range(400)} == {(0, 0), (0, 1), (0, 3), (1, 0), (1, 2), (3, 0)}
