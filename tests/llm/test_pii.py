import hashlib
import re

from millrace.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    d = [int(c) for c in d[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PATTERNS), (texts[r.doc_id][:200], r.spans, want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert {x for x in named.split(",") if x} <= set(r.spans.split(","))


TEXTS = [
    None, "", "a@b.c.d%e@f.g and x@@y.z, q@r.s.t.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 9.9.9.9.", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111",
    "call +1 (621) 555-4974 or +12 34 or +49 30 1234567 8 . (555) 123-4567", "é😀 +33 1 23 45 67 89 😀 me@x.org", "1" * 60_000 + " " + "a" * 60_000 + "@" + "1.2." * 1_000,
    "jane [at] example [dot] org, email: jane (at) example.org", "+1+1+1 5555555555 -0000-0000-0000-0000-", "a@b.c\n@d.e@f.g", "12 34 " * 3000, "x@y.z " * 2000 + "10.0.0.1, " * 2000,
    "0@0.0 0.0.0.0@0.0.0", "\x00   5500005555555559\x1f", "%@-.-", "card 378282246310005 version 1.2.3.4",
]


def test_awkward_texts(spark):
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int, kind string")
    check(pii.scan(docs).collect(), dict(enumerate(TEXTS)))
    twice = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    assert [r.n_email for r in pii.scan(twice).collect()] == [1, 1, 1]
    assert pii.scan(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(pii.scan(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_mask(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    got = pii.mask(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    assert len(rows) == len(TEXTS)
    assert rows[0] is None and rows[1] == ""
    assert rows[6] == "é😀 [PHONE] 😀 [EMAIL]"
    assert all(not plain(t) or "[" in t for t in rows.values())
    for i, t in enumerate(TEXTS):
        for _, a, b in plain(t):
            assert t[a:b] not in rows[i] or t.count(t[a:b]) > 1


def test_unsure_candidates_follow_the_labelers(spark):
    sure = [("write to a%d@x.org, call +1 621 555 49%02d" % (i, i)) for i in range(60)]
    wide = ["email: jane (at) example.org", "phone (555) 123-4567", "order 1234567890123456 shipped"]
    docs = spark.createDataFrame(list(enumerate(sure + wide)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.scan(docs).collect()}
    assert spans[60].startswith("email:")
    assert spans[62] == ""


def test_em_finds_the_bad_labeler():
    rows = [{"rule": 1, "gazetteer": 1, "context": 1, "shape": s, "spaced": 0, "size": 1, "count": 50} for s in (1, -1)] + [{"rule": -1, "gazetteer": -1, "context": -1, "shape": s, "spaced": 0, "size": 1, "count": 50} for s in (1, -1)]
    post, acc = pii._em(rows)
    assert [p > 0.9 for p in post] == [True, True, False, False]
    assert acc["shape"] < 0.6 < 0.9 < acc["rule"]


def test_many_matches_in_one_text(spark):
    """Positions and masks of a text with tens of thousands of matches, over several chunks of the running sums."""
    n = 20_000
    text = "é" + "".join(f"a{i}@ex.org or b [at] ex.org, " for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.scan(docs).first()
    assert got.n_email == n
    spans = [s.split(":") for s in got.spans.split(",")]
    assert sum("@" in text[int(a) : int(b)] for _, a, b in spans) == n
    masked = pii.mask(docs).first().text
    assert "@" not in masked and masked.count("[EMAIL]") == len(spans) and masked.startswith("é[EMAIL] or ")
