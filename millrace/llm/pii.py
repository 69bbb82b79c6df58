"""Personal data by weak supervision.

Candidates of four kinds come from wide patterns. Labelers vote on each one, for, against or
not at all: the strict rule of the kind, gazetteers (top-level domains, issuer prefixes,
calling codes, reserved networks), the words before it, and its shape and surroundings.
Expectation-maximisation over the counts of vote patterns, which number a few hundred
whatever the input, estimates how far each labeler can be trusted per kind, without labels.
A logistic classifier is then trained on the resulting posteriors with the votes and the
shape as features, and decides on every candidate. Candidates that pass the strict rule are
kept in any case. DataFrame functions only; the driver sees pattern counts.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import let, running, stored

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns. Possessive, and started only where a run starts, so that no text makes them
#: backtrack: same matches as the greedy ones, as no class holds what has to follow it.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns, for what is written so that the strict ones miss it.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: Cheap tests that a text must pass before a pattern is tried.
NEED = {"email": "[@\\[(]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}

#: Gazetteers. Two-letter top-level domains are countries' by rule; of the others these are the common generic ones.
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "xxx",
    "app", "blog", "cloud", "club", "company", "consulting", "design", "dev", "digital", "email", "engineering", "events", "finance", "fund", "global", "group", "health", "help", "host", "law", "legal", "life",
    "live", "ltd", "media", "money", "network", "news", "online", "page", "photography", "press", "services", "shop", "site", "software", "solutions", "space", "store", "studio", "support", "systems", "team", "tech",
    "technology", "today", "top", "website", "work", "world", "xyz", "zone",
)
#: issuers' first digits, as ranges of the first six, with the lengths of their numbers.
ISSUERS = (
    (400000, 499999, (13, 16, 19)), (510000, 559999, (16,)), (222100, 272099, (16,)), (340000, 349999, (15,)), (370000, 379999, (15,)), (300000, 305999, (14, 16, 17, 18, 19)), (360000, 369999, (14, 15, 16, 17, 18, 19)),
    (380000, 399999, (16, 17, 18, 19)), (601100, 601199, (16, 17, 18, 19)), (644000, 659999, (16, 17, 18, 19)), (352800, 358999, (16, 17, 18, 19)), (620000, 629999, (16, 17, 18, 19)), (500000, 509999, (13, 14, 15, 16, 17, 18, 19)), (560000, 589999, (13, 14, 15, 16, 17, 18, 19)), (630000, 639999, (16, 18, 19)), (670000, 679999, (13, 14, 15, 16, 17, 18, 19)),
)
#: Assigned country calling codes by their digits; three-digit ones as ranges of tens.
CALLING = r"^\+ ?\(?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2346][0-9]|25[0-8]|29[0179]|35[0-9]|37[0-8]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[0-38]|88[0-368]|96[0-8]|97[0-79]|99[2-68])"
#: Networks whose addresses are nobody's: this host, loopback, link-local, multicast and reserved.
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\."
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|@)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|from|client|login|adresse)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)[^\n]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|contact|telefon)[^\n]{0,12}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|doi|order|sku|serial|token|hash|part no|v)[ .:=#\"]{0,4}$"

VOTES = ("rule", "gazetteer", "context", "shape")
SPAN = "struct<kind:string,start:int,end:int,base:boolean,rule:int,gazetteer:int,context:int,shape:int,spaced:int,size:int>"


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0) if no is not None else out.otherwise(-1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum holds; up to 19 digits are looked at by the caller."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _rule(kind: str, m: Column) -> Column:
    """The strict rule's test of a match of its pattern."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        last = F.lower(F.substring_index(m, ".", -1))
        return _vote(last.isin(*TLDS) | last.rlike("^[a-z]{2}$"))
    if kind == "ip":
        return _vote(~m.rlike(RESERVED))
    if kind == "card":
        first, n, test = F.substring(_digits(m), 1, 6).cast("int"), F.length(_digits(m)), F.lit(False)
        for lo, hi, sizes in ISSUERS:
            test = test | (first.between(lo, hi) & n.isin(*sizes))
        return _vote(test)
    return _vote(m.rlike(CALLING), ~m.startswith("+"))


def _matches(text: Column, kind: str, pattern: str, strict: bool) -> Column:
    """Matches of one pattern as spans, by what lies between them; positions in code points, end exclusive."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.element_at(gaps, i + 1)) + F.length(m))
        ends = running(sizes, F.lit(0), lambda a, n: a + n)
        return let(ends, lambda e: F.filter(F.transform(found, lambda m, i: span(m, F.element_at(e, i + 1) - F.length(m), F.element_at(gaps, i + 1), F.element_at(gaps, i + 2))), lambda s: s.isNotNull()))

    def span(m: Column, at: Column, gap: Column, rest: Column) -> Column:
        end = at + F.length(m)
        before = F.substring(gap, -32, 32)  # up to the match before
        around = F.concat(F.substring(gap, -1, 1), F.lit(" "), F.substring(rest, 1, 1))
        rule = _rule(kind, m) if strict else F.lit(False)
        worth = rule if kind in ("ip",) else rule | (F.length(_digits(m)).between(13, 19) if kind == "card" else F.length(_digits(m)).between(9, 15) if kind == "phone" else F.lit(True))
        made = F.struct(
            F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), rule.alias("base"),
            (_vote(rule) if strict else F.lit(0)).alias("rule"),
            _gazetteer(kind, m).alias("gazetteer"),
            _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)).alias("context"),
            _vote(~around.rlike("[A-Za-z0-9_]")).alias("shape"),
            m.rlike("[ ().-]").cast("int").alias("spaced"),
            F.least(F.lit(3), F.floor(F.length(m) / 6)).cast("int").alias("size"),
        )
        return F.when(worth, made)

    hit = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(none))
    return F.when(text.rlike(NEED[kind]), hit).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: of those that start before a span's end, none may end after its start."""
    ends = F.transform(spans, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("k"), F.lit(-1).alias("end"), i.alias("i")))
    order = F.array_sort(F.concat(ends, F.transform(others, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("k"), s["end"].alias("end"), F.lit(-1).alias("i")))))

    def free(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: x["end"]), F.lit(-1), lambda a, e: F.greatest(a, e))
        kept = lambda x, r: F.when((x["k"] == 0) & (r <= F.get(spans, x["i"])["start"]), F.get(spans, x["i"]))
        return let(reach, lambda rs: F.filter(F.transform(xs, lambda x, i: kept(x, F.element_at(rs, i + 1))), lambda s: s.isNotNull()))

    return let(order, free)


def candidates(text: Column) -> Column:
    """All candidates of a text as an array of spans with votes. Null counts as empty."""

    def of(t: Column) -> Column:
        strict = F.concat(*[_matches(t, k, STRICT[k], True) for k in KINDS])

        def and_wide(own: Column) -> Column:
            wide = F.concat(*[_matches(t, k, p, False) for k, p in WIDE.items()])
            return let(wide, lambda ws: F.when(F.size(ws) > 0, F.concat(own, _apart(ws, F.filter(own, lambda s: s["base"])))).otherwise(own))

        return let(strict, and_wide)

    return let(F.coalesce(text, F.lit("")), of)


class Model(NamedTuple):
    """Per kind: the classifier's bias and weights by feature; the labelers' estimated accuracies."""

    weights: dict[str, dict[str, float]]
    accuracy: dict[str, dict[str, float]]


_FEATURES = [*VOTES, "spaced", "size"]
#: What the classifier falls back to where a kind has no candidates: the strict rule, and agreement of the rest.
_PRIOR = {"bias": -1.0, "rule": 3.0, "gazetteer": 1.0, "context": 2.0, "shape": 0.5, "spaced": 0.0, "size": 0.0}


def _em(rows: list, rounds: int = 40) -> tuple[list[float], dict[str, float]]:
    """Posterior of each vote pattern, and each labeler's accuracy where it votes. rows: patterns with `count`."""
    acc = {v: 0.9 if v == "rule" else 0.7 for v in VOTES}
    prior, post = 0.5, []
    for _ in range(rounds):
        post = []
        for r in rows:
            yes, no = math.log(prior), math.log(1 - prior)
            for v in VOTES:
                if r[v]:
                    a, b = math.log(acc[v]), math.log(1 - acc[v])
                    yes, no = (yes + a, no + b) if r[v] > 0 else (yes + b, no + a)
            post.append(1 / (1 + math.exp(min(50.0, no - yes))))
        total = sum(r["count"] for r in rows)
        prior = min(0.99, max(0.01, (1 + sum(p * r["count"] for p, r in zip(post, rows))) / (2 + total)))
        for v in VOTES:
            cast = [(r["count"], p if r[v] > 0 else 1 - p) for p, r in zip(post, rows) if r[v]]
            # smoothed towards a labeler that is right more often than not, and never below chance: that fixes which class is which
            acc[v] = min(0.99, max(0.55, (7 + sum(n * p for n, p in cast)) / (10 + sum(n for n, _ in cast))))
    return post, acc


def _logistic(rows: list, target: list[float], rounds: int = 400, rate: float = 0.5, ridge: float = 0.01) -> dict[str, float]:
    """Weights that reproduce soft targets, by gradient descent over patterns weighted by the logarithm of their counts."""
    w = dict.fromkeys(["bias", *_FEATURES], 0.0)
    weight = [math.log1p(r["count"]) for r in rows]
    total = sum(weight)
    for _ in range(rounds):
        grad = {f: ridge * v for f, v in w.items()}
        for r, t, n in zip(rows, target, weight):
            x = {"bias": 1.0} | {f: float(r[f]) for f in _FEATURES}
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[f] * x[f] for f in x)))))
            for f in x:
                grad[f] += n / total * (p - t) * x[f]
        for f in w:
            w[f] -= rate * grad[f]
    return w


def fit(found: DataFrame, spans_col: str = "spans") -> Model:
    """Labelers' reliabilities and the span classifier, from the counts of all candidates' patterns."""
    flat = found.select(F.explode(spans_col).alias("s")).select("s.kind", *[f"s.{f}" for f in _FEATURES])
    patterns = flat.groupBy("kind", *_FEATURES).agg(F.count("*").alias("count")).orderBy("kind", *_FEATURES).collect()  # at most 4 * 3^4 * 2 * 4 rows
    weights, accuracy = {}, {}
    for kind in KINDS:
        rows = [r.asDict() for r in patterns if r.kind == kind]
        if rows:
            post, accuracy[kind] = _em(rows)
            weights[kind] = _logistic(rows, post)
        else:
            weights[kind], accuracy[kind] = dict(_PRIOR), {}
    return Model(weights, accuracy)


def _accepted(spans: Column, model: Model) -> Column:
    def ok(s: Column) -> Column:
        test = s["base"]
        for kind in KINDS:
            w = model.weights[kind]
            score = F.lit(float(w["bias"]))
            for f in _FEATURES:
                score = score + F.lit(float(w[f])) * s[f]
            test = test | ((s["kind"] == kind) & (score > 0))
        return test

    return F.filter(spans, ok)


def _listed(spans: Column) -> Column:
    """kind:start:end of each, by kind as listed, then start."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("k"), s["start"].alias("a"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs.

    The counts and the digest are those of the strict rules; spans lists these and what the classifier
    adds. Null and empty texts have none. The candidates of a text stay in its row, texts never move,
    and repeated rows come back as often as they came. Without a model one is fitted on all of docs.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), candidates(F.col(text_col)).alias("spans")), "pii")
    model = model or fit(rows)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(_accepted(F.col("spans"), model)).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, as [EMAIL]. Overlapping spans go under the first's kind.

    All rows and columns stay, null texts too; a text without spans is unchanged. Without a model one is fitted on all of docs.
    """
    if model is None:
        model = fit(stored(docs.select(candidates(F.col(text_col)).alias("spans")).where(F.size("spans") > 0), "pii-fit"))

    def masked(text: Column, spans: Column) -> Column:
        size = 4096
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("e"), s["kind"].alias("kind"))))

        def made(xs: Column, chunks: Column, ends: Column) -> Column:
            def piece(a: Column, e: Column) -> Column:  # by chunks, so that no piece is sought from the text's start
                lo, hi = F.floor(a / size).cast("int"), F.floor(e / size).cast("int")
                return F.substring(F.array_join(F.slice(chunks, lo + 1, hi - lo + 1), ""), a % size + 1, e - a)

            before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))
            parts = F.transform(xs, lambda s, i: F.when(s["a"] >= before(i), F.concat(piece(before(i), s["a"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(parts, ""), piece(F.element_at(ends, -1), F.length(text)))

        cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        ends = lambda xs: running(F.transform(xs, lambda s: s["e"]), F.lit(0), lambda a, e: F.greatest(a, e))
        return let(order, lambda xs: let(cut, lambda chunks: let(ends(xs), lambda es: made(xs, chunks, es))))

    found = let(_accepted(candidates(F.col(text_col)), model), lambda s: F.when(F.size(s) > 0, masked(F.col(text_col), s)).otherwise(F.col(text_col)))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), found))
