"""MinHash near-duplicates with sequential Bayesian verification.

Each different shingle set is one node, however many documents have it. Its signature holds the least
value of the set under each of 1,024 hash functions; bands of four of them name buckets, and sets of
similarity 0.8 share none of 40 buckets in fewer than one case in a billion.

Candidates are judged batch by batch of the signature. After k comparisons with m matches the
similarity has the posterior Beta(m + 1, k - m + 1); once the chance that it reaches the threshold falls
below the chosen miss probability, the pair is dropped and later batches aren't compared. What is
left at the end is confirmed on whole sets, made again from their texts.

A crowded bucket never becomes all its pairs: first each member meets the least and the greatest node of
its bucket, which joins most copies. Only buckets that still hold several components go on, cut into
tiles of bounded size, and there only members of different components are compared, inside the task.
A pair counts in one bucket only, the first that it has in common. Of its likely pairs each tile first
sends a spanning forest, most matches first. What that doesn't join is confirmed inside its tile, to which
the sets of nodes in likely pairs are sent, so that no table ever holds all likely pairs.
Joins on a key that many rows share deal this key's rows to several tasks (spread_join).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components, roots
from millrace.llm.shared import durable, stored
from millrace.llm.shingles import mixed, shingles

HASHES, BAND, BANDS = 1024, 4, 40
#: Numbers of matches are looked at after so many comparisons.
LOOKS = (32, 64, 128, 256, 512, 1024)
_RNG = np.random.default_rng(11)
_A = _RNG.integers(0, 1 << 32, HASHES, np.uint32)[:, None] | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint32)[:, None]
#: Shingles in a piece of a bucket, at most about so many.
_LOAD = 1 << 21
_WEIGHTS = _RNG.integers(0, 1 << 64, BAND + 1, np.uint64) | np.uint64(1)


def signature(items: np.ndarray) -> np.ndarray:
    """The least value of a non-empty set of 64-bit hashes under each hash function."""
    h = (items.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max)
    for lo in range(0, len(h), 256):
        np.minimum(out, (h[None, lo : lo + 256] * _A + _B).min(axis=1), out=out)
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    """The buckets of a signature, one per band."""
    rows = sig[: BAND * BANDS].astype(np.uint64).reshape(BANDS, BAND)
    return mixed(rows @ _WEIGHTS[:BAND] + np.arange(BANDS, dtype=np.uint64) * _WEIGHTS[BAND]).view(np.int64)


def least_matches(least: float, miss: float) -> list[tuple[int, int]]:
    """(comparisons, matches needed to go on) for each look; `miss` is shared out evenly over the looks."""

    def chance(m: int, k: int) -> float:
        """That a Beta(m + 1, k - m + 1) similarity is `least` or more."""
        return sum(math.exp(math.lgamma(k + 2) - math.lgamma(i + 1) - math.lgamma(k + 2 - i) + i * math.log(least) + (k + 1 - i) * math.log1p(-least)) for i in range(m + 1))

    return [(k, next(m for m in range(k + 1) if m == k or chance(m, k) >= miss / len(LOOKS))) for k in LOOKS]


def alive(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows of a signature matrix those that no look drops, with their matches."""
    m, lo = np.zeros(len(i), np.int64), 0
    for hi, need in needed:
        m = m + (sigs[i, lo:hi] == sigs[j, lo:hi]).sum(axis=1)
        on = m >= need
        i, j, m, lo = i[on], j[on], m[on], hi
    return i, j, m


def hot_keys(left: DataFrame, key: str, limit: int = 1_000) -> DataFrame:
    """(key, copies) of keys that more than `limit` rows of a stored table share; a million at most, since the limit grows with the table."""
    limit = max(limit, left.count() // 1_000_000)
    return durable(left.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("int").alias("__copies")).where("__copies > 1"))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key; left's rows of a hot key are dealt by `salt` to as many copies of right's row."""
    copies = F.coalesce("__copies", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(salt, copies).cast("int")).drop("__copies")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


def _batches(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, text_key, key, n, sig, bands) of each row; of equal sets in a task only one has sig and bands, an empty set has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in _batches(batches):
            keys, n, sigs, bands = [], [], [], []
            for t in b.column(1):
                items = shingles(t.as_py(), width)
                key = xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None
                keys.append(key)
                n.append(len(items))
                if key is None or key in seen:
                    sigs.append(None)
                    bands.append(None)
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(key)
                sig = signature(items)
                sigs.append(sig.astype(np.uint8).tobytes())
                bands.append(buckets(sig))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "key", "n", "sig", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, key binary, n long, sig binary, bands array<long>")


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, key, n, doc_id, text_key, sig, bands): one row per different set, its least id and the hash of one of its texts."""
    ids = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    first = rows.where("sig is not null").groupBy("key").agg(F.min_by(F.struct("n", "text_key", "sig", "bands"), "text_key").alias("x"))
    return ids.join(first, "key").select(F.monotonically_increasing_id().alias("node"), "key", "x.n", "doc_id", "x.text_key", "x.sig", "x.bands")


def _met(nodes: DataFrame, limit: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """(bucket, node, m, load, lo, hi) of nodes that aren't alone in a bucket: its nodes and shingles, its least and greatest node."""
    dealt = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    per = dealt.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("load"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("m > 1")
    per, dealt = stored(per, "bayes-buckets"), dealt.drop("n")
    held = per.count()
    if held * 48 <= max_bytes:
        return stored(dealt.join(F.broadcast(per), "bucket"), "bayes-met")
    limit = max(limit, held // 500_000)  # so that crowded buckets are few; the others have no more rows than this
    crowded, others = F.broadcast(per.where(F.col("m") > limit)), per.where(F.col("m") <= limit)
    alone = dealt.join(crowded.select("bucket"), "bucket", "left_anti").join(others, "bucket")
    return stored(dealt.join(crowded, "bucket").unionByName(alone), "bayes-met")


def _with_both(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """Stored pairs (a, b) with the columns of right, by node, for either side: each name with _a and _b."""
    out, salt = pairs, F.xxhash64("a", "b")
    for c in ("a", "b"):
        side = right.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in right.columns if x != "node"])
        out = spread_join(out, side, c, hot_keys(pairs, c), salt)
    return out


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The stored pairs (a, b) that neither their sizes nor their signatures rule out, stored."""
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 4096):
            sigs = np.frombuffer(b"".join([*b.column(2).to_pylist(), *b.column(3).to_pylist()]), np.uint8).reshape(-1, HASHES)
            on, _, _ = alive(sigs, np.arange(b.num_rows), np.arange(b.num_rows, 2 * b.num_rows), needed)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), b.column(1).take(pa.array(on))], ["a", "b"])

    both = _with_both(pairs, nodes.select("node", "n", "sig"))
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return stored(both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long"), "bayes-likely")


def _sets(docs: DataFrame, text_col: str, rows: DataFrame, wanted: DataFrame, width: int, max_bytes: int = 32 << 20) -> DataFrame:
    """(node, items): the whole sets of wanted nodes (node, key, text_key), made from one text of each, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _batches(batches):
            keys, text_keys, sets = [], [], []
            for t, text_key in zip(b.column(0), b.column(1).to_pylist()):
                if text_key in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(text_key)
                items = shingles(t.as_py(), width)
                sets.append(items)
                keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                text_keys.append(text_key)
            cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(text_keys, pa.int64()), pa.array(keys, pa.binary()), items], ["text_key", "key", "items"])

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    few = wanted.select("text_key").distinct()
    if wanted.count() * 16 <= max_bytes:
        texts = texts.join(F.broadcast(few), "text_key", "left_semi")
    else:
        texts = spread_join(texts, few, "text_key", hot_keys(rows, "text_key"), F.monotonically_increasing_id(), "left_semi")
    made = texts.select("text", "text_key").mapInArrow(run, "text_key long, key binary, items array<long>")
    held = made.groupBy("text_key", "key").agg(F.first("items").alias("items")).join(wanted.hint("shuffle_merge"), ["text_key", "key"])  # both by the same keys, so sets are shuffled once
    return stored(held.select("node", "items"), "bayes-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose whole sets are so similar, stored."""
    met = _with_both(pairs, sets)
    common = met.select("a", "b", (F.size("items_a") + F.size("items_b")).alias("n"), F.size(F.array_intersect("items_a", "items_b")).alias("k"))
    return stored(common.where(100 * F.col("k") >= percent * (F.col("n") - F.col("k"))).select("a", "b"), "bayes-links")


def _array(c: pa.Array, name: str) -> np.ndarray:
    if pa.types.is_binary(c.type):  # of one length
        return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)
    if name in ("items", "wide"):
        out = np.empty(len(c), object)
        out[:] = np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])
        return out
    return c.flatten().to_numpy().reshape(len(c), -1) if name == "bands" else c.to_numpy()


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of one tile after the other; rows come sorted by tile, the first column."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [_array(c, name) for c, name in zip(b.columns, b.schema.names)]
        if rest is not None:
            cols = [np.concatenate(pair) for pair in zip(rest, cols)]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        for lo, hi in zip(np.r_[0, cuts[:-1]], cuts):
            yield [c[lo:hi] for c in cols]
        rest = [c[cuts[-1] if len(cuts) else 0 :] for c in cols]
    if rest is not None:
        yield rest


def _compare(side: np.ndarray, n: np.ndarray, part: np.ndarray, sigs: np.ndarray, percent: int, needed: list[tuple[int, int]], block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, matches) of likely pairs of different parts in a tile: of its two sides, or within its only one."""
    cut = int(np.searchsorted(side, 1))
    inside = cut in (0, len(side))
    for x in range(0, len(side) if inside else cut, block):
        xs = np.arange(x, min(x + block, len(side) if inside else cut))
        for y in range(x if inside else cut, len(side), block):
            ys = np.arange(y, min(y + block, len(side)))
            met = part[xs, None] != part[None, ys]
            if not met.any():
                continue
            small, large = np.minimum(n[xs, None], n[None, ys]), np.maximum(n[xs, None], n[None, ys])
            met &= 100 * small >= percent * large
            if inside:
                met &= xs[:, None] < ys[None, :]
            i, j = np.nonzero(met)
            i, j, m = alive(sigs, i + x, j + y, needed)
            if len(i):
                yield i, j, m


def _forest(part: np.ndarray, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j) of a spanning forest of the parts, edges of most matches first: each part's best edge, then that of what it joins, and so on."""
    label = np.unique(part, return_inverse=True)[1]
    order = np.argsort(-m, kind="stable")
    taken = []
    while len(order):
        a, b = label[i[order]], label[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            break
        first = np.unique(np.r_[np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]])
        taken.append(order[first])
        label = roots(label.max() + 1, a[first], b[first])[label]
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _spanning(part: np.ndarray, found: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """One forest of all edges found; whenever `most` are held, they are cut down to theirs."""
    held: list[tuple[np.ndarray, ...]] = []
    for edges in found:
        held.append(edges)
        if sum(len(e[0]) for e in held) >= most:
            held = list(_spanning(part, iter(held), 1 << 62))
    if held:
        i, j, m = map(np.concatenate, zip(*held))
        on = _forest(part, i, j, m)
        yield i[on], j[on], m[on]


def _first_met(bands: np.ndarray, bucket: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this is the first bucket that rows i and j have in common."""
    return bands[i, (bands[i] == bands[j]).argmax(axis=1)] == bucket


def _tiled(left: DataFrame, tile: int, most: int = _LOAD) -> DataFrame:
    """(tile, side, bucket, node, part) of left (bucket, node, part, m, load): a bucket's rows cut into pieces of bounded size, of about `most` shingles, each row once for every pair of pieces that its own is in."""
    pieces = F.greatest(F.ceil(F.col("m") / tile), F.ceil(F.col("load") / most))
    dealt = left.withColumn("i", F.pmod(F.xxhash64("node"), pieces)).withColumn("o", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.select(F.xxhash64("bucket", F.least("i", "o"), F.greatest("i", "o")).alias("tile"), (F.col("i") > F.col("o")).cast("int").alias("side"), "bucket", "node", "part")


def _in_tiles(dealt: DataFrame, more: DataFrame) -> DataFrame:
    """Tiles with the columns of more, by node, rows of a tile together: sides one after the other, parts in order."""
    cols = [c for c in more.columns if c != "node"]
    return dealt.join(more, "node").select("tile", "side", "bucket", "node", "part", *cols).repartition("tile").sortWithinPartitions("tile", "side", "part")


def _likely_forest(dealt: DataFrame, nodes: DataFrame, percent: int, needed: list[tuple[int, int]]) -> DataFrame:
    """(a, b): of each tile likely pairs that, if all are links, join what all of its likely pairs would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, bucket, node, part, n, bands, sigs in _whole_tiles(batches):
            found = ((i[on], j[on], m[on]) for i, j, m in _compare(side, n, part, sigs, percent, needed) for on in [_first_met(bands, bucket[0], i, j)])
            for i, j, _ in _spanning(part, found):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return _in_tiles(dealt, nodes.select("node", "n", "bands", "sig")).mapInArrow(run, "a long, b long").distinct()


def _suspects(dealt: DataFrame, nodes: DataFrame, percent: int, needed: list[tuple[int, int]]) -> DataFrame:
    """The rows of tiles that are in any likely pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, side, bucket, node, part, n, bands, sigs in _whole_tiles(batches):
            seen = np.zeros(len(node), bool)
            for i, j, _ in _compare(side, n, part, sigs, percent, needed):
                on = _first_met(bands, bucket[0], i, j)
                seen[i[on]] = seen[j[on]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (tile, side, bucket, node, part)], ["tile", "side", "bucket", "node", "part"])

    rows = _in_tiles(dealt, nodes.select("node", "n", "bands", "sig"))
    return rows.mapInArrow(run, "tile long, side int, bucket long, node long, part long")


def _links_in_tiles(suspects: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, needed: list[tuple[int, int]]) -> DataFrame:
    """(a, b): links that join all that each tile's links join. Likely pairs are confirmed on whole sets inside the task, so none but links come out."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        k = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * k >= percent * (len(x) + len(y) - k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, bucket, node, part, n, bands, items, sigs in _whole_tiles(batches):
            label, a, b = np.unique(part, return_inverse=True)[1], [], []
            for i, j, m in _compare(side, n, part, sigs, percent, needed):
                on = _first_met(bands, bucket[0], i, j)
                order = np.argsort(-m[on], kind="stable")
                for x, y in zip(i[on][order].tolist(), j[on][order].tolist()):
                    if label[x] != label[y] and linked(items[x], items[y]):
                        label[label == label[y]] = label[x]
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    more = nodes.select("node", "n", "bands", "sig").join(sets, "node").select("node", "n", "bands", "items", "sig")
    return _in_tiles(suspects, more).mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, miss: float = 1e-6, tile: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Rows whose sets of `width`-word shingles have a similarity of `percent` or more are linked, each
    link confirmed on whole sets; component_id is the least id reachable, rows without an id counting as
    nodes but not as names (null where a component has no id at all). A text of fewer words is one shingle;
    one without words, null too, has an empty set and is linked with nothing: its own id is its component.
    Repeated rows come back as often as they are. miss: the chance, per pair of sets that are similar
    enough, that its signatures drop it.
    """
    rows = stored(_signed(docs, id_col, text_col, width), "bayes-rows")
    nodes = stored(_nodes(rows), "bayes-nodes")
    met = _met(nodes)
    to = lambda c: met.select(F.least(c, "node").alias("a"), F.greatest(c, "node").alias("b"))
    tried = stored(to("lo").union(to("hi")).where("a <> b").distinct(), "bayes-tried")
    likely = _likely(tried, nodes, percent, miss)
    wanted = lambda pairs: nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi").select("node", "key", "text_key")
    known = stored(wanted(likely), "bayes-wanted")
    sets = _sets(docs, text_col, rows, known, width)
    links = _confirmed(likely, sets, percent)
    needed, crowded = least_matches(percent / 100, miss), hot_keys(met.where("m > 3"), "bucket")

    def open_tiles() -> DataFrame:
        """Buckets that hold several components, in tiles. A bucket of up to three nodes has met all its pairs."""
        part = met.where("m > 3").select("bucket", "node", "m", "load").join(components(links), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
        part = stored(part, "bayes-parts")
        several = part.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
        return _tiled(spread_join(part, several, "bucket", crowded, F.xxhash64("node")), tile)

    more = stored(_likely_forest(open_tiles(), nodes, percent, needed).join(tried, ["a", "b"], "left_anti"), "bayes-more")
    for pairs in (True, False):
        rest = None if pairs else stored(_suspects(open_tiles(), nodes, percent, needed), "bayes-suspects")
        needs = wanted(more) if pairs else nodes.join(rest.select("node").distinct(), "node", "left_semi").select("node", "key", "text_key")
        new = stored(needs.join(known, "node", "left_anti"), "bayes-wanted")
        if not new.isEmpty():
            sets, known = sets.unionByName(_sets(docs, text_col, rows, new, width)), known.unionByName(new)
        found = _confirmed(more, sets, percent) if pairs else stored(_links_in_tiles(rest, nodes, sets, percent, needed), "bayes-links")
        links = links.unionByName(found)
    named = nodes.select("node", "key", "doc_id").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "bayes-named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = spread_join(named.select("key", "root"), least, "root", hot_keys(named, "root"), F.xxhash64("key")).select("key", "component_id")
    out = spread_join(rows.select("doc_id", "n", "key"), ids, "key", hot_keys(rows.select("key"), "key"), F.monotonically_increasing_id(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
