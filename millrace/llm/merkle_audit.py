"""Merkle fixity audit of WARC replicas.

A manifest has a row per record: archive, offset, length, copies, key and the SHA-256 of the
record's bytes. Above the records stand ordered offset ranges of growing width, each hashed over
what lies in it in order of offset, and above these the archive. Each level of both replicas'
trees is written once. Roots are compared first; of the next level only the ranges below a
mismatch are looked at, down to single records. The bytes are hashed once per replica;
everything after works on digests.

An archive holds a bounded number of records: one key range, or, where a key range has more than
`per_shard` different records, one share of it by digest. So no group is larger than an archive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import stored

#: Bytes per offset range, finest first.
WIDTHS = (1 << 16, 1 << 19, 1 << 22)


def warc_record(uri: Column, payload: Column) -> Column:
    """A WARC 1.0 resource record as binary; nulls count as empty."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archives(records: DataFrame, per_archive: int = 512, per_shard: int = 2048) -> DataFrame:
    """(key, sha256, ...) -> the same with archive, a row per different record, and `copies`.

    Records follow their key in archives of per_archive keys; records that agree in all columns are
    one with its number of copies. A key range with more than per_shard different records is cut by
    digest. Records without a key go to archives named by their digest, so that they spread.
    """
    merged = records.groupBy(*records.columns).agg(F.count("*").alias("copies"))
    home = F.when(F.col("key").isNull(), F.concat(F.lit("n"), F.substring("sha256", 1, 4))).otherwise(F.concat(F.lit("k"), F.floor(F.col("key") / per_archive).cast("string")))
    homed = stored(merged.withColumn("home", home), "audit-homed")
    crowded = homed.groupBy("home").count().where(F.col("count") > per_shard).select("home", F.ceil(F.col("count") / per_shard).cast("int").alias("shards"))
    part = F.pmod(F.conv(F.substring("sha256", 5, 7), 16, 10).cast("long"), F.col("shards").cast("long"))
    return homed.join(crowded, "home", "left").withColumn("archive", F.concat("home", F.when(F.col("shards").isNotNull(), F.concat(F.lit("."), part.cast("string"))).otherwise(F.lit("")))).drop("home", "shards")


def offsets(length: Column, *order: str) -> Column:
    """Where each record of an archive starts: the bytes of all records before it. A null length takes no room."""
    before = W.partitionBy("archive").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(length * F.col("copies")).over(before), F.lit(0)).cast("long")


def _leaf() -> Column:
    return F.sha2(F.concat_ws(":", F.col("at").cast("string"), F.col("length").cast("string"), F.col("copies").cast("string"), "sha256"), 256)


def _range(at: Column, width: int | None) -> Column:
    """The start of the range of `width` bytes in which an offset lies; without a width, of the archive."""
    return F.lit(0).cast("long") if width is None else (F.floor(at / width) * width).cast("long")


def _level(nodes: DataFrame, width: int | None) -> DataFrame:
    """(archive, side, at, hash) of one level -> of the next."""
    parts = F.array_sort(F.collect_list(F.struct("at", "hash")))
    text = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"])), ",")
    grouped = nodes.groupBy("archive", "side", _range(F.col("at"), width).alias("range")).agg(parts.alias("parts"))
    return grouped.select("archive", "side", F.col("range").alias("at"), F.sha2(text, 256).alias("hash"))


def _sides(nodes: DataFrame, *keys: str) -> DataFrame:
    """A row per key with both sides' hashes, null where a side has none."""
    return nodes.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col("hash"))).alias(s) for s in ("ours", "theirs")])


def audit(ours: DataFrame, theirs: DataFrame, widths: Sequence[int] = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """Two manifests (archive, offset, length, copies, key, sha256) -> (roots, damage).

    roots: archive, root_ours, root_theirs, same. damage: archive, offset, key, kind. Records at one
    offset that agree are sound. Of the others in an archive, the n-th with a key on our side is held
    against the n-th with that key on theirs (null keys count as one): `moved` if the bytes agree,
    `changed` if not, `missing` if only ours has it, `extra` if only theirs. offset is ours, theirs
    for extra ones. Offsets are unique in an archive, zero-length records apart, which follow their
    digests. An archive that only one side has is compared like any other. Empty manifests give
    empty results; columns beyond those named are not looked at.
    """
    cols = ["archive", F.col("offset").alias("at"), "length", "copies", "key", "sha256"]
    both = ours.select(F.lit("ours").alias("side"), *cols).unionByName(theirs.select(F.lit("theirs").alias("side"), *cols))
    leaves = stored(both.withColumn("hash", _leaf()), "audit-leaves")
    levels = [leaves]
    for width in [*widths, None]:
        levels.append(stored(_level(levels[-1], width), "audit-level"))
    roots = _sides(levels[-1], "archive").select("archive", F.col("ours").alias("root_ours"), F.col("theirs").alias("root_theirs"), F.col("ours").eqNullSafe(F.col("theirs")).alias("same"))
    bad = roots.where("not same").select("archive", F.lit(0).cast("long").alias("range"))
    for level, width in zip(levels[-2:0:-1], [None, *widths[:0:-1]]):
        below = level.withColumn("range", _range(F.col("at"), width)).join(bad, ["archive", "range"], "left_semi")
        bad = stored(_sides(below, "archive", "at").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("archive", F.col("at").alias("range")), "audit-open")
    opened = leaves.withColumn("range", _range(F.col("at"), widths[0])).join(bad, ["archive", "range"], "left_semi")
    odd = opened.withColumn("n", F.count("*").over(W.partitionBy("archive", "at", "hash"))).where("n = 1")  # sound records stand here twice
    nth = F.row_number().over(W.partitionBy("archive", "side", "key").orderBy("at", "sha256"))
    held = odd.withColumn("nth", nth).groupBy("archive", "key", "nth").agg(*[F.max(F.when(F.col("side") == s, F.struct("at", "length", "copies", "sha256"))).alias(s) for s in ("ours", "theirs")])
    equal = F.lit(True)
    for c in ("length", "copies", "sha256"):
        equal = equal & F.col(f"ours.{c}").eqNullSafe(F.col(f"theirs.{c}"))
    kind = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").when(equal, "moved").otherwise("changed")
    return roots, held.select("archive", F.coalesce("ours.at", "theirs.at").alias("offset"), "key", kind.alias("kind"))


def page_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests of pages as WARC records and of a replica of the archives that has planted damage.

    In the replica's files the first byte is changed of every page whose id leaves 7 when divided by
    101, the last byte is cut off those that leave 11 by 1009, and those that leave 5 by 2003 are lost;
    what follows these in their archive stands at another offset. Its manifest is made from its own
    bytes. A page without an id is intact.
    """
    record = warc_record(F.col("url"), F.col("html"))
    lost = F.coalesce(F.col("key") % 2003 == 5, F.lit(False))
    damaged = F.when(F.col("key") % 101 == 7, F.concat(F.encode(F.lit("w"), "UTF-8"), F.substring("record", 2, 2**31 - 1))).when(F.col("key") % 1009 == 11, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    made = pages.select(F.col("page_id").cast("long").alias("key"), record.alias("record")).withColumn("other", F.when(~lost, damaged))
    size = lambda c: F.length(c).cast("long")
    hashed = made.select("key", size("record").alias("length"), F.sha2("record", 256).alias("sha256"), size("other").alias("length_b"), F.sha2("other", 256).alias("sha256_b"))
    order = ("key", "sha256")
    laid = stored(archives(hashed).withColumns({"offset": offsets(F.col("length"), *order), "offset_b": offsets(F.col("length_b"), *order)}), "audit-laid")
    cols = ["archive", "copies", "key"]
    theirs = laid.where("sha256_b is not null").select(*cols, *[F.col(f"{c}_b").alias(c) for c in ("offset", "length", "sha256")])
    return laid.select(*cols, "offset", "length", "sha256"), theirs


def report(ours: DataFrame, theirs: DataFrame, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """A row per archive: records and bytes of ours, both roots, how many records moved, and the damaged ones as kind:key:offset in order of offset.

    Without a key its place is empty. Archives are bounded, and with them each row.
    """
    roots, damage = audit(ours, theirs, widths)
    size = ours.groupBy("archive").agg(F.sum("copies").alias("n_records"), F.sum(F.col("length") * F.col("copies")).alias("n_bytes"))
    named = F.concat_ws(":", "kind", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("offset").cast("string"))
    real = F.col("kind") != "moved"
    names = F.array_sort(F.collect_list(F.when(real, F.struct("offset", named.alias("name")))))
    listed = damage.groupBy("archive").agg(F.count(F.when(real, 1)).alias("n_damaged"), F.count(F.when(~real, 1)).alias("n_moved"), F.array_join(F.transform(names, lambda x: x["name"]), ",").alias("damaged"))
    out = roots.join(size, "archive", "left").join(listed, "archive", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("archive", count("n_records"), count("n_bytes"), "root_ours", "root_theirs", count("n_damaged"), count("n_moved"), F.coalesce("damaged", F.lit("")).alias("damaged"))
