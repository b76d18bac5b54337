"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned by
them, overfull ranges are subdivided, and running sums inside the ranges cut the order into shards of equal bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.llm.common import numbered, stage

SHARDS = 8
#: Rows a range should hold, the most ranges of one pass, and sampled keys for each range.
RANGE_ROWS = 4_000
MAX_RANGES = 512
OVERSAMPLE = 24
#: A range over this many times its share of the bytes is subdivided, in so many passes at most.
OVERFULL = 2.0
MAX_PASSES = 4

_KEY = ("h", "doc", "_row")


def _before(cut: tuple) -> Column:
    """Whether a record's key sorts before a boundary."""
    (h, doc, row) = (F.lit(x).cast("long") for x in cut)
    a, b, c = (F.col(k) for k in _KEY)
    return (a < h) | ((a == h) & ((b < doc) | ((b == doc) & (c < row))))


def _place(cuts: list[tuple], lo: int, hi: int) -> Column:
    """How many of cuts[lo:hi] a record's key has passed, as a balanced tree of conditions."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_before(cuts[mid]), _place(cuts, lo, mid)).otherwise(_place(cuts, mid + 1, hi))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Quantile boundaries of a size-weighted sample of keys; MAX_RANGES * OVERSAMPLE keys or so reach the driver."""
    if ranges < 2 or not total:
        return []
    want = ranges * OVERSAMPLE
    # a record is drawn with a chance in proportion to its size, from a hash of its key
    chance = F.col("size") * (want / total)
    u = F.pmod(F.xxhash64(*_KEY, F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    drawn = sorted(tuple(r) for r in rows.where(u < chance).select(*_KEY).collect())
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)} if drawn else set())


def ranged(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """rows with `range`, an array of places: the first pass's, then the places inside overfull ranges."""
    cuts = _splitters(rows, total, ranges)
    out = rows.withColumn("range", F.array(_place(cuts, 0, len(cuts))))
    share = total / max(1, ranges)
    for _ in range(MAX_PASSES):
        over = out.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > OVERFULL * share) & (F.col("n") > 1))
        found = sorted((tuple(r["range"]), r["bytes"]) for r in over.collect())
        if not found:
            break
        deeper = F.col("range")
        for place, size in found:
            inside = F.col("range") == F.array(*map(F.lit, place))
            more = _splitters(out.where(inside), size, min(MAX_RANGES, math.ceil(size / share)))
            deeper = F.when(inside, F.concat("range", F.array(_place(more, 0, len(more))))).otherwise(deeper)
        out = stage(out.withColumn("range", deeper), "ranges")
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs; law `bytes`.

    Records are ordered by (hash of the text, hash of doc_id, row), so that equal texts lie side by side and stay together
    but where a shard ends; a group that outgrows a range is subdivided inside. A shard ends at the record in which
    its share of the bytes does, so shards differ by about the largest record. Null text has no bytes, and size 1.
    Null and repeated doc_ids are rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keys = numbered(docs).select(
        "_row",
        "doc_id",
        F.xxhash64("doc_id").alias("doc"),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    keys = stage(keys, "keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_ROWS)))
    rows = stage(ranged(keys, total, ranges), "ranged")
    # offsets of the ranges: one row for each range
    order = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    sums = sums.select("range", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"))
    inside = W.partitionBy("range").orderBy(*_KEY)
    placed = rows.withColumn("run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.row_number().over(inside))
    placed = placed.join(F.broadcast(sums) if ranges <= MAX_RANGES else sums, "range")
    middle = F.col("bytes_before") + F.col("run") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int")).withColumn("place", F.col("rows_before") + F.col("at") - 1)
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "place"), "placed")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    start = F.lit(0).cast("long")
    for k, v in first.items():
        start = F.when(F.col("shard") == k, F.lit(v)).otherwise(start)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
