"""Exact deduplication against immutable snapshots.

A snapshot's digests are kept as static binary-fuse filters (3-wise, 8-bit fingerprints), one for each bucket of the
digest space. Incoming digests are grouped among themselves first, then screened by the filter of their bucket; only
positives join the snapshot's exact bucket, where texts are compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import WS, carried, numbered, settled, ship, stage

#: Digests a bucket should hold at most; a filter takes about 9 bits a digest.
BUCKET_KEYS = 200_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 over keys and a seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _layout(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    if n <= 1:
        return 4, 3
    length = min(1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 262_144)
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    return length, max(3, -(-int(n * factor) // length) + 2)


def _slots(h: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = ((h >> np.uint64(40)) * np.uint64(segments - 2)) >> np.uint64(24)
    mask, base = np.uint64(length - 1), first * np.uint64(length)
    a = base + (h & mask)
    b = base + np.uint64(length) + ((h >> np.uint64(18)) & mask)
    c = base + np.uint64(2 * length) + ((h >> np.uint64(36)) & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def _print8(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter of distinct 64-bit keys: (seed, segment length, segments, fingerprints).

    Peels all keys that stand alone in a slot, layer by layer, with numpy; tries another seed if some are left. A
    peeled key is assigned after the later ones, in reverse.
    """
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _layout(len(keys))
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += max(1, segments // 10)
        size = length * segments
        h = _mix(keys, seed * 0x9E3779B9)
        at = np.stack(_slots(h, length, segments))
        count = np.zeros(size, np.int64)
        xor = np.zeros(size, np.int64)
        ids = np.arange(len(keys), dtype=np.int64)
        for row in at:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(xor, row, ids)
        layers, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            alone = alone[count[alone] == 1]
            who, first = np.unique(xor[alone], return_index=True)
            if not len(who):
                break
            layers.append((who, alone[first]))
            left -= len(who)
            for row in at:
                np.subtract.at(count, row[who], 1)
                np.bitwise_xor.at(xor, row[who], who)
            alone = np.unique(at[:, who])
        if left:
            continue
        table = np.zeros(size, np.uint8)
        prints = _print8(h)
        for who, slot in reversed(layers):
            a, b, c = at[:, who]
            table[slot] = 0
            table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c]
        return seed, length, segments, table.tobytes()
    raise RuntimeError("no seed peels these keys")


def fuse_has(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    """Which keys may be in the filter: all that are, and about one in 256 others."""
    t = np.frombuffer(table, np.uint8)
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B9)
    a, b, c = _slots(h, length, segments)
    return (t[a] ^ t[b] ^ t[c]) == _print8(h)


def digests(docs: DataFrame) -> DataFrame:
    """Rows (_row, doc_id, chars, sha, key): sha of the text without white space, key its first 64 bits. Null is empty."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(F.regexp_replace(text, f"[{WS}]+", "").cast("binary"), 256)
    d = numbered(docs).select("_row", "doc_id", F.length(text).cast("long").alias("chars"), sha.alias("sha"))
    high = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring("sha", 9, 8), 16, 10).cast("long")
    return d.withColumn("key", F.shiftleft(high, 32).bitwiseOR(low))


def best(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: the row that stays (most code points, then smallest doc_id, null last) and the group's size."""
    top = F.min(F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "chars"))
    return rows.groupBy(*by).agg(top.alias("top"), F.sum("size").alias("size")).select(*by, "size", "top.doc_id", "top.chars", "top._row")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One immutable filter for each bucket of a snapshot's distinct keys: (bucket, n, seed, length, segments, table)."""
    ship(snapshot.sparkSession)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        made = fuse_build(part["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(int(key[0]), len(part), *made)], columns=["bucket", "n", "seed", "length", "segments", "table"])

    keys = snapshot.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key").distinct()
    return keys.groupBy("bucket").applyInPandas(build, "bucket int, n long, seed long, length long, segments long, table binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Incoming distinct keys with `maybe`: false where the snapshot's filter rules the key out."""
    ship(incoming.sparkSession)

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = left["key"].to_numpy(np.int64)
        maybe = np.zeros(len(keys), bool)
        if len(right) and len(left):
            f = right.iloc[0]
            maybe = fuse_has(keys.view(np.uint64), int(f["seed"]), int(f["length"]), int(f["segments"]), f["table"])
        return pd.DataFrame({"key": keys, "maybe": maybe})

    keys = incoming.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key").distinct()
    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "key long, maybe boolean")


def dedup(docs: DataFrame, snapshot_share: int = 2) -> DataFrame:
    """Row-by-row decisions over a snapshot and the batch that arrives after it.

    Of `snapshot_share` equal parts of the digest order's rows all but the last form the snapshot (split by a hash of
    the row, so that both hold copies of the same texts); the last is the new batch. Returns (_row, doc_id, keep_id,
    keep_row, group_size, kept, text_sha256), one row for each row of docs.

    Null text is empty; all empty or blank texts are equal. Null or repeated doc_ids are rows of their own: of wholly
    equal rows the first stays, though keep_id then names them all. An empty table gives no rows. Other columns are
    ignored.
    """
    docs = settled(docs)
    rows = stage(digests(docs).withColumn("size", F.lit(1).cast("long")).withColumn("batch", F.pmod(F.xxhash64("_row"), F.lit(snapshot_share)) == snapshot_share - 1), "digests")
    held = stage(best(rows.where(~F.col("batch")), "key", "sha"), "snapshot")
    new = stage(best(rows.where("batch"), "key", "sha"), "batch")
    buckets = max(1, -(-held.count() // BUCKET_KEYS))
    filters = stage(build_filters(held, buckets), "filters")
    maybe = screen(new, filters, buckets).where("maybe").select("key")
    pairs = new.join(maybe, "key", "left_semi").join(held.select("key", "sha", F.col("_row").alias("held_row")), ["key", "sha"])
    pairs = stage(pairs.select("key", "sha", "_row", "held_row"), "positives")
    # byte checks: the two texts of each positive meet, no other text moves
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{WS}]+", "").cast("binary")
    wanted = pairs.select(F.explode(F.array(F.struct("_row", "sha"), F.struct(F.col("held_row").alias("_row"), "sha"))).alias("w")).select("w.*")
    texts = numbered(docs.select("doc_id", "text")).select("_row", norm.alias("norm")).join(wanted.hint("merge"), "_row")
    differ = texts.groupBy("sha").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("sha")
    same = pairs.select("key", "sha").join(differ, "sha", "left_anti")
    both = held.withColumn("batch", F.lit(False)).unionByName(new.withColumn("batch", F.lit(True)))
    joined = both.join(same.withColumn("same", F.lit(True)), ["key", "sha"], "left").withColumn("side", F.when(F.col("same"), F.lit(False)).otherwise(F.col("batch")))
    groups = best(joined, "key", "sha", "side").select("key", "sha", "side", F.col("doc_id").alias("keep_id"), F.col("_row").alias("keep_row"), F.col("size").alias("group_size"))
    # a batch row belongs to the snapshot's group where the text was met there, else to the batch's own
    owner = joined.select("key", "sha", "batch", "side").join(groups, ["key", "sha", "side"]).drop("side")
    out = rows.drop("size").join(owner, ["key", "sha", "batch"])
    return out.select("_row", "doc_id", "keep_id", "keep_row", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names and the type of doc_id.

    Nulls, repeated rows and empty tables are as in dedup: of equal texts, null and empty ones too, one row stays.
    """
    docs = settled(docs)
    keep = dedup(docs).where("kept").select("_row")
    return carried(docs).join(keep.hint("merge"), "_row", "left_semi").select("_doc.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    d = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY sha) AS group_size FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
