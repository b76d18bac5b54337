"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into cells by the population counts of their four 16-bit quarters. Two fingerprints
within the radius have counts whose differences add up to the radius at most, so only such cell pairs are compared;
all other tile pairs are skipped. A compared pair of tiles goes through numpy exclusive-or and bit counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import carried, components, numbered, settled, ship, stage

#: Fingerprints of a tile, about; cells with more are subdivided by hash.
TILE = 2048
RADIUS = 4
_BLOCK = 1 << 20
_QUARTERS = 4


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: XXH64 of each shingle, a bit set where over half the hashes have it.

    A-Z are lower-cased and words split at ASCII white space, as bytes do it. Fewer words than a shingle: the whole
    sequence; none, empty or null: zero. Repeated shingles count each time.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    s = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(w) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s[i:j], seed) for i, j in zip(start, end[k - 1 :].tolist())], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows (_row, doc_id, fp), fp the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["_row", "doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string").alias("text")
    return numbered(docs.select("doc_id", "text")).select("_row", "doc_id", text).mapInArrow(each, f"_row long, doc_id {kind}, fp long")


class _Forest:
    """Which nodes are known to be connected; keeps the unions that were new."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.made: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        far = a != b
        if not far.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[far], b[far]), np.maximum(a[far], b[far])], 1), axis=0)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.made.append((min(x, y), max(x, y)))
        if up:
            to = np.arange(len(self.label))
            for x in up:
                to[x] = find(x)
            self.label = to[self.label]


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles that connect what all their links connect: at most one less than they have members."""
    both = np.concatenate([left, right])
    forest, n = _Forest(len(both)), len(left)
    step = max(1, _BLOCK // max(1, len(right)))
    for at in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius)
        forest.add(i + at, j + n)
    if not forest.made:
        return both[:0], both[:0]
    i, j = np.array(forest.made).T
    return both[i], both[j]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (a, b) over distinct fingerprints `fp`: a spanning set of the links at `radius` or fewer differing bits.

    Every tile pair within reach is compared whole; of the links found in a tile pair those that join nothing new are
    left out, so that a large group gives about as many rows as members, not their square.
    """
    ship(fps.sparkSession)
    width = 64 // _QUARTERS
    masks = [((1 << width) - 1) << (width * q) for q in range(_QUARTERS)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    part = [F.bit_count(F.col("fp").bitwiseAND(F.lit(m))).cast("int") for m in masks]
    base = width + 1

    def code(cs):
        out = cs[0]
        for c in cs[1:]:
            out = out * base + c
        return out

    cells = fps.select("fp", *[c.alias(f"p{q}") for q, c in enumerate(part)])
    ps = [F.col(f"p{q}") for q in range(_QUARTERS)]
    cells = cells.withColumn("cell", code(ps))
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = cells.join(parts, "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = stage(tiles.groupBy("cell", "sub", *ps).agg(F.array_sort(F.collect_list("fp")).alias("fps")), "tiles")
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=_QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * _QUARTERS]
    move = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{q}") for q, x in enumerate(d)]) for d in steps]))
    left = tiles.withColumn("d", move).select("*", "d.*").drop("d")
    to = [F.col(f"p{q}") + F.col(f"d{q}") for q in range(_QUARTERS)]
    inside = F.lit(True)
    for t in to:
        inside = inside & t.between(0, width)
    same = F.lit(True)
    for q in range(_QUARTERS):
        same = same & (F.col(f"d{q}") == 0)
    left = left.where(inside).select(code(to).alias("cell"), F.when(same, F.col("sub")).otherwise(-1).alias("from_sub"), F.col("fps").alias("a"))
    # -1: another cell, all tiles are partners; else its own cell, where each two tiles meet once
    right = tiles.select("cell", "sub", F.col("fps").alias("b"))
    pairs = left.hint("merge").join(right, "cell").where((F.col("from_sub") < 0) | (F.col("from_sub") <= F.col("sub"))).select("cell", "sub", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * (1 << 32) + batch.column(1).to_numpy()
            found_a, found_b = [], []
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                right_ = batch.column(3)[lo].values.to_numpy(zero_copy_only=False).view(np.uint64)
                left_ = batch.column(2).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                x, y = near_pairs(left_, right_, radius)
                found_a.append(x)
                found_b.append(y)
            none = np.zeros(0, np.uint64)
            a, b = np.concatenate([none, *found_a]).view(np.int64), np.concatenate([none, *found_b]).view(np.int64)
            far = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[far]), pa.array(b[far])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """Rows (_row, doc_id, fp, component_id, keep_row), one for each row of docs.

    Texts without words share the fingerprint zero and link like any other. Null or repeated doc_ids are rows of
    their own; component_id is the smallest doc_id that is not null. keep_row is the row with that doc_id (the first
    of equals). An empty table gives no rows. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, words), "fingerprints")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("low")
    per = stage(rows.groupBy("fp").agg(low), "distinct")
    found = components(links(per.select("fp"), radius))
    own = per.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    top = own.groupBy("c").agg(F.min("low").alias("top"))
    named = own.join(top, "c").select("fp", F.col("top.doc_id").alias("component_id"), F.col("top._row").alias("keep_row"))
    return rows.join(named, "fp").select("_row", "doc_id", "fp", "component_id", "keep_row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, with all its columns, whatever
    their names. Nulls, repeated rows and empty tables are as in classes: texts without words are one component.
    """
    docs = settled(docs)
    keep = classes(docs).where(F.col("_row") == F.col("keep_row")).select("_row")
    return carried(docs).join(keep.hint("merge"), "_row", "left_semi").select("_doc.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    c = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
