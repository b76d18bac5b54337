"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. Whole copies are certain;
the fractions are rounded in pairs: mass moves at random from one document to the other, words kept equal, until one
fraction is 0 or 1. Each chunk of documents leaves one open fraction at most, and chunks' leftovers meet in a
reduction tree, so that a source's words miss its target by one document's size at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.llm.common import WS, carried, numbered, settled, ship, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Documents of a chunk, about, and leftovers that meet in one node of the tree.
CHUNK = 4_000
FAN_IN = 1_000
SEED = 20_240_601


def _chance(*key: object) -> float:
    """A number in [0, 1) that depends on the key alone."""
    return (xxhash.xxh64_intdigest(repr(key).encode(), SEED) >> 11) / float(1 << 53)


def pivot(sizes: Iterable[int], chances: Iterable[float], key: object) -> tuple[list[int], int, float]:
    """Rounds chances in order: (0 or 1 for each, place of the one still open or -1, its chance).

    Keeps the sum of size * chance and each chance's expectation. A size of zero is rounded on its own.
    """
    sizes, p = list(map(int, sizes)), list(map(float, chances))
    out, held = [0] * len(p), -1
    for k in range(len(p)):
        if p[k] <= 0.0 or p[k] >= 1.0:
            out[k] = int(p[k] >= 1.0)
            continue
        if sizes[k] == 0:
            out[k] = int(_chance(key, k, "zero") < p[k])
            continue
        if held < 0:
            held = k
            continue
        i, j, a, b = held, k, float(sizes[held]), float(sizes[k])
        up = min(a * (1 - p[i]), b * p[j])  # words that i may gain from j
        down = min(a * p[i], b * (1 - p[j]))
        if _chance(key, k) * (up + down) < down:
            x, move = (i, j), up
            closed_i = a * (1 - p[i]) <= b * p[j]
        else:
            x, move = (j, i), down
            closed_i = a * p[i] <= b * (1 - p[j])
        gain, lose = x
        p[gain] += move / sizes[gain]
        p[lose] -= move / sizes[lose]
        done = i if closed_i else j
        held = j if closed_i else i
        out[done] = int(done == gain)
        p[done] = float(out[done])
        if p[held] <= 1e-12 or p[held] >= 1 - 1e-12:
            out[held], held = int(p[held] > 0.5), -1
    return out, held, (p[held] if held >= 0 else 0.0)


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): adds target. Sources by code point, null last, weigh WEIGHTS in turn and share
    SHARE of all sizes; none takes more than CAP times its size, what is over goes to the others by weight.

    Filling is done by ordering sources by cap over weight: a source is capped where the level, what is left for each
    unit of weight once all before it are capped, lies above its own ratio; the highest level holds for the rest.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * CAP)
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * SHARE - before) / rest)
    level = F.greatest(F.max("level").over(W.partitionBy()), F.lit(0.0))
    return s.withColumn("target", F.least("cap", F.col("w") * level)).select("source", "source_size", "target")


def _round(frame: pd.DataFrame, key: tuple) -> tuple[list[int], int, float]:
    return pivot(frame["size"], frame["p"], tuple(map(str, key)))


def _meeting(level: int, last: bool):
    """A node of the reduction tree: rounds its children's leftovers; the last settles the one that stays open."""

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("leaf", kind="stable", ignore_index=True)
        out, held, p = _round(f, (*key, level))
        f["taken"] = np.array(out, np.int32)
        f["open"] = (np.arange(len(f)) == held) & (not last)
        if held >= 0 and last:
            f.loc[held, "taken"] = int(_chance(tuple(map(str, key)), "last") < p)
        f["p"] = np.where(f["open"], p, f["p"])
        f["leaf"] = f["node"]
        return f[["none", "name", "leaf", "_row", "size", "p", "taken", "open"]]

    return meet


def copies(docs: DataFrame, words: bool = True) -> DataFrame:
    """Rows (_row, doc_id, size, source_size, target, copies), one for each row of docs; copies is 0, 1 or 2.

    Size is the number of words, null text 0. A null source is one of its own, last in order. Chunks are dealt by a
    hash of (doc_id, size) and taken in the order of doc_id, so that reruns agree whatever the partitions; only
    rows equal in both may swap. An empty table gives no rows; if no text has words all targets are 0. Other columns
    are ignored.
    """
    ship(docs.sparkSession)
    size = F.size(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{WS}]+", "x"), "x")) - 1
    rows = stage(numbered(docs).select("_row", "doc_id", F.col("source").cast("string").alias("source"), size.cast("long").alias("size")), "sizes")
    sums = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n = rows.count()
    chunks = max(1, math.ceil(n / CHUNK))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = rows.join(sums.withColumn("rate", rate), rows["source"].eqNullSafe(sums["source"])).drop(sums["source"])
    whole = F.floor(F.col("rate") + 1e-12)
    p = F.col("rate") - whole
    named = named.withColumn("whole", whole.cast("int")).withColumn("p", F.when(p > 1e-12, p).otherwise(0.0)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)).cast("int"))
    named = named.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))

    def first(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "size", "_row"], kind="stable", ignore_index=True)
        out, held, left = _round(f, key)
        f["taken"] = np.array(out, np.int32)
        f["open"] = np.arange(len(f)) == held
        f["p"] = np.where(f["open"], left, f["p"])
        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, doc_id {kind}, size long, source_size long, target double, whole int, p double, chunk int, none boolean, name string, taken int, open boolean"
    cols = [c.split()[0] for c in schema.split(", ")]
    done = stage(named.select(*cols[:-2]).groupBy("none", "name", "chunk").applyInPandas(lambda k, f: first(k, f)[cols], schema), "rounded")
    left = done.where("open").select("none", "name", F.col("chunk").alias("leaf"), "_row", "size", "p")
    settled = None
    level, nodes = 0, chunks
    while True:
        level, nodes = level + 1, -(-nodes // FAN_IN)
        last = nodes == 1
        left = left.withColumn("node", F.floor(F.col("leaf") / FAN_IN).cast("int"))
        met = left.groupBy("none", "name", "node").applyInPandas(_meeting(level, last), "none boolean, name string, leaf int, _row long, size long, p double, taken int, open boolean")
        met = stage(met, "met")
        closed = met.where(~F.col("open")).select("_row", F.col("taken").alias("late"))
        settled = closed if settled is None else settled.unionByName(closed)
        if last:
            break
        left = met.where("open").select("none", "name", "leaf", "_row", "size", "p")
    out = done.join(settled, "_row", "left").withColumn("copies", F.col("whole") + F.coalesce("late", "taken"))
    return out.select("_row", "doc_id", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as its copies say, with all its columns, whatever their names.

    Null sources are one source, null texts have no words; rows without words may be taken or not. Repeated rows are
    rounded each on its own. An empty table stays empty.
    """
    docs = settled(docs)
    take = copies(docs).where("copies > 0").select("_row", F.col("copies").alias("_n"))
    out = carried(docs).join(take.hint("merge"), "_row")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), "_n"))).select("_doc.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    c = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
