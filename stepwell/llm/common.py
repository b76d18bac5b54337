"""Helpers that the corpus operators share: staged tables, let-bindings, connected components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.session import ship  # noqa: F401
from stepwell.storage import release, shared_dir, stage, unstage  # noqa: F401

#: The white space of all contracts, as a class body for Java, RE2 and Python patterns.
WS = r"\x20\x09-\x0D"


def let(value: Column, body) -> Column:
    """body(v) with v bound once to value, so that value is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame) -> DataFrame:
    """A table whose rows come in the same order each time: df itself, or its staged copy if a shuffle feeds it."""
    return stage(df, "input") if re.search("(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()) else df


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a row identity that is the same each time the same files are scanned; doc_id may repeat or be null."""
    return df.withColumn(name, F.monotonically_increasing_id())


def carried(docs: DataFrame) -> DataFrame:
    """(_row, _doc): each row's identity beside the whole row as a struct, so that no column's name can clash."""
    return numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reached.

    Alternates large-star and small-star rounds; each round's edges are staged, none reach the driver. A node with
    very many neighbours is only ever a grouping key of a min and of a join that AQE may split. Self loops give
    isolated nodes. Empty edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    cur = stage(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("b"), F.col("m").alias("a")).where(a != b).distinct()
        large = stage(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m"), F.explode(F.array(a, b)).alias("x"))
        nxt = stage(small.where(F.col("x") != F.col("m")).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(large)
        unstage(cur)
        cur = nxt
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    root = cur.groupBy(b.alias("node")).agg(F.min("a").alias("m"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("m", "node").alias("component"))
