"""The unknown-count index: which sentences are readable, which are one unit away, and what learning a unit opens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a set named by the caller is broadcast; beyond it the join shuffles.
SMALL = 200_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if `rows`, a proven bound of its rows, is small."""
    return F.broadcast(df) if rows <= SMALL else df


def unit_counts(units: DataFrame, *by: str) -> DataFrame:
    """(kind, key, said): sentences that say each unit; further grouping columns come first."""
    return units.groupBy(*by, "kind", "key").agg(F.count("*").alias("said"))


def top_units(units: DataFrame, n: int) -> DataFrame:
    """The n units said most, with their place from 1; ties by key, then kind."""
    best = unit_counts(units).orderBy(F.desc("said"), "key", "kind").limit(n)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("said"), "key", "kind")))


def split_known(units: DataFrame, known: int, goals: int) -> tuple[DataFrame, DataFrame]:
    """(known, goals): the units said most, and the next ones ranked from 0."""
    top = top_units(units, known + goals)
    mine = top.where(F.col("place") <= known).select("kind", "key")
    rest = top.where(F.col("place") > known).select("kind", "key", (F.col("place") - known - 1).alias("rank"))
    return mine, rest


def unknown_units(units: DataFrame, known: DataFrame, known_rows: int = SMALL + 1) -> DataFrame:
    """Edges to units the reader does not know."""
    return units.join(sized(known.select("kind", "key"), known_rows), ["kind", "key"], "left_anti")


def gap(units: DataFrame, known: DataFrame, known_rows: int = SMALL + 1) -> DataFrame:
    """(sentence_id, video_id, channel, units, unknown, lo, hi): unknown counts, with the least and greatest unknown.

    lo is the sole unknown where unknown is 1, and lo and hi are both where it is 2. A sentence's edges lie in one
    partition when they come from units(), so the sums are partial before the only shuffle.
    """
    mark = units.join(sized(known.select("kind", "key", F.lit(True).alias("is_known")), known_rows), ["kind", "key"], "left")
    other = F.when(F.col("is_known").isNull(), F.struct("key", "kind"))
    return mark.groupBy("sentence_id", "video_id", "channel").agg(
        F.count("*").alias("units"), F.count(other).alias("unknown"), F.min(other).alias("lo"), F.max(other).alias("hi")
    )


def frontier(gaps: DataFrame) -> DataFrame:
    """(kind, key, candidates): in how many sentences each unit is the only unknown."""
    return gaps.where("unknown = 1").groupBy(F.col("lo.kind").alias("kind"), F.col("lo.key").alias("key")).agg(F.count("*").alias("candidates"))


def lookahead(gaps: DataFrame) -> DataFrame:
    """(kind, key, unlocks): in how many sentences each unit is one of two unknowns."""
    both = gaps.where("unknown = 2").select(F.explode(F.array("lo", "hi")).alias("u"))
    return both.groupBy(F.col("u.kind").alias("kind"), F.col("u.key").alias("key")).agg(F.count("*").alias("unlocks"))


def next_steps(gaps: DataFrame, goals: DataFrame, weight: float = 3.0, only_goals: bool = False, goal_bonus: float = 10_000.0) -> DataFrame:
    """(kind, key, gain, score) of each candidate step: gain is what it makes readable plus what it brings to one
    unknown, score adds the weighted priority of listed units. goals has (kind, key, rank)."""
    size = goals.count()
    both = frontier(gaps).join(lookahead(gaps), ["kind", "key"], "left")
    both = both.join(sized(goals, size), ["kind", "key"], "inner" if only_goals else "left")
    gain = F.col("candidates") + F.coalesce("unlocks", F.lit(0))
    priority = F.coalesce(1.0 - F.col("rank") / F.lit(float(max(size, 1))), F.lit(0.0))
    score = gain + weight * priority + (F.lit(goal_bonus) if only_goals else F.lit(0.0))
    return both.select("kind", "key", gain.alias("gain"), score.alias("score"))


def best_step(steps: DataFrame) -> DataFrame:
    """The step with the greatest (score, key, kind)."""
    return steps.orderBy(F.desc("score"), F.desc("key"), F.desc("kind")).limit(1)


def gaps_by_video(gaps: DataFrame) -> DataFrame:
    """(video_id, gap): mean unknown units of a video's sentences."""
    return gaps.groupBy("video_id").agg(F.avg("unknown").alias("gap"))
