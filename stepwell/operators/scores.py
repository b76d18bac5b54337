"""Scores of videos: how much of one is readable, what it teaches, and how watchable it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.functions import scalars
from stepwell.operators.index import sized


def video_scores(gaps: DataFrame, minutes: DataFrame, goals: DataFrame, goal_rows: int) -> DataFrame:
    """(video_id, channel, lines, readable, comprehension, teachable, teaches, minutes, dialogue, watch)."""
    g = gaps.withColumn("key", F.when(F.col("unknown") == 1, F.col("lo.key")))
    g = g.join(sized(goals.select("key", F.lit(True).alias("is_goal")), goal_rows), "key", "left")
    per = g.groupBy("video_id", "channel").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("unknown") == 0).alias("readable"),
        F.count_if(F.col("unknown") == 1).alias("teachable"),
        F.count_distinct(F.when(F.col("is_goal"), F.col("key"))).alias("teaches"),
    )
    v = per.join(minutes.select("video_id", "minutes", "dialogue"), "video_id")
    v = v.withColumn("comprehension", F.col("readable") / F.col("lines"))
    return v.withColumn("watch", scalars.watchability(F.col("comprehension"), F.col("minutes"), F.col("lines"), F.col("dialogue")))


def next_words(gaps: DataFrame, most: int = 8) -> DataFrame:
    """(video_id, place, key, n): each video's sole unknowns by sentences, the first `most`; ties by key."""
    n = gaps.where("unknown = 1").groupBy("video_id", F.col("lo.key").alias("key")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("n"), "key"))
    return n.withColumn("place", place).where(F.col("place") <= most)


def supply(gaps: DataFrame, sents: DataFrame, goals: DataFrame, goal_rows: int, floor: int = 40) -> DataFrame:
    """(key, video_id, n): distinct texts that teach each goal in each video with enough lines."""
    enough = sents.groupBy("video_id").agg(F.count("*").alias("lines")).where(F.col("lines") >= floor).select("video_id")
    one = gaps.where("unknown = 1").select("sentence_id", "video_id", F.col("lo.key").alias("key"))
    one = one.join(sized(goals.select("key"), goal_rows), "key", "left_semi").join(enough, "video_id", "left_semi")
    texts = one.join(sents.select("sentence_id", "text"), "sentence_id").select("key", "video_id", "text").distinct()
    return texts.groupBy("key", "video_id").agg(F.count("*").alias("n"))


def audit(supplied: DataFrame, chosen: DataFrame, depth: int) -> DataFrame:
    """(key, got, want): what chosen videos bring of each unit, independent of how they were chosen."""
    need = supplied.groupBy("key").agg(F.least(F.sum("n"), F.lit(depth)).alias("want"))
    got = supplied.join(chosen.select("video_id"), "video_id", "left_semi").groupBy("key").agg(F.sum("n").alias("got"))
    return need.join(got, "key", "left").select("key", F.coalesce("got", F.lit(0)).alias("got"), "want")
