"""The analysed corpus derived from the tables of a folder: documents are videos, their sources channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, video_id, channel, language, text): documents cut at . ! ? and line ends; no shuffle."""
    d = table(spark, sf_dir, "documents")
    cut = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "[.!?\n]+")).alias("pos", "part"))
    text = F.trim("part")
    return cut.where(text != "").select((F.col("doc_id") * 1_000_000 + F.col("pos") + 1).alias("sentence_id"), F.col("doc_id").alias("video_id"), F.col("source").alias("channel"), F.col("lang").alias("language"), text.alias("text"))


def units(sents: DataFrame) -> DataFrame:
    """(sentence_id, video_id, channel, kind, key): each sentence's distinct lower-case words; no shuffle."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: w != "")
    return sents.select("sentence_id", "video_id", "channel", F.lit("lemma").alias("kind"), F.explode(words).alias("key"))


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, channel, minutes): a document read at 900 characters a minute."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.col("source").alias("channel"), (F.col("n_chars") / F.lit(900.0)).alias("minutes"))
