"""Word lists, goal files, corrections, compounds and other small text files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions.text import ARTICLES


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): a small file's lines in order, without comments and blanks. One row holds the file."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return each.withColumn("line", F.trim(F.regexp_replace("line", "^#.*$|\\s#.*$", ""))).where("line <> ''")


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos): comma alternatives without articles in lower case, each at its first position."""
    each = _lines(spark, path).select("pos", F.posexplode(F.split("line", ",")).alias("alt", "w"))
    w = F.lower(F.trim(F.regexp_replace(F.trim("w"), f"(?i)^(?:{'|'.join(ARTICLES)})\\s+", "")))
    each = each.select("pos", "alt", w.alias("word")).where("word <> ''")
    return each.groupBy("word").agg(F.min(F.struct("pos", "alt")).alias("p")).select("word", F.col("p.pos").alias("pos"))


def goals(spark: SparkSession, path: str) -> DataFrame:
    """(entry, pos): the second of two tabbed columns where there is one, each entry at its first position."""
    cols = F.split("line", "\t")
    e = _lines(spark, path).select("pos", F.trim(F.when(F.size(cols) > 1, F.element_at(cols, 2)).otherwise(F.element_at(cols, 1))).alias("entry"))
    return e.where("entry <> ''").groupBy("entry").agg(F.min("pos").alias("pos"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right): two columns parted by a tab or white space; the last line for a word holds."""
    m = _lines(spark, path).select("pos", F.split("line", "\\s+", 2).alias("c")).where(F.size("c") == 2)
    return m.groupBy(F.col("c")[0].alias("wrong")).agg(F.max_by(F.trim(F.col("c")[1]), "pos").alias("right"))


def compounds(spark: SparkSession, path: str, marker: str = "CHECKED TO HERE") -> DataFrame:
    """(word, parts): lines `word part part...` above the marker line; all lines if there is none."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    stop = whole.agg(F.min(F.when(F.contains("line", F.lit(marker)), F.col("pos"))).alias("stop"))
    kept = whole.join(F.broadcast(stop)).where("stop IS NULL OR pos < stop").withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    ws = F.filter(F.split(F.lower("line"), "[\\s=+:]+"), lambda w: w != "")
    return kept.select(ws.alias("ws")).where(F.size("ws") > 2).select(F.element_at("ws", 1).alias("word"), F.slice("ws", 2, 1000).alias("parts"))


def blueprints(rows: DataFrame) -> DataFrame:
    """(key, value): of each verb's patterns the longest, ties the greatest."""
    return rows.groupBy("key").agg(F.max(F.struct(F.length("value").alias("n"), "value")).alias("v")).select("key", "v.value")


def deck_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A deck's tabbed sheet with a header."""
    return spark.read.csv(path, sep="\t", header=True)
