"""Which sentences are worth learning from, with a reason for each that is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.functions.scalars import words

# Patterns and word lists that verdicts depend on.
ARTIFACT = r"[\[\]<>_♪*]"
CAPTION_ARTIFACT = r"[…–—]|--|\.\.\.| - "
PICTOGRAPH = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{2190}-\x{21FF}]"
FOREIGN_SCRIPT = 0.2
CHANT = 3
ENGLISH = (
    "the and is are you your this that with have has not but they would could "
    "about from just there what for my his her she he of on to it at be by or if "
    "were been their don't it's i'm we're going know like think really because"
).split()
GERMAN = (
    "der die das und ist sind ich nicht ein eine einen zu mit auf für dass aber "
    "sich es den dem wir sie du war haben hat wird werden kann auch noch schon "
    "wenn weil oder als wie so nur mal ja nein sehr mehr immer dann doch hier "
    "jetzt was mir mich dir dich ihm ihr uns euch von im am zum zur"
).split()


def fingerprint(text: Column) -> Column:
    """Letters, digits and underscores of the text in lower case."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


def plain(text: Column) -> Column:
    """The words in lower case, without other signs; words of such signs alone are left out."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]+", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")


def not_german(text: Column, p: Column) -> Column:
    """Too many letters of other scripts, or English marker words, two or more, outnumber the German ones."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    foreign = F.length(F.regexp_replace(letters, "[A-Za-zÄÖÜäöüß]+", ""))
    script = (F.length(letters) > 0) & (foreign / F.greatest(F.length(letters), F.lit(1)) > FOREIGN_SCRIPT)
    count = lambda marks: F.size(F.filter(p, lambda w: w.isin(*marks)))
    return script | ((count(ENGLISH) >= 2) & (count(ENGLISH) > count(GERMAN)))


def repeats(p: Column) -> Column:
    """No words, two equal halves, or a word three times; p are words without empty ones."""
    half = F.floor(F.size(p) / 2).cast("int")
    halves = (half > 0) & (F.slice(p, F.lit(1), half) == F.slice(p, half + 1, half))
    # in sorted words those said CHANT times stand CHANT - 1 places apart
    rest = F.greatest(F.size(p) - (CHANT - 1), F.lit(0))
    chant = F.exists(F.zip_with(F.slice(F.array_sort(p), F.lit(1), rest), F.slice(F.array_sort(p), F.lit(CHANT), rest), lambda x, y: x == y), lambda e: e)
    return (F.size(p) == 0) | halves | chant


def reasons(sents: DataFrame, least: int = 4, most: int = 25) -> DataFrame:
    """sents (text, origin, and `nr`, a total order) with reason, null where kept.

    Only a kept sentence makes a later one with its fingerprint a duplicate, so the first that passes all other tests
    is found for each fingerprint by a minimum, and joined back. What the tests before that one reject is not shuffled.
    """
    text = F.trim("text")
    s = sents.withColumn(
        "_early",
        F.when(text == "", "empty")
        .when(text.rlike(ARTIFACT) | ((F.col("origin") != "transcript") & text.rlike(CAPTION_ARTIFACT)), "artifact")
        .when(~text.rlike(r"[.!?]$"), "unterminated")
        .when(~F.size(words(text)).between(least, most), "length"),
    )
    out = s.where("_early IS NOT NULL").withColumnRenamed("_early", "reason")
    # exploding a one-element array keeps the words from being split again for each test
    s = s.where("_early IS NULL").drop("_early").withColumn("_p", F.explode(F.array(plain(text)))).withColumn("_fp", fingerprint(text))
    late = F.when(not_german(text, F.col("_p")), "not german").when(text.rlike(PICTOGRAPH), "pictograph").when(repeats(F.col("_p")), "repeats itself")
    s = s.withColumn("_late", late).drop("_p")
    first = s.where("_late IS NULL").groupBy("_fp").agg(F.min("nr").alias("_first"))
    s = s.join(first, "_fp", "left")
    s = s.withColumn("reason", F.when(F.col("_first") < F.col("nr"), "duplicate").otherwise(F.col("_late")))
    return s.drop("_fp", "_late", "_first").unionByName(out)
