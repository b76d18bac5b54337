"""The main scan of a stored corpus, narrowed by what a page wants, and the sets of units a reader starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.plans.compounds import Compounds, derivable

# Who wrote the captions that a build is made of; any other build reads hand-written ones.
BUILD_SOURCES = {"subtitle": ["manual"], "subtitle:llm": ["manual"], "subtitle:auto": ["auto"]}


def sources_for(build: Column) -> Column:
    """The kinds of captions that a build draws from, as an array."""
    pairs = [x for b, kinds in BUILD_SOURCES.items() for x in (F.lit(b), F.array(*map(F.lit, kinds)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), build), F.array(F.lit("manual")))


def german(language: Column) -> Column:
    """German, or never looked at."""
    return language.isNull() | (language == "de")


def load(sents: DataFrame, units: DataFrame, builds: list[str], teachable_only: bool = True, video=None, holding: tuple[str, str] | None = None, text: str | None = None, names: DataFrame | None = None, german_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sentences, edges) of the builds: sents (sentence_id, build, video_id, language, text, teachable, ...), units
    (sentence_id, kind, key, ...).

    video, text and holding, a (kind, key), narrow both; names (kind, key, new_kind, new_key) renames units, and drops
    those whose new_key is null. An edge comes once a sentence. Stored by build, other builds' files are not read.
    """
    s = sents.where(F.col("build").isin(*builds))
    if teachable_only:
        s = s.where("teachable")
    if german_only:
        s = s.where(german(F.col("language")))
    if video is not None:
        s = s.where(F.col("video_id") == F.lit(video))
    if text is not None:
        s = s.where(F.col("text") == text)
    if holding is not None:
        here = units.where((F.col("kind") == holding[0]) & (F.col("key") == holding[1])).select("sentence_id")
        s = s.join(here, "sentence_id", "left_semi")
    # filters on columns that the edges carry reach their scan too
    u = units
    if "build" in units.columns:
        u = u.where(F.col("build").isin(*builds))
    if video is not None and "video_id" in units.columns:
        u = u.where(F.col("video_id") == F.lit(video))
    u = u.select("sentence_id", "kind", "key").join(s.select("sentence_id"), "sentence_id", "left_semi")
    if names is not None:
        named = names.select("kind", "key", F.struct("new_kind", "new_key").alias("_new"))
        u = u.join(named, ["kind", "key"], "left").where("_new IS NULL OR _new.new_key IS NOT NULL")
        u = u.select("sentence_id", F.coalesce("_new.new_kind", "kind").alias("kind"), F.coalesce("_new.new_key", "key").alias("key"))
    return s, u.distinct()


def known_set(listed: DataFrame, marked: DataFrame, names: DataFrame, rules: Compounds | None = None) -> DataFrame:
    """(kind, key): listed and marked units, the names (kind, key, new_kind, new_key) goals teach them by beside their
    own, and the compounds that follow."""
    own = listed.select("kind", "key").unionByName(marked.select("kind", "key"))
    other = names.join(own, ["kind", "key"], "left_semi").select(F.col("new_kind").alias("kind"), F.col("new_key").alias("key"))
    return derivable(own.unionByName(other.where("key IS NOT NULL")).distinct(), rules)


def beginner_set(known: DataFrame, function_words: DataFrame, names: DataFrame, rules: Compounds | None = None) -> DataFrame:
    """(kind, key): of the known units those that are function words (word), as written or in lower case."""
    w = function_words.select("word").distinct()
    exact = known.join(w.withColumnRenamed("word", "key"), "key", "left_semi")
    low = known.withColumn("_low", F.lower("key")).join(w.withColumnRenamed("word", "_low"), "_low", "left_semi")
    own = exact.select("kind", "key").unionByName(low.select("kind", "key")).distinct()
    return known_set(own, own.limit(0), names, rules)


def lemmas_for(catalogue: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(lemma): lower-case lemmas of a catalogue (surface, lemma) that any of surfaces (surface) names, as a surface or
    as a lemma: two semi-joins, as an OR would pair everything."""
    c = catalogue.select("surface", F.lower("lemma").alias("lemma")).distinct()
    s = surfaces.select("surface").distinct()
    by_form = c.join(s, "surface", "left_semi")
    by_lemma = c.join(s.withColumnRenamed("surface", "lemma"), "lemma", "left_semi")
    return by_form.select("lemma").unionByName(by_lemma.select("lemma")).distinct()


def difficulty(units: DataFrame, gaps: DataFrame, known: DataFrame, goals: DataFrame) -> DataFrame:
    """(video_id, lines, readable, teachable, yield, unknown, comprehension): sentences without an unknown unit and with
    one, goals among those ones, and distinct unknown units."""
    per = gaps.groupBy("video_id").agg(F.count("*").alias("lines"), F.count_if(F.col("unknown") == 0).alias("readable"), F.count_if(F.col("unknown") == 1).alias("teachable"))
    ones = gaps.where("unknown = 1").select("video_id", "lo.*").distinct().join(goals.select("kind", "key"), ["kind", "key"], "left_semi")
    ones = ones.groupBy("video_id").agg(F.count("*").alias("yield"))
    new = units.select("video_id", "kind", "key").distinct().join(known.select("kind", "key"), ["kind", "key"], "left_anti")
    new = new.groupBy("video_id").agg(F.count("*").alias("unknown"))
    out = per.join(ones, "video_id", "left").join(new, "video_id", "left").fillna(0, ["yield", "unknown"])
    return out.withColumn("comprehension", F.col("readable") / F.col("lines"))


def tallies(judged: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(verdict, videos): how many got each."""
    return judged.groupBy(F.col(verdict).alias("verdict")).agg(F.count("*").alias("videos"))
