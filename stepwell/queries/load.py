"""Queries of the main scan with each of its options, of what a reader starts from, and reports over both."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.catalog import GOALS, KNOWN, SQL, query
from stepwell.operators import corpus as store
from stepwell.operators import index, vocabulary
from stepwell.plans import reach
from stepwell.queries.core import corpus
from stepwell.queries.language import _ALIAS, _TOK, listed, punctuation_gate, tokens
from stepwell.queries.plans import _closure, staged
from stepwell.sources import sinks, tables

#: Channels stand for builds; sentences of four to 25 words are worth teaching.
BUILDS = ["src1", "src2", "src3"]
_STORE = """, s AS (SELECT sentence_id, channel AS build, video_id, language, text, len(string_split(text, ' ')) BETWEEN 4 AND 25 AS teachable FROM sent),
b AS (SELECT * FROM s WHERE build IN ('src1', 'src2', 'src3')), g AS (SELECT * FROM b WHERE teachable AND (language IS NULL OR language = 'de')),
word AS (SELECT key FROM goals WHERE rank = 0)"""
_SENTS = " SELECT sentence_id, build, video_id, text FROM "


def stored(spark, sf_dir):
    """(sentences, units) as a store holds them."""
    s = tables.sentences(spark, sf_dir)
    u = tables.units(s).withColumnRenamed("channel", "build")
    return s.select("sentence_id", F.col("channel").alias("build"), "video_id", "language", "text", F.size(F.split("text", " ")).between(4, 25).alias("teachable")), u


def _shown(s):
    return s.select("sentence_id", "build", "video_id", "text")


@query("corpus_load", _STORE + _SENTS + "g", corpus=True)
def corpus_load(spark, sf_dir):
    return _shown(store.load(*stored(spark, sf_dir), BUILDS)[0])


@query("corpus_load_units", _STORE + " SELECT u.sentence_id, u.key FROM unit u SEMI JOIN g USING (sentence_id)", corpus=True)
def corpus_load_units(spark, sf_dir):
    return store.load(*stored(spark, sf_dir), BUILDS)[1].select("sentence_id", "key")


@query("corpus_load_overlay", _STORE + _SENTS + "s WHERE video_id = 7", corpus=True)
def corpus_load_overlay(spark, sf_dir):
    """All that one video says, in any language, worth teaching or not."""
    return _shown(store.load(*stored(spark, sf_dir), [f"src{i}" for i in range(20)], teachable_only=False, german_only=False, video=7)[0])


@query("corpus_load_holding", _STORE + ", h AS (SELECT sentence_id FROM unit WHERE key = 'the') SELECT sentence_id, build, video_id, text FROM b WHERE teachable AND sentence_id IN (SELECT sentence_id FROM h)", corpus=True)
def corpus_load_holding(spark, sf_dir):
    return _shown(store.load(*stored(spark, sf_dir), BUILDS, german_only=False, holding=("lemma", "the"))[0])


@query("corpus_load_text", _STORE + _SENTS + "s WHERE text = (SELECT min(text) FROM s)", corpus=True)
def corpus_load_text(spark, sf_dir):
    """Every sentence that consists of one given text, here the least of all."""
    s, u = stored(spark, sf_dir)
    return _shown(store.load(s, u, [f"src{i}" for i in range(20)], teachable_only=False, german_only=False, text=s.agg(F.min("text")).first()[0])[0])


@query("corpus_load_resolved", _ALIAS + _STORE + " SELECT DISTINCT u.sentence_id, r.new_key AS key FROM unit u SEMI JOIN g USING (sentence_id) JOIN res r ON r.key = u.key", corpus=True)
def corpus_load_resolved(spark, sf_dir):
    """The edges under the names that the goals teach them by."""
    s, u = stored(spark, sf_dir)
    names = vocabulary.resolve(u, listed(spark, sf_dir)[1], GOALS)
    return store.load(s, u, BUILDS, names=names)[1].select("sentence_id", "key")


_KNOWN = _ALIAS + """, own AS (SELECT key FROM known UNION SELECT key FROM goals WHERE rank % 7 = 0),
mine AS (SELECT key FROM own UNION SELECT new_key FROM res WHERE key IN (SELECT key FROM own)),
small AS (SELECT key FROM known WHERE length(key) <= 3), first AS (SELECT key FROM mine WHERE key IN (SELECT key FROM small) OR lower(key) IN (SELECT key FROM small))"""


def mine(spark, sf_dir):
    """(known units, names): listed ones, every seventh goal as marked, and their names."""
    u, known, goals = corpus(spark, sf_dir)
    names = vocabulary.resolve(u, listed(spark, sf_dir)[1], GOALS)
    return known, store.known_set(known, goals.where("rank % 7 = 0"), names), names


@query("known_set", _KNOWN + " SELECT key FROM mine", corpus=True)
def known_set(spark, sf_dir):
    return mine(spark, sf_dir)[1].select("key")


@query("beginner_set", _KNOWN + " SELECT key FROM first UNION SELECT new_key FROM res WHERE key IN (SELECT key FROM first)", corpus=True)
def beginner_set(spark, sf_dir):
    known, own, names = mine(spark, sf_dir)
    return store.beginner_set(own, known.where(F.length("key") <= 3).select(F.col("key").alias("word")), names).select("key")


@query("lemmas_for_surfaces", _TOK + " SELECT DISTINCT lower(lemma) AS lemma FROM tk WHERE surface IN (SELECT key FROM goals) OR lower(lemma) IN (SELECT key FROM goals)", corpus=True)
def lemmas_for_surfaces(spark, sf_dir):
    goals = corpus(spark, sf_dir)[2]
    return store.lemmas_for(tokens(spark, sf_dir), goals.select(F.col("key").alias("surface")))


_DIFFICULTY = """, p AS (SELECT video_id, count(*) AS lines, count(*) FILTER (WHERE unknown = 0) AS readable, count(*) FILTER (WHERE unknown = 1) AS teachable,
count(DISTINCT lo) FILTER (WHERE unknown = 1 AND lo IN (SELECT key FROM goals)) AS yield FROM gap GROUP BY video_id),
n AS (SELECT video_id, count(DISTINCT key) AS unknown FROM unit WHERE key NOT IN (SELECT key FROM known) GROUP BY video_id)
SELECT p.*, coalesce(n.unknown, 0) AS unknown, round(readable::DOUBLE / lines::DOUBLE, 9) AS comprehension FROM p LEFT JOIN n USING (video_id)"""


@query("difficulty_rows", _DIFFICULTY, corpus=True)
def difficulty_rows(spark, sf_dir):
    u, known, goals = corpus(spark, sf_dir)
    d = store.difficulty(u, index.gap(u, known, KNOWN), index.sized(known, KNOWN), index.sized(goals, GOALS))
    return d.withColumn("comprehension", F.round("comprehension", 9))


@query("verdict_tallies", f"SELECT verdict, count(*) AS videos FROM ({SQL['punctuation_gate']}) GROUP BY verdict")
def verdict_tallies(spark, sf_dir):
    return store.tallies(punctuation_gate(spark, sf_dir))


_SHOWN = ", shown AS MATERIALIZED (SELECT u.* FROM unit u JOIN sent s USING (sentence_id) WHERE len(string_split(text, ' ')) BETWEEN 4 AND 25)"
_LOST = """ SELECT g.key, CASE WHEN g.key IN (SELECT key FROM shown) THEN 'crowded' ELSE 'said never shown' END AS why
FROM goals g WHERE g.key NOT IN (SELECT key FROM learned)"""


@query("out_of_reach", _closure(0, "shown", _SHOWN) + _LOST)
def out_of_reach(spark, sf_dir):
    """Goals that sentences worth teaching never leave alone, by what it would take."""
    u, known, goals = staged(spark, sf_dir)
    s, _ = stored(spark, sf_dir)
    shown = u.join(s.where("teachable").select("sentence_id"), "sentence_id", "left_semi")
    r = reach.reachable(shown, known, goals)
    return sinks.out_of_reach(goals, r.known, index.unit_counts(shown), u.select("key").distinct())
