"""Queries of the unknown-count index and the counts around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.catalog import GOALS, KNOWN, query
from stepwell.operators import index
from stepwell.sources import tables


def corpus(spark, sf_dir):
    """(units, known, goals) of the folder's corpus."""
    u = tables.units(tables.sentences(spark, sf_dir))
    known, goals = index.split_known(u, KNOWN, GOALS)
    return u, known, goals


def gaps(spark, sf_dir):
    u, known, _ = corpus(spark, sf_dir)
    return index.gap(u, known, KNOWN)


@query("gap_histogram", "SELECT unknown, count(*) AS sentences FROM gap GROUP BY unknown", corpus=True)
def gap_histogram(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("unknown").agg(F.count("*").alias("sentences"))


@query("readable_count", "SELECT channel, count(*) FILTER (WHERE unknown = 0) AS readable, count(*) AS sentences FROM gap GROUP BY channel", corpus=True)
def readable_count(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("channel").agg(F.count_if(F.col("unknown") == 0).alias("readable"), F.count("*").alias("sentences"))


@query("frontier_units", "SELECT lo AS key, count(*) AS candidates FROM gap WHERE unknown = 1 GROUP BY lo", corpus=True)
def frontier_units(spark, sf_dir):
    return index.frontier(gaps(spark, sf_dir)).select("key", "candidates")


@query("lookahead_units", "SELECT key, count(*) AS unlocks FROM (SELECT unnest([lo, hi]) AS key FROM gap WHERE unknown = 2) GROUP BY key", corpus=True)
def lookahead_units(spark, sf_dir):
    return index.lookahead(gaps(spark, sf_dir)).select("key", "unlocks")


_STEPS = f""", f AS (SELECT lo AS key, count(*) AS c FROM gap WHERE unknown = 1 GROUP BY lo),
l AS (SELECT key, count(*) AS n FROM (SELECT unnest([lo, hi]) AS key FROM gap WHERE unknown = 2) GROUP BY key),
steps AS (SELECT f.key, (c + coalesce(n, 0))::BIGINT AS gain, (c + coalesce(n, 0))::DOUBLE + 3.0::DOUBLE * coalesce(1.0::DOUBLE - rank::DOUBLE / {GOALS}.0::DOUBLE, 0.0::DOUBLE) AS score
          FROM f LEFT JOIN l USING (key) LEFT JOIN goals USING (key))"""


@query("plan_next_step", _STEPS + " SELECT key, gain, round(score, 9) AS score FROM steps ORDER BY score DESC, key DESC LIMIT 1", corpus=True)
def plan_next_step(spark, sf_dir):
    u, known, goals = corpus(spark, sf_dir)
    best = index.best_step(index.next_steps(index.gap(u, known, KNOWN), goals))
    return best.select("key", "gain", F.round("score", 9).alias("score"))


@query("step_scores", _STEPS + " SELECT key, gain, round(score, 6) AS score FROM steps", corpus=True)
def step_scores(spark, sf_dir):
    u, known, goals = corpus(spark, sf_dir)
    return index.next_steps(index.gap(u, known, KNOWN), goals).select("key", "gain", F.round("score", 6).alias("score"))


@query("unit_counts", "SELECT 'lemma' AS kind, key, said FROM cnt", corpus=True)
def unit_counts(spark, sf_dir):
    return index.unit_counts(tables.units(tables.sentences(spark, sf_dir)))


@query("unit_counts_by_build", "SELECT channel AS build, key, count(*) AS said FROM unit GROUP BY ALL", corpus=True)
def unit_counts_by_build(spark, sf_dir):
    u = tables.units(tables.sentences(spark, sf_dir))
    return index.unit_counts(u.withColumnRenamed("channel", "build"), "build").select("build", "key", "said")


@query("builds_count", "SELECT channel AS build, count(*) AS sentences FROM sent WHERE channel <> 'src7' GROUP BY channel", corpus=True)
def builds_count(spark, sf_dir):
    s = tables.sentences(spark, sf_dir).where(F.col("channel") != "src7")
    return s.groupBy(F.col("channel").alias("build")).agg(F.count("*").alias("sentences"))


@query("lemma_keys", "SELECT DISTINCT key FROM unit", corpus=True)
def lemma_keys(spark, sf_dir):
    return tables.units(tables.sentences(spark, sf_dir)).where("kind = 'lemma'").select("key").distinct()


@query("lines_per_source", "SELECT channel, count(*) AS lines, count(DISTINCT video_id) AS videos FROM sent GROUP BY channel", corpus=True)
def lines_per_source(spark, sf_dir):
    per = tables.sentences(spark, sf_dir).groupBy("channel", "video_id").agg(F.count("*").alias("n"))
    return per.groupBy("channel").agg(F.sum("n").alias("lines"), F.count("*").alias("videos"))


@query("lines_per_video", "SELECT video_id, count(*) AS lines FROM sent GROUP BY video_id", corpus=True)
def lines_per_video(spark, sf_dir):
    return tables.sentences(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("lines"))


@query("video_ids", "SELECT DISTINCT video_id FROM sent", corpus=True)
def video_ids(spark, sf_dir):
    return tables.sentences(spark, sf_dir).select("video_id").distinct()


@query("gaps_by_video", "SELECT video_id, round(avg(unknown), 9) AS gap FROM gap GROUP BY video_id", corpus=True)
def gaps_by_video(spark, sf_dir):
    return index.gaps_by_video(gaps(spark, sf_dir)).select("video_id", F.round("gap", 9).alias("gap"))


@query("two_unknown_degree", "SELECT key, count(*) AS degree, count(DISTINCT other) AS partners FROM (SELECT lo AS key, hi AS other FROM gap WHERE unknown = 2 UNION ALL SELECT hi, lo FROM gap WHERE unknown = 2) GROUP BY key", corpus=True)
def two_unknown_degree(spark, sf_dir):
    two = gaps(spark, sf_dir).where("unknown = 2")
    ends = two.select(F.explode(F.array(F.struct(F.col("lo.key").alias("key"), F.col("hi.key").alias("other")), F.struct(F.col("hi.key").alias("key"), F.col("lo.key").alias("other")))).alias("e")).select("e.*")
    return ends.groupBy("key", "other").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("degree"), F.count("*").alias("partners"))


@query("holding_sentences", "SELECT s.sentence_id, s.text FROM sent s WHERE sentence_id IN (SELECT sentence_id FROM unit WHERE key = (SELECT key FROM goals WHERE rank = 0))", corpus=True)
def holding_sentences(spark, sf_dir):
    """Sentences that hold one unit: a semi-join on its edges."""
    s = tables.sentences(spark, sf_dir)
    u = tables.units(s)
    wanted = index.split_known(u, KNOWN, 1)[1].select("key")
    return s.join(u.join(F.broadcast(wanted), "key", "left_semi").select("sentence_id"), "sentence_id", "left_semi").select("sentence_id", "text")


@query("example_texts", "SELECT DISTINCT text FROM sent WHERE sentence_id IN (SELECT sentence_id FROM unit WHERE key = (SELECT key FROM goals WHERE rank = 0)) AND length(text) - length(replace(text, ' ', '')) + 1 BETWEEN 5 AND 25 ORDER BY text LIMIT 50", corpus=True)
def example_texts(spark, sf_dir):
    s = holding_sentences(spark, sf_dir)
    n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return s.where(n.between(5, 25)).select("text").distinct().orderBy("text").limit(50)


@query("goal_overlap", "SELECT video_id, count(DISTINCT key) AS goals FROM unit WHERE key IN (SELECT key FROM goals) GROUP BY video_id", corpus=True)
def goal_overlap(spark, sf_dir):
    u, _, goals = corpus(spark, sf_dir)
    seen = u.join(index.sized(goals.select("key"), GOALS), "key", "left_semi").select("video_id", "key").distinct()
    return seen.groupBy("video_id").agg(F.count("*").alias("goals"))


@query("known_intersection", "SELECT key FROM unit INTERSECT SELECT key FROM known", corpus=True)
def known_intersection(spark, sf_dir):
    u, known, _ = corpus(spark, sf_dir)
    return u.select("key").intersect(known.select("key"))


@query("unsaid_units", "SELECT key FROM cnt EXCEPT (SELECT key FROM known UNION SELECT key FROM goals)", corpus=True)
def unsaid_units(spark, sf_dir):
    u, known, goals = corpus(spark, sf_dir)
    return u.select("key").distinct().subtract(known.select("key").union(goals.select("key")))


@query("priority_rank", f"SELECT key, rank::BIGINT AS rank, round(1.0::DOUBLE - rank::DOUBLE / {GOALS}.0::DOUBLE, 9) AS priority FROM goals", corpus=True)
def priority_rank(spark, sf_dir):
    _, _, goals = corpus(spark, sf_dir)
    return goals.select("key", F.col("rank").cast("long").alias("rank"), F.round(1.0 - F.col("rank") / F.lit(float(GOALS)), 9).alias("priority"))


_GRAPH = """WITH e AS (SELECT DISTINCT l_orderkey AS sentence_id, l_partkey AS part FROM lineitem),
c AS (SELECT part, count(*) AS said FROM e GROUP BY part), k AS (SELECT part FROM c ORDER BY said DESC, part LIMIT 300),
g AS (SELECT sentence_id, count(*) FILTER (WHERE k.part IS NULL) AS unknown FROM e LEFT JOIN k USING (part) GROUP BY sentence_id)"""


@query("graph_gap", _GRAPH + " SELECT unknown, count(*) AS sentences FROM g GROUP BY unknown")
def graph_gap(spark, sf_dir):
    """The gap histogram of orders as sentences whose parts are units, the 300 commonest known."""
    e = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_partkey").alias("part")).distinct()
    known = e.groupBy("part").agg(F.count("*").alias("said")).orderBy(F.desc("said"), "part").limit(KNOWN).select("part", F.lit(True).alias("is_known"))
    per = e.join(F.broadcast(known), "part", "left").groupBy("sentence_id").agg(F.count_if(F.col("is_known").isNull()).alias("unknown"))
    return per.groupBy("unknown").agg(F.count("*").alias("sentences"))
