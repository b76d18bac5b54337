"""Queries of sentence and video scores, filters and example decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.catalog import GOALS, KNOWN, query
from stepwell.functions import scalars
from stepwell.operators import examples, filters, index, scores
from stepwell.queries.core import corpus
from stepwell.sources import tables

#: Sentences with their end marks, in SQL.
SAID = r"""WITH p AS (SELECT doc_id, source, regexp_extract_all(text, '[^.!?\n]+[.!?]?') AS p FROM documents),
c AS (SELECT doc_id, source, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM p),
said AS (SELECT doc_id * 1000000 + pos AS nr, doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'transcript' ELSE 'subtitle' END AS origin, trim(part) AS text FROM c WHERE trim(part) <> ''),
"""
_W = r"(CASE WHEN trim(text) = '' THEN [] ELSE regexp_split_to_array(trim(text), '\s+') END)"
QUALITY = rf"""(CASE WHEN len({_W}) < 9 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (9 - len({_W})) * 0.08::DOUBLE)
 WHEN len({_W}) > 11 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (len({_W}) - 11) * 0.06::DOUBLE) ELSE 1.0::DOUBLE END
 * CASE WHEN regexp_matches(regexp_replace(text, '\.\.\.|…', ' ', 'g'), '[.!?]\s+\S') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN contains('.…,;:)]}}»-–—', ltrim(text)[1]) AND ltrim(text)[1] <> '' OR regexp_matches(regexp_extract(text, '\p{{L}}'), '^\p{{Ll}}') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN regexp_matches(text, '\.\.\.|…') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)"""
VARIETY = f"(CASE WHEN len({_W}) > 0 THEN len(list_distinct(list_transform({_W}, lambda w: lower(w))))::DOUBLE / len({_W})::DOUBLE ELSE 0.0::DOUBLE END)"


def said(spark, sf_dir):
    """(nr, doc_id, source, origin, text): sentences with their end marks."""
    d = tables.table(spark, sf_dir, "documents")
    c = d.select("doc_id", "source", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))).alias("pos", "part"))
    origin = F.when(F.col("source").isin("src0", "src1", "src2"), "transcript").otherwise("subtitle")
    return c.where(F.trim("part") != "").select((F.col("doc_id") * 1_000_000 + F.col("pos") + 1).alias("nr"), "doc_id", "source", origin.alias("origin"), F.trim("part").alias("text"))


@query("quality_score", SAID + f"z AS (SELECT 1) SELECT nr, round({QUALITY}, 9) AS quality FROM said")
def quality_score(spark, sf_dir):
    return said(spark, sf_dir).select("nr", F.round(scalars.quality(F.col("text")), 9).alias("quality"))


@query("variety_score", SAID + f"z AS (SELECT 1) SELECT nr, round({VARIETY}, 9) AS variety FROM said")
def variety_score(spark, sf_dir):
    return said(spark, sf_dir).select("nr", F.round(scalars.variety(F.col("text")), 9).alias("variety"))


@query("well_formed_share", SAID + rf"z AS (SELECT 1) SELECT source, count(*) AS sentences, count(*) FILTER (WHERE len({_W}) BETWEEN 5 AND 25 AND NOT regexp_matches(text, '[.!?]\s+\S')) AS well_formed FROM said GROUP BY source")
def well_formed_share(spark, sf_dir):
    return said(spark, sf_dir).groupBy("source").agg(F.count("*").alias("sentences"), F.count_if(scalars.well_formed(F.col("text"))).alias("well_formed"))


_MARKS = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_REASON = SAID + rf"""
w AS (SELECT *, {_W} AS ws, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '', 'g') AS fp FROM said),
q AS (SELECT *, list_transform(ws, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}_]', '', 'g')) AS pl, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS letters FROM w),
r AS (SELECT *, list_filter(pl, lambda x: x <> '') AS p FROM q),
e AS (SELECT *, CASE WHEN regexp_matches(text, '[\[\]<>_♪*]') OR origin <> 'transcript' AND regexp_matches(text, '[…–—]|--|\.\.\.| - ') THEN 'artifact'
 WHEN NOT regexp_matches(text, '[.!?]$') THEN 'unterminated' WHEN len(ws) NOT BETWEEN 4 AND 25 THEN 'length' END AS early,
 CASE WHEN length(letters) > 0 AND length(regexp_replace(letters, '[A-Za-zÄÖÜäöüß]', '', 'g'))::DOUBLE / length(letters) > 0.2
   OR len(list_filter(pl, lambda x: x IN ({_MARKS(filters.ENGLISH)}))) >= 2 AND len(list_filter(pl, lambda x: x IN ({_MARKS(filters.ENGLISH)}))) > len(list_filter(pl, lambda x: x IN ({_MARKS(filters.GERMAN)}))) THEN 'not german'
 WHEN regexp_matches(text, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}\x{{FE0F}}\x{{2190}}-\x{{21FF}}]') THEN 'pictograph'
 WHEN len(p) = 0 OR (len(p) >= 2 AND p[1:len(p)//2] = p[len(p)//2+1:2*(len(p)//2)]) OR list_max(list_transform(list_distinct(p), lambda x: len(list_filter(p, lambda y: y = x)))) >= 3 THEN 'repeats itself' END AS late FROM r),
f AS (SELECT fp, min(nr) AS first FROM e WHERE early IS NULL AND late IS NULL GROUP BY fp),
reasons AS (SELECT e.nr, e.source, e.fp, coalesce(early, CASE WHEN first < nr THEN 'duplicate' END, late, 'kept') AS reason FROM e LEFT JOIN f USING (fp))
"""


@query("sentence_filter_reasons", _REASON + "SELECT source, reason, count(*) AS sentences FROM reasons GROUP BY source, reason")
def sentence_filter_reasons(spark, sf_dir):
    r = filters.reasons(said(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("kept")))
    return r.groupBy("source", "reason").agg(F.count("*").alias("sentences"))


@query("filter_dedup", _REASON + "SELECT nr, reason FROM reasons WHERE reason IN ('kept', 'duplicate')")
def filter_dedup(spark, sf_dir):
    r = filters.reasons(said(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("kept")))
    return r.where(F.col("reason").isin("kept", "duplicate")).select("nr", "reason")


_MIN = "mins AS (SELECT doc_id AS video_id, n_chars::DOUBLE / 900.0::DOUBLE AS minutes, floor(n_chars::DOUBLE / 75.0::DOUBLE)::BIGINT AS dialogue FROM documents)"
_BAND = "(CASE WHEN minutes IS NULL THEN 0.7::DOUBLE WHEN minutes < 10 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (10.0::DOUBLE - minutes) * 0.06::DOUBLE) ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (minutes - 10.0::DOUBLE) * 0.03::DOUBLE) END)"
_TASTE = "(CASE try_cast(substr(channel, 4) AS INTEGER) % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END)"
_SCORES = f""", {_MIN},
per AS (SELECT video_id, channel, count(*) AS lines, count(*) FILTER (WHERE unknown = 0) AS readable, count(*) FILTER (WHERE unknown = 1) AS teachable,
        count(DISTINCT lo) FILTER (WHERE unknown = 1 AND lo IN (SELECT key FROM goals)) AS teaches FROM gap GROUP BY ALL),
sc AS (SELECT *, readable::DOUBLE / lines::DOUBLE AS comprehension FROM per JOIN mins USING (video_id)),
scores AS (SELECT *, round(pow(least(comprehension / 0.95::DOUBLE, 1.0::DOUBLE), 2.0::DOUBLE) * {_BAND} * least(lines::DOUBLE / 40.0::DOUBLE, 1.0::DOUBLE)
  * CASE WHEN dialogue IS NULL OR dialogue = 0 THEN 1.0::DOUBLE ELSE least(lines::DOUBLE / dialogue::DOUBLE / 0.5::DOUBLE, 1.0::DOUBLE) END, 4) AS watch FROM sc)
"""


def video_minutes(spark, sf_dir):
    m = tables.minutes(spark, sf_dir)
    return m.withColumn("dialogue", F.floor(F.col("minutes") * 12).cast("long"))


def all_scores(spark, sf_dir):
    u, known, goals = corpus(spark, sf_dir)
    d = tables.table(spark, sf_dir, "documents")
    m = d.select(F.col("doc_id").alias("video_id"), (F.col("n_chars") / F.lit(900.0)).alias("minutes"), F.floor(F.col("n_chars") / F.lit(75.0)).cast("long").alias("dialogue"))
    return scores.video_scores(index.gap(u, known, KNOWN), m, goals, GOALS)


def taste(channel="channel"):
    n = F.substring(channel, 4, 9).try_cast("int") % 3
    return scalars.taste_weight(F.when(n == 0, "up").when(n == 1, "down"))


@query("video_scores", _SCORES + "SELECT video_id, lines, round(comprehension, 9) AS comprehension, teachable, teaches, round(minutes, 9) AS minutes, watch FROM scores", corpus=True)
def video_scores(spark, sf_dir):
    return all_scores(spark, sf_dir).select("video_id", "lines", F.round("comprehension", 9).alias("comprehension"), "teachable", "teaches", F.round("minutes", 9).alias("minutes"), "watch")


def _ranked(order: str, name: str):
    return _SCORES + f"SELECT video_id, round({name}, 6) AS value FROM (SELECT *, {order} AS {name} FROM scores) ORDER BY {name} DESC, video_id LIMIT 100"


@query("watchability_rank", _ranked("watch", "v"), corpus=True)
def watchability_rank(spark, sf_dir):
    s = all_scores(spark, sf_dir)
    return s.orderBy(F.desc("watch"), "video_id").limit(100).select("video_id", F.round("watch", 6).alias("value"))


@query("taste_rank", _SCORES + f"SELECT video_id, round(watch * {_TASTE}, 6) AS value FROM scores WHERE lines >= 10 ORDER BY watch * {_TASTE} DESC, video_id LIMIT 100", corpus=True)
def taste_rank(spark, sf_dir):
    s = all_scores(spark, sf_dir).where("lines >= 10").withColumn("v", F.col("watch") * taste())
    return s.orderBy(F.desc("v"), "video_id").limit(100).select("video_id", F.round("v", 6).alias("value"))


def _rate(name):
    return f"CASE WHEN minutes > 0 THEN {name}::DOUBLE / minutes ELSE 0.0::DOUBLE END"


@query("density_rank", _ranked(_rate("teachable"), "v"), corpus=True)
def density_rank(spark, sf_dir):
    s = all_scores(spark, sf_dir).withColumn("v", scalars.per_minute(F.col("teachable"), F.col("minutes")))
    return s.orderBy(F.desc("v"), "video_id").limit(100).select("video_id", F.round("v", 6).alias("value"))


@query("teaching_rank", _ranked(_rate("teaches"), "v"), corpus=True)
def teaching_rank(spark, sf_dir):
    s = all_scores(spark, sf_dir).withColumn("v", scalars.per_minute(F.col("teaches"), F.col("minutes")))
    return s.orderBy(F.desc("v"), "video_id").limit(100).select("video_id", F.round("v", 6).alias("value"))


@query("plan_order", _SCORES + ", plan AS (SELECT video_id, row_number() OVER (ORDER BY teaches DESC, video_id) AS pos FROM scores WHERE teaches > 0) SELECT video_id, coalesce(pos, 1000000000)::BIGINT AS pos, watch FROM scores LEFT JOIN plan USING (video_id)", corpus=True)
def plan_order(spark, sf_dir):
    """Catalogue rows with a stored plan's position; videos that are not in it come last."""
    from pyspark.sql import Window as W

    s = all_scores(spark, sf_dir)
    plan = s.where("teaches > 0").select("video_id", F.row_number().over(W.orderBy(F.desc("teaches"), "video_id")).alias("pos"))
    return s.join(plan, "video_id", "left").select("video_id", F.coalesce("pos", F.lit(1_000_000_000)).cast("long").alias("pos"), "watch")


_NEXT = ", nw AS (SELECT video_id, lo AS key, count(*) AS n FROM gap WHERE unknown = 1 GROUP BY ALL), nx AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, key) AS place FROM nw)"


@query("next_words_top8", _NEXT + " SELECT video_id, place::BIGINT AS place, key, n FROM nx WHERE place <= 8", corpus=True)
def next_words_top8(spark, sf_dir):
    u, known, _ = corpus(spark, sf_dir)
    return scores.next_words(index.gap(u, known, KNOWN)).select("video_id", F.col("place").cast("long").alias("place"), "key", "n")


@query("learn_next_panel", _NEXT + " SELECT g.video_id, key, round(n::DOUBLE / lines::DOUBLE, 9) AS gained, round((readable + n)::DOUBLE / lines::DOUBLE, 9) AS after FROM nx g JOIN (SELECT video_id, count(*) AS lines, count(*) FILTER (WHERE unknown = 0) AS readable FROM gap GROUP BY video_id) USING (video_id) WHERE place <= 8", corpus=True)
def learn_next_panel(spark, sf_dir):
    """What each next word adds to its video's readable share."""
    u, known, _ = corpus(spark, sf_dir)
    g = index.gap(u, known, KNOWN)
    per = g.groupBy("video_id").agg(F.count("*").alias("lines"), F.count_if(F.col("unknown") == 0).alias("readable"))
    n = scores.next_words(g).join(per, "video_id")
    return n.select("video_id", "key", F.round(F.col("n") / F.col("lines"), 9).alias("gained"), F.round((F.col("readable") + F.col("n")) / F.col("lines"), 9).alias("after"))


_SUPPLY = """, enough AS (SELECT video_id FROM sent GROUP BY video_id HAVING count(*) >= 40),
supply AS (SELECT g.lo AS key, g.video_id, count(DISTINCT s.text) AS n FROM gap g JOIN sent s USING (sentence_id) WHERE unknown = 1 AND g.lo IN (SELECT key FROM goals) AND g.video_id IN (SELECT video_id FROM enough) GROUP BY ALL)"""


def all_supply(spark, sf_dir):
    u, known, goals = corpus(spark, sf_dir)
    return scores.supply(index.gap(u, known, KNOWN), tables.sentences(spark, sf_dir), goals, GOALS)


@query("supply_by_video", _SUPPLY + " SELECT key, video_id, n FROM supply", corpus=True)
def supply_by_video(spark, sf_dir):
    return all_supply(spark, sf_dir).select("key", "video_id", "n")


@query("cover_audit", _SUPPLY + ", chosen AS (SELECT video_id FROM supply WHERE video_id % 2 = 0), need AS (SELECT key, least(sum(n), 5)::BIGINT AS want FROM supply GROUP BY key), got AS (SELECT key, sum(n)::BIGINT AS got FROM supply WHERE video_id IN (SELECT video_id FROM chosen) GROUP BY key) SELECT key, coalesce(got, 0)::BIGINT AS got, want FROM need LEFT JOIN got USING (key) WHERE coalesce(got, 0) < want", corpus=True)
def cover_audit(spark, sf_dir):
    """Units that a set of videos leaves short: a cover recounted without its solver."""
    s = all_supply(spark, sf_dir)
    a = scores.audit(s, s.where("video_id % 2 = 0").select("video_id").distinct(), 5)
    return a.where("got < want").select("key", F.col("got").cast("long").alias("got"), F.col("want").cast("long").alias("want"))


_EX = f""", {_MIN}, vg AS (SELECT video_id, avg(unknown) AS gap FROM gap GROUP BY video_id),
cand AS (SELECT g.key, s.sentence_id, s.text, gp.unknown - 1 AS others, l.quality::DOUBLE AS verdict, vg.gap, minutes FROM goals g JOIN unit u USING (key) JOIN gap gp USING (sentence_id) JOIN sent s USING (sentence_id)
  LEFT JOIN vg ON vg.video_id = s.video_id LEFT JOIN mins m ON m.video_id = s.video_id LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = s.video_id),
rk AS (SELECT *, {QUALITY} AS q, {VARIETY} AS v, round_even(gap, 0) AS band FROM cand)"""


def candidates(spark, sf_dir):
    """Sentences of all goals with what their rank needs."""
    s = tables.sentences(spark, sf_dir)
    u, known, goals = corpus(spark, sf_dir)
    g = index.gap(u, known, KNOWN)
    verdicts = tables.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("video_id")).agg(F.min("quality").cast("double").alias("verdict"))
    mine = u.join(F.broadcast(goals.select("kind", "key")), ["kind", "key"]).select("kind", "key", "sentence_id")
    c = mine.join(g.select("sentence_id", "unknown"), "sentence_id").join(s.select("sentence_id", "video_id", "text"), "sentence_id")
    c = c.join(index.gaps_by_video(g), "video_id", "left").join(tables.minutes(spark, sf_dir).select("video_id", "minutes"), "video_id", "left").join(verdicts, "video_id", "left")
    return c.select("kind", "key", "sentence_id", "text", (F.col("unknown") - 1).alias("others"), "verdict", "gap", "minutes")


@query("example_deck_top24", _EX + f", d AS (SELECT key, sentence_id, row_number() OVER (PARTITION BY key ORDER BY others, -coalesce(verdict, 1.0::DOUBLE), -q, band, -{_BAND}, -v, text, sentence_id) AS place FROM rk) SELECT key, place::BIGINT AS place, sentence_id FROM d WHERE place <= 24", corpus=True)
def example_deck_top24(spark, sf_dir):
    return examples.deck(candidates(spark, sf_dir)).select("key", F.col("place").cast("long").alias("place"), "sentence_id")


@query("best_example", _EX + ", d AS (SELECT key, sentence_id, row_number() OVER (PARTITION BY key ORDER BY q DESC, v DESC, text DESC, sentence_id DESC) AS place FROM rk) SELECT key, sentence_id FROM d WHERE place = 1", corpus=True)
def best_example(spark, sf_dir):
    return examples.best_example(candidates(spark, sf_dir)).select("key", "sentence_id")


_MISS = """, lost AS (SELECT u.sentence_id, u.key FROM unit u ANTI JOIN known USING (key)),
stuck AS (SELECT l.key AS goal, l.sentence_id FROM lost l JOIN goals USING (key)),
cheap AS (SELECT goal, min_by(sentence_id, unknown * 1000000000000 + sentence_id) AS sentence_id, min(unknown) - 1 AS cost FROM stuck JOIN gap USING (sentence_id) GROUP BY goal)"""


def cheapest(spark, sf_dir):
    """(goal, sentence_id, cost): for each goal the sentence with the fewest other unknowns."""
    u, known, goals = corpus(spark, sf_dir)
    g = index.gap(u, known, KNOWN).select("sentence_id", "unknown")
    mine = u.join(F.broadcast(goals.select("key")), "key").select(F.col("key").alias("goal"), "sentence_id")
    best = mine.join(g, "sentence_id").groupBy("goal").agg(F.min(F.struct("unknown", "sentence_id")).alias("b"))
    return best.select("goal", "b.sentence_id", (F.col("b.unknown") - 1).alias("cost")), index.unknown_units(u, known, KNOWN)


@query("cheapest_gap", _MISS + " SELECT cost, count(*) AS goals FROM cheap GROUP BY cost", corpus=True)
def cheapest_gap(spark, sf_dir):
    return cheapest(spark, sf_dir)[0].groupBy("cost").agg(F.count("*").alias("goals"))


@query("blocker_leverage", _MISS + " SELECT l.key, count(*) AS frees FROM cheap c JOIN lost l USING (sentence_id) WHERE l.key <> c.goal GROUP BY l.key", corpus=True)
def blocker_leverage(spark, sf_dir):
    """How many goals' cheapest sentences each other unknown stands in."""
    best, lost = cheapest(spark, sf_dir)
    return best.join(lost, "sentence_id").where("key <> goal").groupBy("key").agg(F.count("*").alias("frees"))


@query("stranded_examples_top6", _MISS + ", r AS (SELECT goal, sentence_id, row_number() OVER (PARTITION BY goal ORDER BY unknown, text, sentence_id) AS place FROM stuck JOIN gap USING (sentence_id) JOIN sent USING (sentence_id)) SELECT goal, place::BIGINT AS place, sentence_id FROM r WHERE place <= 6", corpus=True)
def stranded_examples_top6(spark, sf_dir):
    from pyspark.sql import Window as W

    u, known, goals = corpus(spark, sf_dir)
    g = index.gap(u, known, KNOWN).select("sentence_id", "unknown")
    mine = u.join(F.broadcast(goals.select("key")), "key").select(F.col("key").alias("goal"), "sentence_id")
    c = mine.join(g, "sentence_id").join(tables.sentences(spark, sf_dir).select("sentence_id", "text"), "sentence_id")
    place = F.row_number().over(W.partitionBy("goal").orderBy("unknown", "text", "sentence_id"))
    return c.withColumn("place", place).where("place <= 6").select("goal", F.col("place").cast("long").alias("place"), "sentence_id")
