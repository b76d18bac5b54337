"""Queries of the reader's state, folded from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.catalog import query
from stepwell.operators import state
from stepwell.sources import tables


def events(spark, sf_dir):
    """Events as study decisions: `key` is the number in props, actions come from the event's type."""
    e = tables.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("key"), kind.alias("event_type"), "value",
        (F.col("value") >= 34.0).alias("correct"),
        F.when(kind == "purchase", "learn").when(kind == "error", "wake").otherwise("snooze").alias("action"),
    )


_EV = """WITH ev AS (SELECT user_id, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS key, event_type, value, value >= 34.0 AS correct,
CASE event_type WHEN 'purchase' THEN 'learn' WHEN 'error' THEN 'wake' ELSE 'snooze' END AS action FROM events)"""


_SN = _EV + """, t AS (SELECT *, sum(CASE WHEN action IN ('learn', 'snooze') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tick,
 sum(CASE WHEN action IN ('wake', 'learn') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM ev),
n AS (SELECT user_id, max(tick) AS tick FROM t GROUP BY user_id), lf AS (SELECT user_id, key, max(life) AS life FROM t GROUP BY ALL),
s AS (SELECT t.user_id, t.key, max(t.tick) AS last, count(*) AS times FROM t JOIN lf USING (user_id, key, life) WHERE action = 'snooze' GROUP BY ALL),
held AS (SELECT s.user_id, key, (last + least(20 * pow(2, times - 1), 200))::BIGINT AS wake_tick, times, n.tick::BIGINT AS tick FROM s JOIN n USING (user_id))"""


@query("snooze_asleep", _SN + " SELECT user_id, key, times, wake_tick - tick AS remaining FROM held WHERE wake_tick > tick")
def snooze_asleep(spark, sf_dir):
    held = state.asleep(state.snoozed(events(spark, sf_dir)))
    return held.select("user_id", "key", "times", F.col("left").alias("remaining"))


@query("known_version", _EV + """, m AS (SELECT *, event_type <> 'error' AS mark FROM ev), c AS (SELECT *, mark <> coalesce(lag(mark) OVER (PARTITION BY user_id, key ORDER BY ts, seq), false) AS changed,
row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, seq DESC) = 1 AND mark AS is_known FROM m) SELECT user_id, count(*) FILTER (WHERE changed) AS version, count(*) FILTER (WHERE is_known) AS known FROM c GROUP BY user_id""")
def known_version(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("action", F.when(F.col("event_type") == "error", "unmark").otherwise("mark"))
    return state.known_versions(e)


_AT = _EV + """, a AS (SELECT key AS video_id, count(*) AS tries, arg_max(o, (ts, seq)) AS outcome FROM (SELECT *, CASE event_type WHEN 'error' THEN 'throttled' WHEN 'purchase' THEN 'added' WHEN 'signup' THEN 'off-target' ELSE 'unfetchable' END AS o FROM ev) GROUP BY key)"""


def attempt_log(spark, sf_dir):
    e = events(spark, sf_dir)
    o = F.when(F.col("event_type") == "error", "throttled").when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "signup", "off-target").otherwise("unfetchable")
    return e.select(F.col("key").alias("video_id"), "ts", "seq", o.alias("outcome"))


@query("attempts_settled", _AT + " SELECT video_id, tries, outcome FROM a WHERE outcome IN ('no-subtitles', 'unavailable', 'off-target', 'wrong-language') OR (outcome NOT IN ('added', 'throttled') AND tries >= 3)")
def attempts_settled(spark, sf_dir):
    return state.settled(state.attempts(attempt_log(spark, sf_dir)))


@query("attempt_counts", _AT + " SELECT outcome, count(*) AS videos FROM a GROUP BY outcome")
def attempt_counts(spark, sf_dir):
    return state.attempts(attempt_log(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("videos"))


@query("search_rota", _EV + ", g AS (SELECT range AS key FROM range(120)), t AS (SELECT g.key, count(ev.key) AS tries FROM g LEFT JOIN ev ON ev.key = g.key AND event_type = 'signup' AND user_id = 7 GROUP BY g.key), w AS (SELECT *, min(tries) OVER () AS low FROM t) SELECT key, (CASE WHEN low >= 2 THEN 0 ELSE tries END)::BIGINT AS tries FROM w WHERE low >= 2 OR tries < 2")
def search_rota(spark, sf_dir):
    """Goals whose searches have not been given up."""
    tried = events(spark, sf_dir).where("event_type = 'signup' AND user_id = 7").select(F.col("key").cast("long").alias("key"))
    r = state.search_rota(tried, spark.range(120).withColumnRenamed("id", "key"))
    return r.select("key", F.col("tries").cast("long").alias("tries"))


@query("card_overview", _EV + ", r AS (SELECT key, arg_max(correct, (ts, seq)) AS correct, max(ts) AS last_review, count(*) AS reviews FROM ev GROUP BY key) SELECT key, correct, reviews FROM r")
def card_overview(spark, sf_dir):
    e = events(spark, sf_dir)
    last = state.latest(e, ["key"], "correct")
    return last.join(e.groupBy("key").agg(F.count("*").alias("reviews")), "key").select("key", "correct", "reviews")


@query("due_cards", _EV + ", f AS (SELECT key, min(ts) AS first FROM ev GROUP BY key), m AS (SELECT max(ts) AS now FROM ev) SELECT key FROM f, m WHERE first + INTERVAL 1 DAY <= now ORDER BY first, key LIMIT 20")
def due_cards(spark, sf_dir):
    """New cards are due a day after they were first met; the soonest twenty."""
    e = events(spark, sf_dir)
    held = e.groupBy("key").agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("due_date"))
    now = e.agg(F.max("ts").alias("now"))
    d = held.join(F.broadcast(now))
    return state.due(d, F.col("now")).select("key")


@query("taste_latest", _EV + " SELECT user_id, arg_max(event_type, (ts, seq)) AS taste FROM ev GROUP BY user_id")
def taste_latest(spark, sf_dir):
    return state.latest(events(spark, sf_dir), ["user_id"], "event_type").select("user_id", F.col("event_type").alias("taste"))


_SM2 = _EV.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, o AS (SELECT key, correct, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n FROM ev),
f AS (SELECT key, 0::BIGINT AS n, 1.0::DOUBLE AS days, 2.5::DOUBLE AS ease, 0 AS reps FROM ev GROUP BY key UNION ALL
SELECT f.key, o.n, CASE WHEN correct THEN least(days * ease, 3650.0::DOUBLE) ELSE 1.0::DOUBLE END,
CASE WHEN correct THEN least(ease + 0.05::DOUBLE, 3.0::DOUBLE) ELSE greatest(ease - 0.15::DOUBLE, 1.3::DOUBLE) END, CASE WHEN correct THEN reps + 1 ELSE 0 END
FROM f JOIN o ON o.key IS NOT DISTINCT FROM f.key AND o.n = f.n + 1)
SELECT key, round(arg_max(days, n), 6) AS interval_days, round(arg_max(ease, n), 6) AS ease_factor, arg_max(reps, n)::INTEGER AS repetitions FROM f GROUP BY key"""


@query("sm2_fold", _SM2)
def sm2_fold(spark, sf_dir):
    """Every card after all its reviews in order."""
    c = state.cards(events(spark, sf_dir))
    return c.select("key", F.round("interval_days", 6).alias("interval_days"), F.round("ease_factor", 6).alias("ease_factor"), "repetitions")


@query("refusal_kinds", "SELECT CASE WHEN contains(lower(text), '429') OR contains(lower(text), 'too many requests') THEN 'throttled' WHEN contains(lower(text), 'refused') THEN 'unfetchable' WHEN contains(lower(text), 'unavailable') THEN 'unavailable' WHEN contains(lower(text), 'off target') THEN 'off-target' WHEN contains(lower(text), 'subtitle') THEN 'no-subtitles' ELSE 'error' END AS outcome, count(*) AS texts FROM documents GROUP BY 1")
def refusal_kinds(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.groupBy(state.classify(F.col("text")).alias("outcome")).agg(F.count("*").alias("texts"))
