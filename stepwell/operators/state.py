"""The reader's state as folds of event rows: review cards, snoozes, the known set, attempts, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.functions.scalars import snooze_wait

# Fixed values of the review schedule.
EASE, FIRST_INTERVAL, BONUS, PENALTY, MOST_EASE, LEAST_EASE, MOST_DAYS = 2.5, 1.0, 0.05, 0.15, 3.0, 1.3, 3650.0
# Outcomes of attempts that settle a video at once, and the tries after which any other does.
SETTLED = ("no-subtitles", "unavailable", "off-target", "wrong-language")
AUTO_SETTLED = ("unavailable", "off-target", "wrong-language", "unpunctuated", "not-german", "too-short")
GIVE_UP = 3


def latest(events: DataFrame, by: list[str], *values: str) -> DataFrame:
    """Last-write-wins: of each key the values of the event with the greatest (ts, seq)."""
    return events.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct("ts", "seq")).alias("v")).select(*by, "v.*")


def review(state: Column, correct: Column, ts: Column) -> Column:
    """One review of a card: struct (interval, ease, reps, due_us, last), times in microseconds."""
    interval = F.when(correct, F.least(state["interval"] * state["ease"], F.lit(MOST_DAYS))).otherwise(F.lit(FIRST_INTERVAL))
    ease = F.when(correct, F.least(state["ease"] + BONUS, F.lit(MOST_EASE))).otherwise(F.greatest(state["ease"] - PENALTY, F.lit(LEAST_EASE)))
    reps = F.when(correct, state["reps"] + 1).otherwise(F.lit(0))
    return F.struct(interval.alias("interval"), ease.alias("ease"), reps.alias("reps"), ts.alias("last"))


def cards(events: DataFrame, by: str = "key") -> DataFrame:
    """(by, interval_days, ease_factor, repetitions, due_date, last_review) after all reviews (ts, seq, correct) in order.

    The fold runs inside one expression; a card's reviews are as many as a reader has made of one unit.
    """
    log = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), "seq", "correct")))
    start = F.struct(F.lit(FIRST_INTERVAL).alias("interval"), F.lit(EASE).alias("ease"), F.lit(0).alias("reps"), F.lit(None).cast("long").alias("last"))
    done = events.groupBy(by).agg(log.alias("log")).withColumn("s", F.aggregate("log", start, lambda s, e: review(s, e["correct"], e["us"])))
    due = F.timestamp_micros(F.col("s.last") + F.round(F.col("s.interval") * 86_400_000_000.0).cast("long"))
    return done.select(by, F.col("s.interval").alias("interval_days"), F.col("s.ease").alias("ease_factor"), F.col("s.reps").alias("repetitions"), due.alias("due_date"), F.timestamp_micros("s.last").alias("last_review"))


def due(held: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    return held.where(F.col("due_date") <= now).orderBy("due_date", "key").limit(limit)


def snoozed(events: DataFrame, who: str = "user_id") -> DataFrame:
    """(who, key, wake_tick, times, tick): units set aside by `who`'s decisions (ts, seq, key, action).

    Each decision (learn or snooze) moves the reader's clock on by one; wake does not. A wake or a learn forgets the
    snoozes before it; each snooze after that waits twice as long as the one before.
    """
    order = W.partitionBy(who).orderBy("ts", "seq")
    counts = F.when(F.col("action").isin("learn", "snooze"), 1).otherwise(0)
    e = events.withColumn("tick", F.sum(counts).over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(who, "key").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("life", F.sum(F.when(F.col("action").isin("wake", "learn"), 1).otherwise(0)).over(own))
    last = e.groupBy(who).agg(F.max("tick").alias("now"))
    per = e.groupBy(who, "key").agg(F.max("life").alias("life"))
    alive = e.where("action = 'snooze'").join(per, [who, "key", "life"]).groupBy(who, "key").agg(F.max("tick").alias("at"), F.count("*").alias("times"))
    return alive.join(last, who).select(who, "key", (F.col("at") + snooze_wait(F.col("times"))).alias("wake_tick"), "times", F.col("now").alias("tick"))


def asleep(held: DataFrame) -> DataFrame:
    """Snoozed units that still sleep, with the decisions each has left."""
    return held.where("wake_tick > tick").withColumn("left", F.col("wake_tick") - F.col("tick"))


def known_versions(events: DataFrame, who: str = "user_id") -> DataFrame:
    """(who, version, known): effective changes of the known set by mark and unmark events, and its size after them."""
    own = W.partitionBy(who, "key").orderBy("ts", "seq")
    mark = F.col("action") == "mark"
    before = F.coalesce(F.lag(mark).over(own), F.lit(False))
    last = F.row_number().over(W.partitionBy(who, "key").orderBy(F.desc("ts"), F.desc("seq"))) == 1
    e = events.withColumn("changed", mark != before).withColumn("is_known", last & mark)
    return e.groupBy(who).agg(F.count_if("changed").alias("version"), F.count_if("is_known").alias("known"))


def classify(message: Column) -> Column:
    """Which kind of refusal a message tells of; the first rule that holds."""
    low = F.lower(message)
    # fixed values: phrases and outcomes, in order
    rules = [
        ("blocked", "not a bot", "sign in to confirm"),
        ("throttled", "429", "too many requests"),
        ("unfetchable", "metadata could not be fetched", "refused"),
        ("unavailable", "no such video", "unavailable"),
        ("unfetchable", "could not be inspected"),
        ("off-target", "off target"),
        ("no-subtitles", "auto-generated"),
        ("no-subtitles", "subtitle"),
    ]
    out = None
    for outcome, *phrases in rules:
        test = F.lit(False)
        for p in phrases:
            test = test | F.contains(low, F.lit(p))
        out = F.when(test, outcome) if out is None else out.when(test, outcome)
    return out.otherwise("error")


def attempts(log: DataFrame) -> DataFrame:
    """(video_id, tries, outcome): an attempt log's tries and last outcome."""
    return log.groupBy("video_id").agg(F.count("*").alias("tries"), F.max_by("outcome", F.struct("ts", "seq")).alias("outcome"))


def settled(held: DataFrame, auto: bool = False) -> DataFrame:
    """Videos there is no point asking about again."""
    sure = F.col("outcome").isin(*(AUTO_SETTLED if auto else SETTLED))
    return held.where(sure | (~F.col("outcome").isin("added", "throttled") & (F.col("tries") >= GIVE_UP)))


def search_rota(searches: DataFrame, goals: DataFrame, give_up: int = 2) -> DataFrame:
    """(key, tries) of goals still to be searched for: those tried fewer than `give_up` times; if none is left, all anew."""
    tried = searches.groupBy("key").agg(F.count("*").alias("tries"))
    g = goals.select("key").join(tried, "key", "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    low = g.agg(F.min("tries").alias("low"))
    g = g.join(F.broadcast(low))
    wiped = F.col("low") >= give_up
    return g.where(wiped | (F.col("tries") < give_up)).select("key", F.when(wiped, 0).otherwise(F.col("tries")).alias("tries"))


def insert_or_ignore(held: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """held with those of new whose key it lacks."""
    return held.unionByName(new.join(held.select(*by), by, "left_anti").select(*held.columns))


def corrected(sents: DataFrame, fixes: DataFrame, hidden: DataFrame) -> DataFrame:
    """Sentences without hidden texts, corrected where a fix (text, new_text) exists."""
    s = sents.join(hidden.select("text"), "text", "left_anti").join(fixes.select("text", "new_text"), "text", "left")
    return s.withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
