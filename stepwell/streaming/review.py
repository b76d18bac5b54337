"""The reader's state kept by Structured Streaming: review cards, snoozes, and scores of touched videos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stepwell.operators import state as batch
from stepwell.session import ship

CARD = "key string, interval_days double, ease_factor double, repetitions int, due_date timestamp, last_review timestamp"


def cards(events: DataFrame) -> DataFrame:
    """A stream of reviews (key string, ts, seq, correct) as a stream of cards, one row for each key that a batch touched.

    Reviews of a batch are taken in (ts, seq) order; a stream read in that order ends as the batch fold does.
    """
    ship(events.sparkSession)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        interval, ease, reps = state.get if state.exists else (batch.FIRST_INTERVAL, batch.EASE, 0)
        last = None
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        for ts, ok in zip(rows["ts"], rows["correct"]):
            if ok:
                interval, ease, reps = min(interval * ease, batch.MOST_DAYS), min(ease + batch.BONUS, batch.MOST_EASE), reps + 1
            else:
                interval, ease, reps = batch.FIRST_INTERVAL, max(ease - batch.PENALTY, batch.LEAST_EASE), 0
            last = ts
        state.update((interval, ease, reps))
        due = last + timedelta(days=interval)
        yield pd.DataFrame({"key": [key[0]], "interval_days": [interval], "ease_factor": [ease], "repetitions": [reps], "due_date": [due], "last_review": [last]})

    return events.groupBy("key").applyInPandasWithState(update, CARD, "interval double, ease double, reps int", "update", GroupStateTimeout.NoTimeout)


SNOOZED = "user_id long, key string, wake_tick long, times long, tick long"


def snoozes(events: DataFrame) -> DataFrame:
    """A stream of decisions (user_id, key string, ts, seq, action) as each touched reader's sleeping units.

    State is a reader's clock and open snoozes, which a reader's own decisions bound.
    """
    ship(events.sparkSession)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tick, keys, wakes, times = state.get if state.exists else (0, [], [], [])
        held = {k: (w, n) for k, w, n in zip(keys, wakes, times)}
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        for unit, action in zip(rows["key"], rows["action"]):
            tick += action in ("learn", "snooze")
            if action == "snooze":
                n = held.get(unit, (0, 0))[1] + 1
                held[unit] = (tick + min(20 * 2 ** (n - 1), 200), n)
            else:
                held.pop(unit, None)
        names = sorted(held)
        state.update((tick, names, [held[k][0] for k in names], [held[k][1] for k in names]))
        yield pd.DataFrame([(key[0], k, *held[k], tick) for k in names], columns=[c.split()[0] for c in SNOOZED.split(", ")])

    kept = "tick long, keys array<string>, wakes array<long>, times array<long>"
    return events.groupBy("user_id").applyInPandasWithState(update, SNOOZED, kept, "update", GroupStateTimeout.NoTimeout)


def study_events(spark, path: str) -> DataFrame:
    """A stream of new event files, one file a batch."""
    static = spark.read.parquet(path)
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(path)


def latest_cards(updates: DataFrame) -> DataFrame:
    """Of all updates of a card the last."""
    return updates.groupBy("key").agg(F.max_by(F.struct("interval_days", "ease_factor", "repetitions", "due_date", "last_review"), "last_review").alias("c")).select("key", "c.*")


def rescore(units: DataFrame, score: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: for a batch of learned units (kind, key) scores only the videos that say one of them."""

    def each(learned: DataFrame, batch_id: int) -> None:
        touched = units.join(learned.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("video_id").distinct()
        write(score(units.join(touched, "video_id", "left_semi")))

    return each
