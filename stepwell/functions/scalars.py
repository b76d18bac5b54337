"""Scores and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands, ideals and penalties that results depend on.
WELL_FORMED = (5, 25)
IDEAL = (9, 11)
SHORT_PENALTY, LONG_PENALTY, BREAK_PENALTY, FRAGMENT_PENALTY = 0.08, 0.06, 0.5, 0.7
CANNOT_OPEN = ".…,;:)]}»-–—"
GOOD_MINUTES, MINUTES_SHORT, MINUTES_LONG, MINUTES_UNKNOWN = 10.0, 0.06, 0.03, 0.7
FULL_COMPREHENSION, ENOUGH_LINES, GOOD_COVERAGE = 0.95, 40, 0.5
TASTE = {"up": 2.0, "down": 0.25}

BREAK = r"[.!?]\s+\S"
ELLIPSIS = r"\.\.\.|…"


def words(text: Column) -> Column:
    """Words between any Unicode white space; none for blank text."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"(?U)\s+"))


def well_formed(text: Column) -> Column:
    return F.size(words(text)).between(*WELL_FORMED) & ~text.rlike(BREAK)


def quality(text: Column) -> Column:
    """0 to 1: a plateau of ideal lengths, less per word outside it, and for breaks, fragments and ellipses."""
    n = F.size(words(text))
    short = F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(IDEAL[0]) - n) * F.lit(SHORT_PENALTY))
    long = F.greatest(F.lit(0.0), F.lit(1.0) - (n - F.lit(IDEAL[1])) * F.lit(LONG_PENALTY))
    length = F.when(n < IDEAL[0], short).when(n > IDEAL[1], long).otherwise(1.0)
    broken = F.regexp_replace(text, ELLIPSIS, " ").rlike(BREAK)
    opening = F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), 1, 1)
    first = F.regexp_extract(text, r"\p{L}", 0)
    fragment = ((opening != "") & F.contains(F.lit(CANNOT_OPEN), opening)) | first.rlike(r"^\p{Ll}")
    factor = lambda test, x: F.when(test, x).otherwise(1.0)
    return length * factor(broken, BREAK_PENALTY) * factor(fragment, FRAGMENT_PENALTY) * factor(text.rlike(ELLIPSIS), FRAGMENT_PENALTY)


def variety(text: Column) -> Column:
    """Share of words that differ, case apart; 0 without words."""
    w = F.transform(words(text), F.lower)
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)


def length_band(minutes: Column) -> Column:
    """How well a video's length suits: best at GOOD_MINUTES; null is middling."""
    short = F.greatest(F.lit(0.0), 1.0 - (GOOD_MINUTES - minutes) * F.lit(MINUTES_SHORT))
    long = F.greatest(F.lit(0.0), 1.0 - (minutes - GOOD_MINUTES) * F.lit(MINUTES_LONG))
    return F.when(minutes.isNull(), MINUTES_UNKNOWN).when(minutes < GOOD_MINUTES, short).otherwise(long)


def watchability(comprehension: Column, minutes: Column, lines: Column, dialogue: Column) -> Column:
    """Comprehension squared, damped by length, few lines, and lines that miss most of the dialogue; 4 places."""
    read = F.pow(F.least(comprehension / FULL_COMPREHENSION, F.lit(1.0)), F.lit(2.0))
    enough = F.least(lines / F.lit(float(ENOUGH_LINES)), F.lit(1.0))
    covered = F.when(dialogue.isNull() | (dialogue == 0), 1.0).otherwise(F.least(lines / dialogue / GOOD_COVERAGE, F.lit(1.0)))
    return F.round(read * length_band(minutes) * enough * covered, 4)


def taste_weight(taste: Column) -> Column:
    return F.when(taste == "up", TASTE["up"]).when(taste == "down", TASTE["down"]).otherwise(1.0)


def per_minute(amount: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, amount / minutes).otherwise(0.0)


def priority(rank: Column, size: int) -> Column:
    return F.coalesce(1.0 - rank / F.lit(float(max(size, 1))), F.lit(0.0))


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm of a cue."""
    ms = F.round(seconds * 1000).cast("long")
    part = lambda div, mod: F.pmod(F.floor(ms / div), F.lit(mod)).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def chapter_clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%d:%02d", m, F.pmod(s, F.lit(60))))


def trigrams(word: Column, before: int, after: int) -> Column:
    """Distinct trigrams of a word padded with spaces; a word of fewer than three letters with padding is itself."""
    padded = F.concat(F.repeat(F.lit(" "), F.lit(before)), word, F.repeat(F.lit(" "), F.lit(after)))
    parts = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))
    return F.when(F.length(padded) < 3, F.array(padded)).otherwise(F.array_distinct(parts))


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def snooze_wait(times: Column, delay: int = 20, cap: int = 200) -> Column:
    """Ticks a unit sleeps at its nth snooze: doubled each time, up to the cap."""
    return F.least(delay * F.pow(F.lit(2.0), times - 1), F.lit(float(cap))).cast("long")
