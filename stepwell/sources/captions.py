"""Caption tracks and transcripts as lines, and lines as sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.session import ship

# Which track is the original, gate levels, abbreviations that end no sentence.
PREFERRED = ("de-orig", "de-DE", "de")
LEAST_LINES, PUNCTUATED, GERMAN_SHARE, WINDOW, LAST_CUE = 20, 0.05, 0.6, 200, 2.0
ABBREVIATIONS = frozenset("bzw ca evtl ggf inkl max min usw vgl Abb Dr Fr Hr Nr Prof St".split())
STAGE = r"\*[^*]*\*|\*+|\[[^\]]*\]|♪"
ENDS = r"[.!?…]['\"»)\]]?$"

TRACK = "events array<struct<tStartMs:long,dDurationMs:long,segs:array<struct<utf8:string>>>>"


def track_lines(tracks: DataFrame) -> DataFrame:
    """tracks (video_id, name, json): lines (video_id, nr, start_time, duration, content) of each video's preferred track."""
    place = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("name"))
    best = tracks.where(place > 0).groupBy("video_id").agg(F.min_by("json", place).alias("json"))
    e = best.select("video_id", F.posexplode(F.from_json("json", TRACK)["events"]).alias("pos", "e"))
    said = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: s["utf8"]), ""), r"\s+", " "))
    e = e.select("video_id", "pos", (F.col("e.tStartMs") / 1000.0).alias("start_time"), (F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("duration"), said.alias("content"))
    e = e.where("content <> ''")
    nr = F.row_number().over(W.partitionBy("video_id").orderBy("pos")) - 1
    return e.select("video_id", nr.alias("nr"), "start_time", "duration", "content")


def cue_lengths(lines: DataFrame, whole: Column) -> DataFrame:
    """duration where the track says none: until the next line, else the rest of the video (`whole` seconds), else 2 s."""
    nxt = F.lead("start_time").over(W.partitionBy("video_id").orderBy("nr"))
    rest = F.when(whole > 0, F.greatest(F.lit(0.0), whole - F.col("start_time"))).otherwise(LAST_CUE)
    length = F.when(F.col("duration") > 0, F.col("duration")).when(nxt.isNotNull(), F.greatest(F.lit(0.0), nxt - F.col("start_time"))).otherwise(rest)
    return lines.withColumn("duration", length)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, nr, line): trimmed lines with text of all .txt files below path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r", "\n"), "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))).where("line <> ''")
    return lines.select("path", (F.row_number().over(W.partitionBy("path").orderBy("pos")) - 1).alias("nr"), "line")


def transcript_sentences(lines: DataFrame, by: str = "path") -> DataFrame:
    """lines (by, nr, line) as sentences (by, nr, text, translation): lines joined up to an end mark; where German and
    English alternate the English ones are the translation.

    A file alternates if, of its first 40 lines in twos, over a quarter as many pairs as lines are German then English.
    """
    order = W.partitionBy(by).orderBy("nr")
    lines = lines.withColumn("_lang", T.language(F.col("line")))
    head = lines.where("nr < 40").withColumn("_next", F.lead("_lang").over(order))
    pair = (F.col("nr") % 2 == 0) & (F.col("_lang") == "de") & (F.col("_next") == "en")
    two = head.groupBy(by).agg((F.count_if(pair) > F.count("*") / 4).alias("_two"))
    lines = lines.join(two, by)
    said = ~F.col("_two") | (F.col("nr") % 2 == 0)
    ends = F.when(said & F.col("line").rlike(ENDS), 1).otherwise(0)
    # a translation belongs to the group of the line before it
    lines = lines.withColumn("_said", said).withColumn("_slot", F.when(F.col("_two"), F.floor(F.col("nr") / 2)).otherwise(F.col("nr"))).withColumn("_ends", ends)
    slot = W.partitionBy(by).orderBy("_slot").rangeBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("_group", F.coalesce(F.sum("_ends").over(slot), F.lit(0)))
    join = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("nr", "line")))), lambda x: x["line"]), " ")
    out = lines.groupBy(by, "_group").agg(join(F.col("_said")).alias("text"), F.nullif(join(~F.col("_said")), F.lit("")).alias("translation"))
    return out.where("text <> ''").select(by, F.col("_group").alias("nr"), "text", "translation")


def clean(content: Column) -> Column:
    """A line without stage directions, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(content, STAGE, " "), r"\s+", " "))


_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[„\"»'A-ZÄÖÜ])")


def _abbreviates(before: str) -> bool:
    last = before.rsplit(None, 1)
    token = last[-1].rstrip(".!?") if last else ""
    return bool(token) and ("." in token or token in ABBREVIATIONS or len(token) <= 2)


def reassemble(lines: DataFrame) -> DataFrame:
    """lines (video_id, line_id, nr, content) as sentences (video_id, nr, text, raw_text, source_ids).

    A video's lines are joined and cut at sentence ends, but not after abbreviations; a sentence knows the lines that
    it overlaps. One task a video, which is bounded by a video's length.
    """
    ship(lines.sparkSession)

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("nr", ignore_index=True)
        parts, spans, at = [], [], 0
        for i, t in zip(f["line_id"], f["_clean"]):
            if t:
                at += bool(parts)
                parts.append(t)
                spans.append((at, at + len(t), int(i)))
                at += len(t)
        whole = " ".join(parts)
        cuts = [0, *(m.end() for m in _BOUNDARY.finditer(whole) if not _abbreviates(whole[max(0, m.start() - 64) : m.start()])), len(whole)]
        raw = dict(zip(f["line_id"], f["content"].fillna("").str.strip()))
        out, first = [], 0
        for a, b in zip(cuts, cuts[1:]):
            t = whole[a:b].strip()
            if not t:
                continue
            while first < len(spans) and spans[first][1] <= a:
                first += 1
            ids = []
            for lo, hi, i in spans[first:]:
                if lo >= b:
                    break
                ids.append(i)
            out.append((key[0], len(out), t, " ".join(raw[i] for i in ids), ids))
        return pd.DataFrame(out, columns=["video_id", "nr", "text", "raw_text", "source_ids"])

    kind = lines.schema["video_id"].dataType.simpleString()
    rows = lines.select("video_id", "line_id", "nr", "content", F.coalesce(clean(F.col("content")), F.lit("")).alias("_clean"))
    return rows.groupBy("video_id").applyInPandas(one, f"video_id {kind}, nr int, text string, raw_text string, source_ids array<long>")


_WORD = re.compile(r"\w+")


def align(lines: DataFrame, sents: DataFrame) -> DataFrame:
    """sents (video_id, nr, text, source_ids) with start_time and end_time.

    A line's time is shared among its words by length; the longest matching runs between spoken and written words
    give a sentence its first and last word; without a match it takes the time of its lines.
    """
    from difflib import SequenceMatcher

    ship(lines.sparkSession)

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("nr"), right.sort_values("nr", ignore_index=True)
        spoken, times = [], []
        for start, length, content in zip(left["start_time"], left["duration"], left["content"]):
            found = _WORD.findall(content or "")
            total, at = sum(map(len, found)), float(start)
            for w in found:
                share = float(length) * len(w) / total
                spoken.append(w.lower())
                times.append((at, at + share))
                at += share
        written, owner = [], []
        for k, t in enumerate(right["text"]):
            for w in _WORD.findall(t or ""):
                written.append(w.lower())
                owner.append(k)
        reach: dict[int, list[int]] = {}
        for a, b, n in SequenceMatcher(None, spoken, written, autojunk=False).get_matching_blocks():
            for i in range(n):
                r = reach.setdefault(owner[b + i], [a + i, a + i])
                r[0], r[1] = min(r[0], a + i), max(r[1], a + i)
        spans = {i: (float(s), float(s + d)) for i, s, d in zip(left["line_id"], left["start_time"], left["duration"])}
        starts, ends = [], []
        for k, ids in enumerate(right["source_ids"]):
            if k in reach:
                s, e = times[reach[k][0]][0], times[reach[k][1]][1]
            else:
                own = [spans[i] for i in (ids if ids is not None else ()) if i in spans]
                s, e = (min(x for x, _ in own), max(y for _, y in own)) if own else (None, None)
            starts.append(s)
            ends.append(None if e is None else max(s, e))
        right["start_time"], right["end_time"] = pd.Series(starts, dtype=float), pd.Series(ends, dtype=float)
        return right[["video_id", "nr", "text", "source_ids", "start_time", "end_time"]]

    kind = sents.schema["video_id"].dataType.simpleString()
    right = sents.select("video_id", "nr", "text", "source_ids")
    return lines.groupBy("video_id").cogroup(right.groupBy("video_id")).applyInPandas(one, f"video_id {kind}, nr int, text string, source_ids array<long>, start_time double, end_time double")


def without_overlap(cues: DataFrame, by: str = "video_id") -> DataFrame:
    """Cues (start_time, end_time, nr) in order: each starts after all before have ended, and goes if nothing is left."""
    order = W.partitionBy(by).orderBy("start_time", "nr").rowsBetween(W.unboundedPreceding, -1)
    start = F.greatest("start_time", F.coalesce(F.max("end_time").over(order), F.lit(0.0)))
    return cues.withColumn("start_time", start).where(F.col("end_time") > F.col("start_time"))


def judge(lines: DataFrame, by: str = "video_id") -> DataFrame:
    """(by, lines, punctuation, german, verdict) of machine tracks: too-short, unpunctuated, not-german or ok.

    Language is judged over windows of at least 200 characters, filled line by line; a short tail joins the last.
    """
    l = lines.withColumn("_ends", F.regexp_replace("content", r"(?U)\s+$", "").rlike(r"[.!?]$"))  # noqa: E741
    said = F.transform(F.array_sort(F.collect_list(F.struct("nr", "content"))), lambda x: x["content"])
    per = l.groupBy(by).agg(F.count("*").alias("lines"), (F.count_if("_ends") / F.count("*")).alias("punctuation"), said.alias("_said"))

    def fill(acc: Column, line: Column) -> Column:
        cur = F.trim(F.concat_ws(" ", acc["cur"], line))
        full = F.length(cur) >= WINDOW
        return F.struct(F.when(full, F.concat(acc["out"], F.array(cur))).otherwise(acc["out"]).alias("out"), F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    filled = F.aggregate("_said", start, fill)
    per = per.withColumn("_w", filled)
    out, cur = F.col("_w.out"), F.col("_w.cur")
    windows = F.when(cur == "", out).when(F.size(out) == 0, F.array(cur)).otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat_ws(" ", F.element_at(out, -1), cur))))
    per = per.withColumn("_w", windows).withColumn("_de", F.filter("_w", lambda t: T.language(t) == "de"))
    german = F.when(F.size("_w") > 0, F.size("_de") / F.size("_w")).otherwise(0.0)
    verdict = F.when(F.col("lines") < LEAST_LINES, "too-short").when(F.col("punctuation") < PUNCTUATED, "unpunctuated").when(german < GERMAN_SHARE, "not-german").otherwise("ok")
    return per.select(by, "lines", "punctuation", F.when(verdict.isin("ok", "not-german"), german).otherwise(0.0).alias("german"), verdict.alias("verdict"))


def render_vtt(cues: DataFrame, by: str = "video_id", translations: bool = False) -> DataFrame:
    """(by, vtt): a WebVTT file's text for each video from timed sentences (nr, text, start_time, end_time)."""
    from stepwell.functions.scalars import clock

    kept = without_overlap(cues.where("start_time IS NOT NULL AND end_time IS NOT NULL"), by)
    n = F.row_number().over(W.partitionBy(by).orderBy("start_time", "nr"))
    body = [n.cast("string"), F.concat(clock(F.col("start_time")), F.lit(" --> "), clock(F.col("end_time"))), F.col("text")]
    if translations:
        body.append(F.col("translation"))
    block = kept.select(by, n.alias("n"), F.concat(F.concat_ws("\n", *body), F.lit("\n")).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"])
    return block.groupBy(by).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n")).alias("vtt"))


def write_vtt(cues: DataFrame, path: str) -> None:
    """One text file of cues a video, in a folder named for it."""
    render_vtt(cues).write.partitionBy("video_id").text(path)
