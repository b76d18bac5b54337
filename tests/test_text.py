"""Facts of text functions, captions, filters, vocabulary and state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stepwell.functions import scalars, text
from stepwell.operators import filters, state, vocabulary
from stepwell.sources import captions, sinks, wordlists
from stepwell.streaming import review


def col(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_quality(spark):
    q = col(spark, scalars.quality, "Das hier ist ein ganz guter Satz mit Wörtern.", "das hier ist ein ganz guter Satz mit Wörtern.", "Das hier ist… ein ganz guter Satz mit Wörtern.", "Das ist gut.", '"Das hier ist ein ganz guter Satz mit Wörtern."')
    assert q == pytest.approx([1.0, 0.7, 0.7, 1 - 0.08 * 6, 1.0])


def test_watchability(spark):
    w = spark.range(1).select(*[scalars.watchability(F.lit(c), F.lit(m).cast("double"), F.lit(n), F.lit(d).cast("int")).alias(f"c{i}") for i, (c, m, n, d) in enumerate([(0.95, 10.0, 40, None), (0.95, None, 40, 0), (0.95, 10.0, 46, 390)])]).first()
    assert w.c0 == 1.0 and w.c1 == 0.7 and w.c2 < 1 / 3


def test_heads(spark):
    got = col(spark, text.heads, "die Schule", "etw./jdn. (Akk) haben", "jdm. (Dat) etw. (Akk) geben", "gern, gerne", "etw. (Akk) / sich lassen scheiden", "warten auf")
    assert got == [["Schule"], ["haben"], ["geben"], ["gern", "gerne"], [], ["warten"]]


def test_spoken_and_slug(spark):
    assert col(spark, text.spoken, "jdm. (Dat) etw. (Akk) geben", "mit jdm. / über etw. sprechen", "freuen sich", "gern, gerne") == ["jemandem etwas geben", "mit jemandem sprechen", "sich freuen", "gern"]
    assert col(spark, text.slug, "die Geschichte", "führen café!") == ["die-Geschichte", "fuehren-cafe"]


def test_ids(spark):
    assert col(spark, text.video_id, "https://www.youtube.com/watch?v=abcdefghijk&t=1", "abcdefghijk", "nothing here") == ["abcdefghijk", "abcdefghijk", None]


def test_filter_reasons(spark):
    rows = ["Und das ist ein Satz…", "Das ist [Musik] hier auch.", "Zu kurz.", " ".join(["wort"] * 30) + ".", "Das ist ein guter Satz.", "das IST ein, guter Satz.", "If the cat and the dog are here.", "Nein nein nein nein doch.", "Das ist ein guter Satz☀."]
    d = spark.createDataFrame([(i, t, "subtitle") for i, t in enumerate(rows)], "nr long, text string, origin string")
    got = [r.reason for r in filters.reasons(d).orderBy("nr").collect()]
    assert got == ["artifact", "artifact", "length", "length", None, "duplicate", "not german", "repeats itself", "duplicate"]


def test_only_kept_make_duplicates(spark):
    d = spark.createDataFrame([(1, "Nein nein nein nein doch.", "s"), (2, "Nein, nein nein nein doch.", "s")], "nr long, text string, origin string")
    assert [r.reason for r in filters.reasons(d).orderBy("nr").collect()] == ["repeats itself"] * 2


LINES = "video_id string, line_id long, nr int, start_time double, duration double, content string"


def test_reassemble(spark):
    def said(*contents):
        d = spark.createDataFrame([("v", i + 1, i, float(4 * i), 4.0, c) for i, c in enumerate(contents)], LINES)
        return [(r.text, list(r.source_ids)) for r in captions.reassemble(d).orderBy("nr").collect()]

    assert said("Wir haben heute Namen dabei,", "die man kennen sollte.") == [("Wir haben heute Namen dabei, die man kennen sollte.", [1, 2])]
    assert [t for t, _ in said("Das ist gut. Ich gehe jetzt.")] == ["Das ist gut.", "Ich gehe jetzt."]
    assert [t for t, _ in said("*Olaf lacht.* Ach, hier sind sie.")] == ["Ach, hier sind sie."]
    for whole in ("Ich mag z.B. Kaffee sehr.", "Das ist Dr. Meier.", "Er kommt bzw. Sie kommt."):
        assert [t for t, _ in said(whole)] == [whole]


def test_align(spark):
    d = spark.createDataFrame([("v", 1, 0, 0.0, 4.0, "eins zwei drei."), ("v", 2, 1, 4.0, 6.0, "vier. Fünf sechs sieben.")], LINES)
    s = spark.createDataFrame([("v", 0, "Eins zwei drei vier.", [1, 2]), ("v", 1, "Fünf sechs sieben.", [2]), ("v", 2, "Xxx yyy.", [2])], "video_id string, nr int, text string, source_ids array<long>")
    a = captions.align(d, s).orderBy("nr").collect()
    assert a[0].start_time == 0 and 4 < a[0].end_time <= a[1].start_time + 1e-9 and a[1].end_time == pytest.approx(10)
    assert (a[2].start_time, a[2].end_time) == (4.0, 10.0)


def test_overlap(spark):
    d = spark.createDataFrame([("v", 0, 0.0, 5.0), ("v", 1, 3.0, 8.0), ("v", 2, 4.0, 7.0), ("v", 3, 9.0, 10.0)], "video_id string, nr int, start_time double, end_time double")
    assert [(r.nr, r.start_time) for r in captions.without_overlap(d).orderBy("nr").collect()] == [(0, 0.0), (1, 5.0), (3, 9.0)]


def test_vtt(spark):
    d = spark.createDataFrame([("v", 0, "Eins.", 0.0, 1.5), ("v", 1, "Zwei.", 2.0, 3.25)], "video_id string, nr int, text string, start_time double, end_time double")
    assert captions.render_vtt(d).first().vtt == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.500\nEins.\n\n2\n00:00:02.000 --> 00:00:03.250\nZwei.\n"


def test_cue_lengths(spark):
    d = spark.createDataFrame([("v", 0, 0.0, 0.0), ("v", 1, 3.0, 2.0), ("v", 2, 6.0, 0.0), ("w", 0, 1.0, 0.0)], "video_id string, nr int, start_time double, duration double")
    got = captions.cue_lengths(d, F.when(F.col("video_id") == "v", 10.0)).orderBy("video_id", "nr").collect()
    assert [r.duration for r in got] == [3.0, 2.0, 4.0, 2.0]


def test_track(spark):
    j = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"Hallo "},{"utf8":"Welt."}]},{"tStartMs":2000,"segs":[{"utf8":"\\n"}]}]}'
    d = spark.createDataFrame([("v", "de", j), ("v", "de-orig", j.replace("Hallo", "Guten")), ("v", "en", "{}")], "video_id string, name string, json string")
    assert [(r.nr, r.start_time, r.duration, r.content) for r in captions.track_lines(d).collect()] == [(0, 1.0, 0.5, "Guten Welt.")]


def test_judge(spark):
    def verdict(line, n=40):
        d = spark.createDataFrame([("v", i, line) for i in range(n)], "video_id string, nr int, content string")
        return captions.judge(d).first().verdict

    assert verdict("Das ist nicht sehr gut, aber wir sind auch noch mit dabei.") == "ok"
    assert verdict("This is not the best that you have with us.") == "not-german"
    assert verdict("das ist nicht sehr gut aber") == "unpunctuated"
    assert verdict("Das ist gut.", 5) == "too-short"


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Das ist der\r\nAnfang nicht.\r\n\r\nUnd das ist auch gut!".encode())
    (tmp_path / "b.txt").write_text("\n".join(["Das ist nicht gut.", "This is the end that you have."] * 6))
    got = captions.transcript_sentences(captions.transcripts(spark, str(tmp_path))).orderBy("path", "nr").collect()
    assert [r.text for r in got if r.path.endswith("a.txt")] == ["Das ist der Anfang nicht.", "Und das ist auch gut!"]
    assert [(r.text, r.translation) for r in got if r.path.endswith("b.txt")] == [("Das ist nicht gut.", "This is the end that you have.")] * 6


def test_votes(spark):
    d = lambda rows: spark.createDataFrame(rows, "surface string, lemma string, n long")
    fix = lambda seen, lookup=None: {(r.surface, r.lemma) for r in vocabulary.lemma_corrections(seen, lookup).collect()}
    assert fix(d([("willst", "wollen", 900), ("willst", "willst", 100)])) == {("willst", "wollen")}
    close = d([("willst", "wollen", 672), ("willst", "willst", 503)])
    assert fix(close) == set()
    assert fix(close, spark.createDataFrame([("willst", "wollen")], "surface string, lemma string")) == {("willst", "wollen")}
    assert fix(d([("weiß", "wissen", 600), ("weiß", "weiß", 500)])) == set()


def test_search(spark):
    said = [("lemma", "haus", 500), ("pattern", "das Haus", 300), ("lemma", "krankenhaus", 40), ("lemma", "haut", 90), ("lemma", "schriftlich", 33)]
    c = spark.createDataFrame(said, "kind string, key string, said long")
    find = lambda n: [r.key for r in vocabulary.search(c, spark.createDataFrame([(n,)], "needle string")).orderBy("place").collect()]
    assert find("haus")[:3] == ["haus", "das Haus", "krankenhaus"] and "schriftlich" not in find("haus")
    assert find("schrifftlich") == ["schriftlich"] and find("ha")[0] == "haus" and find(" ") == []


def test_aliases(spark):
    goals = spark.createDataFrame([("pattern", "die Schule"), ("pattern", "das Treffen"), ("pattern", "jdn. (Akk) treffen")], "kind string, key string")
    units = spark.createDataFrame([("lemma", "schule"), ("lemma", "Treffen"), ("lemma", "treffen"), ("lemma", "baum")], "kind string, key string")
    got = {r.key: r.new_key for r in vocabulary.resolve(units, goals, 3).collect()}
    assert got == {"schule": "die Schule", "Treffen": "das Treffen", "treffen": "jdn. (Akk) treffen", "baum": "baum"}
    assert {r.key for r in vocabulary.resolve(units, goals, 3, list_only=True).collect()} == {"schule", "Treffen", "treffen"}


NOW = datetime(2024, 1, 1)


def reviews(spark, marks, key="a"):
    return spark.createDataFrame([(key, NOW + timedelta(hours=i), i, m) for i, m in enumerate(marks)], "key string, ts timestamp, seq long, correct boolean")


def test_cards(spark):
    c = state.cards(reviews(spark, [True, True])).first()
    assert c.interval_days == pytest.approx(2.5 * 2.55) and c.repetitions == 2 and c.ease_factor == pytest.approx(2.6)
    c = state.cards(reviews(spark, [True, False])).first()
    assert c.interval_days == 1 and c.ease_factor == pytest.approx(2.4) and c.repetitions == 0
    c = state.cards(reviews(spark, [True] * 20)).first()
    assert c.interval_days == 3650 and c.ease_factor == 3.0
    assert state.cards(reviews(spark, [False] * 20)).first().ease_factor == pytest.approx(1.3)


def test_stream_is_the_fold(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [(f"k{r.randint(0, 4)}", NOW + timedelta(minutes=i), i, r.random() < 0.6) for i in range(60)]
    d = spark.createDataFrame(rows, "key string, ts timestamp, seq long, correct boolean")
    for i in range(3):
        d.where((F.col("seq") >= 20 * i) & (F.col("seq") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = review.cards(review.study_events(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("cards_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x.key: (round(x.interval_days, 6), round(x.ease_factor, 6), x.repetitions) for x in review.latest_cards(spark.table("cards_seen")).collect()}
    want = {x.key: (round(x.interval_days, 6), round(x.ease_factor, 6), x.repetitions) for x in state.cards(d).collect()}
    assert got == want


def decisions(spark, acts):
    return spark.createDataFrame([(1, k, NOW + timedelta(minutes=i), i, a) for i, (a, k) in enumerate(acts)], "user_id long, key string, ts timestamp, seq long, action string")


def test_snooze(spark):
    waits = [r[0] for r in spark.range(1, 9).orderBy("id").select(scalars.snooze_wait(F.col("id"))).collect()]
    assert waits == [20, 40, 80, 160, 200, 200, 200, 200]
    asleep = lambda n: state.asleep(state.snoozed(decisions(spark, [("snooze", "a"), *[("learn", f"x{i}") for i in range(n)]]))).count()
    assert asleep(19) == 1 and asleep(20) == 0
    assert state.snoozed(decisions(spark, [("snooze", "a"), ("wake", "a"), ("snooze", "a")])).first().times == 1


def test_snooze_stream(spark, tmp_path):
    import random

    r = random.Random(2)
    d = decisions(spark, [(r.choice(["snooze", "learn", "wake"]), f"k{r.randint(0, 5)}") for _ in range(60)])
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = review.snoozes(review.study_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("snoozes_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda x: (x.user_id, x.key, x.wake_tick, x.times, x.tick)
    assert sorted(map(key, spark.table("snoozes_seen").collect())) == sorted(map(key, state.snoozed(d).collect()))


def test_attempts(spark):
    log = spark.createDataFrame([("a", NOW, 1, "unfetchable"), ("a", NOW, 2, "unfetchable"), ("b", NOW, 3, "no-subtitles"), *[("c", NOW, i, "throttled") for i in range(4, 9)], *[("d", NOW, i, "error") for i in range(9, 12)]], "video_id string, ts timestamp, seq long, outcome string")
    assert {r.video_id for r in state.settled(state.attempts(log)).collect()} == {"b", "d"}
    assert col(spark, state.classify, "HTTP 429", "Sign in to confirm", "video unavailable", "off target", "only auto-generated subtitles", "odd") == ["throttled", "blocked", "unavailable", "off-target", "no-subtitles", "error"]


def test_files(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("# list\ndie Katze, der Kater\nHund\nkatze # again\n")
    assert {(r.word, r.pos) for r in wordlists.words(spark, str(p)).collect()} == {("katze", 1), ("kater", 1), ("hund", 2)}
    p.write_text("x\tdas Haus\nBaum\nx\tdas Haus\n")
    assert [r.entry for r in wordlists.goals(spark, str(p)).orderBy("pos").collect()] == ["das Haus", "Baum"]
    p.write_text("willst wollen\nbist\tsein\n")
    assert {(r.wrong, r.right) for r in wordlists.corrections(spark, str(p)).collect()} == {("willst", "wollen"), ("bist", "sein")}
    p.write_text("krankenhaus krank haus\nCHECKED TO HERE\nzeug a b\n")
    assert [(r.word, r.parts) for r in wordlists.compounds(spark, str(p)).collect()] == [("krankenhaus", ["krank", "haus"])]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "corpus")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "video_id int, t string")
    sinks.append_build(a, path, "one")
    sinks.append_build(a, path, "two")
    sinks.save_build(a.limit(1), path, "one")
    assert {r.build: r["count"] for r in spark.read.parquet(path).groupBy("build").count().collect()} == {"one": 1, "two": 2}
    assert sinks.catch_up(a, a.where("video_id = 1")).count() == 1 and sinks.sync_guard(a, a.where("video_id = 1")) == 1
    assert sinks.stamp(a) == sinks.stamp(a.orderBy("t", ascending=False)) != sinks.stamp(a.limit(1))
    assert {r.t for r in sinks.replace_rows(a, spark.createDataFrame([(1, "z")], a.schema), ["video_id"]).collect()} == {"z", "y"}
