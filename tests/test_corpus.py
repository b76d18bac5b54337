"""The main scan and the sets of units a reader starts from, on small tables."""

from pyspark.sql import functions as F

from stepwell.operators import corpus


def store(spark):
    s = spark.createDataFrame(
        [(1, "a", 7, "de", "eins", True), (2, "a", 8, None, "zwei", True), (3, "a", 7, "en", "one", True), (4, "b", 7, "de", "eins", True), (5, "a", 7, "de", "lang", False)],
        "sentence_id long, build string, video_id long, language string, text string, teachable boolean",
    )
    u = spark.createDataFrame([(1, "lemma", "x"), (1, "lemma", "X"), (2, "lemma", "y"), (3, "lemma", "x"), (4, "lemma", "x"), (5, "lemma", "z")], "sentence_id long, kind string, key string")
    return s, u


def ids(df):
    return sorted(r["sentence_id"] for r in df.select("sentence_id").collect())


def test_load_options(spark):
    s, u = store(spark)
    assert ids(corpus.load(s, u, ["a"])[0]) == [1, 2]
    assert ids(corpus.load(s, u, [])[0]) == []
    assert ids(corpus.load(s, u, ["a", "b"], teachable_only=False)[0]) == [1, 2, 4, 5]
    assert ids(corpus.load(s, u, ["a"], german_only=False)[0]) == [1, 2, 3]
    assert ids(corpus.load(s, u, ["a", "b"], text="eins")[0]) == [1, 4]
    assert ids(corpus.load(s, u, ["a", "b"], video=7, holding=("lemma", "x"))[0]) == [1, 4]
    assert ids(corpus.load(s, u, ["a"], video=8)[1]) == [2]


def test_load_renames_and_drops(spark):
    s, u = store(spark)
    names = spark.createDataFrame([("lemma", "X", "lemma", "x"), ("lemma", "y", None, None)], "kind string, key string, new_kind string, new_key string")
    edges = corpus.load(s, u, ["a"], names=names)[1]
    assert [tuple(r) for r in edges.collect()] == [(1, "lemma", "x")]


def test_sources_for(spark):
    got = spark.createDataFrame([("subtitle:auto",), ("subtitle",), ("other",)], "b string").select(corpus.sources_for(F.col("b")).alias("s"))
    assert [r["s"] for r in got.collect()] == [["auto"], ["manual"], ["manual"]]


def test_known_and_beginner(spark):
    unit = "kind string, key string"
    names = spark.createDataFrame([("lemma", "haus", "pattern", "das Haus"), ("lemma", "baum", "pattern", "der Baum")], unit + ", new_kind string, new_key string")
    own = corpus.known_set(spark.createDataFrame([("lemma", "haus")], unit), spark.createDataFrame([("lemma", "Und")], unit), names)
    assert {tuple(r) for r in own.collect()} == {("lemma", "haus"), ("pattern", "das Haus"), ("lemma", "Und")}
    first = corpus.beginner_set(own, spark.createDataFrame([("und",)], "word string"), names)
    assert [tuple(r) for r in first.collect()] == [("lemma", "Und")]


def test_lemmas_for(spark):
    c = spark.createDataFrame([("wird", "werden"), ("ging", "Gehen"), ("rot", "rot")], "surface string, lemma string")
    s = spark.createDataFrame([("wird",), ("gehen",), ("none",)], "surface string")
    assert sorted(r["lemma"] for r in corpus.lemmas_for(c, s).collect()) == ["gehen", "werden"]
