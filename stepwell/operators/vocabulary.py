"""Names of units: goals and their aliases, corpus-wide votes, and approximate spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.functions import scalars, text
from stepwell.operators.index import sized

MARGIN = 4


def once(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """The first of rows with equal `by`."""
    cols = rows.columns
    return rows.groupBy(by).agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*").select(*cols)


def alias_table(goals: DataFrame) -> DataFrame:
    """(word, folded, goal_kind, goal_key): the goal each word names, exactly and by lower case; of several the first by (kind, key)."""
    named = goals.select("kind", "key", F.explode(text.heads(F.col("key"))).alias("word"))
    first = F.min(F.struct(F.col("kind").alias("goal_kind"), F.col("key").alias("goal_key"))).alias("g")
    exact = named.groupBy("word").agg(first).select("word", F.lit(False).alias("folded"), "g.*")
    low = named.groupBy(F.lower("word").alias("word")).agg(first).select("word", F.lit(True).alias("folded"), "g.*")
    return exact.unionByName(low)


def resolve(units: DataFrame, goals: DataFrame, goal_rows: int, list_only: bool = False) -> DataFrame:
    """Distinct units with the name the goals teach them by: (kind, key, new_kind, new_key); list_only drops the others.

    Decided once for each distinct unit; a caller joins the answer to its edges.
    """
    a = sized(alias_table(goals), goal_rows * 4)
    exact = a.where(~F.col("folded")).select(F.col("word").alias("key"), F.struct("goal_kind", "goal_key").alias("e"))
    low = a.where("folded").select(F.col("word").alias("low"), F.struct("goal_kind", "goal_key").alias("f"))
    u = units.select("kind", "key").distinct().withColumn("low", F.lower("key"))
    u = u.join(exact, "key", "left").join(low, "low", "left").withColumn("g", F.coalesce("e", "f"))
    if list_only:
        u = u.where(F.col("g").isNotNull())
    return u.select("kind", "key", F.coalesce("g.goal_kind", "kind").alias("new_kind"), F.coalesce("g.goal_key", "key").alias("new_key"))


def rename(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges under their units' new names, each once a sentence."""
    out = edges.join(names, ["kind", "key"]).drop("kind", "key").withColumnsRenamed({"new_kind": "kind", "new_key": "key"})
    return out.distinct()


def covered_forms(goals: DataFrame) -> DataFrame:
    """(form, kind, key): goals that hold each word of theirs, as written and in lower case."""
    words = F.filter(F.regexp_extract_all("key", F.lit(r"[\p{L}-]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*text.ROLES, *text.ARTICLES))
    each = goals.select("kind", "key", F.explode(words).alias("w"))
    return each.select(F.explode(F.array("w", F.lower("w"))).alias("form"), "kind", "key").distinct()


def one_goal_per_verb(goals: DataFrame) -> DataFrame:
    """Goals in order without bare lemmas that a longer goal names."""
    framed = goals.where(F.contains("key", F.lit(" "))).select(F.explode(text.heads(F.col("key"))).alias("key")).distinct()
    bare = goals.join(framed.withColumn("kind", F.lit("lemma")), ["kind", "key"], "left_anti")
    return bare


def evidence(tokens: DataFrame) -> DataFrame:
    """(surface, lemma, n): how often each surface got each lemma."""
    return tokens.groupBy("surface", "lemma").agg(F.count("*").alias("n"))


def lemma_corrections(seen: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """(surface, lemma): repairs of surfaces left as they are, where another lemma wins and either the lookup agrees
    or it has MARGIN times the failures. Ties between lemmas go to the lesser."""
    own = F.max(F.when(F.col("lemma") == F.col("surface"), F.col("n")))
    best = F.min(F.struct((-F.col("n")).alias("m"), "lemma"))
    s = seen.groupBy("surface").agg(own.alias("failures"), best.alias("b")).where(F.col("failures").isNotNull())
    s = s.select("surface", "failures", F.col("b.lemma").alias("lemma"), (-F.col("b.m")).alias("n")).where("lemma <> surface")
    agrees = F.lit(False)
    if lookup is not None:
        s = s.join(lookup.select("surface", F.col("lemma").alias("known_lemma")), "surface", "left")
        agrees = F.coalesce(F.col("known_lemma") == F.col("lemma"), F.lit(False))
    return s.where(agrees | (F.col("n") >= MARGIN * F.col("failures"))).select("surface", "lemma")


def proper_nouns(tokens: DataFrame) -> DataFrame:
    """Lemmas tagged as names (`is_name`) more often than not."""
    n = tokens.groupBy("lemma").agg(F.count_if("is_name").alias("names"), F.count_if(~F.col("is_name")).alias("content"))
    return n.where("names > content").select("lemma", "names", "content")


def normalise(edges: DataFrame, names: DataFrame, fixes: DataFrame) -> DataFrame:
    """Edges (sentence_id, key, ...) without names, failed lemmas repaired, each once a sentence."""
    kept = edges.join(names.select(F.col("lemma").alias("key")), "key", "left_anti")
    fixed = kept.join(fixes.select(F.col("surface").alias("key"), F.col("lemma").alias("to")), "key", "left")
    return fixed.withColumn("key", F.coalesce("to", "key")).drop("to").distinct()


def search(counts: DataFrame, needles: DataFrame, limit: int = 20, floor: float = 0.3) -> DataFrame:
    """(needle, place, kind, key, said, score): units by approximate spelling, closest first.

    A unit that contains the needle scores 1, others the Jaccard similarity of trigrams. Candidates come from an
    inverted index: what contains a needle of three letters shares its trigrams, shorter needles are indexed as parts.
    """
    grams = lambda c: scalars.trigrams(F.lower(F.trim(c)), 2, 1)
    low = F.lower("key")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    parts = F.array_distinct(F.concat(grams(F.col("key")), pieces(1), pieces(2)))
    index = counts.select("kind", "key", "said", F.explode(parts).alias("part"))
    want = needles.select("needle", F.lower(F.trim("needle")).alias("w")).where("w <> ''")
    ask = F.when(F.length("w") < 3, F.concat(grams(F.col("w")), F.array("w"))).otherwise(grams(F.col("w")))
    asked = want.select("needle", "w", F.explode(F.array_distinct(ask)).alias("part"))
    found = index.join(asked, "part").select("needle", "w", "kind", "key", "said").distinct()
    score = F.when(F.contains(F.lower("key"), F.col("w")), 1.0).otherwise(scalars.jaccard(grams(F.col("w")), grams(F.col("key"))))
    found = found.withColumn("score", score).where(F.col("score") >= floor)
    place = F.row_number().over(W.partitionBy("needle").orderBy(F.desc("score"), F.desc("said"), "key", "kind"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("needle", "place", "kind", "key", "said", "score")


def fuzzy_match(surfaces: DataFrame, entries: DataFrame, entry_rows: int, least: float = 0.6) -> DataFrame:
    """(surface, entry, score): each surface's entry with the greatest Dice similarity of trigrams, `least` or more.

    Surfaces meet entries at their common grams and are counted. A dictionary small enough is broadcast as its grams,
    so that a surface's pairs are summed where its grams were made.
    """

    def indexed(words: DataFrame, name: str, n: str) -> DataFrame:
        # exploding a one-element array keeps the grams from being made for each use
        g = words.select(name, F.explode(F.array(scalars.trigrams(F.lower(name), 2, 2))).alias("g"))
        return g.select(name, F.size("g").alias(n), F.explode("g").alias("x"))

    small = sized(indexed(entries.distinct(), "entry", "m"), 12 * entry_rows)
    pairs = indexed(surfaces.distinct(), "surface", "n").join(small, "x")
    pairs = pairs.groupBy("surface", "entry", "n", "m").agg(F.count("*").alias("c"))
    pairs = pairs.withColumn("score", 2.0 * F.col("c") / (F.col("n") + F.col("m"))).where(F.col("score") >= least)
    best = pairs.groupBy("surface").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry")).alias("b"))
    return best.select("surface", F.col("b.entry").alias("entry"), (-F.col("b.s")).alias("score"))


def function_words(words: DataFrame, groups: DataFrame, examples: int = 4) -> DataFrame:
    """words (word, lemma, tag, frequency) of closed classes: (lemma, category, said, forms), most said first."""
    w = words.join(sized(groups, 1000), "tag").where(F.col("word").rlike(r"^\p{L}+$"))
    agg = w.groupBy(F.lower("lemma").alias("lemma")).agg(F.min("category").alias("category"), F.sum("frequency").alias("said"), F.slice(F.array_sort(F.collect_set("word")), 1, examples).alias("forms"))
    return agg.orderBy(F.desc("said"), "lemma")
