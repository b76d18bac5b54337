"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions.

Statistics, histograms and verdicts are DataFrame expressions. The learner only ever sees histograms of labelled rows,
a fixed number of cells a step, so it takes all labelled rows and nothing grows on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import WS, let, numbered, settled, stage

SYMBOLS = "#*$%&|<>"
#: Ratios that rules may test.
FEATURES = ("mean_word", "symbols", "dup_lines", "repeated", "distinct", "capitals", "marks", "closed_lines")
THRESHOLDS = 32
MAX_RULES = 12
MAX_CONDITIONS = 3
#: Share of rejected pruning rows that must be labelled bad, and the fewest of them that carry a rule.
PRECISION = 0.97
SUPPORT = 3
#: A threshold that rejects less is taken if it keeps this share of the best gain.
NEARLY = 0.99


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _repeated(words: Column, n: Column, window: int = 8) -> Column:
    """Words in 8-word windows that the text has twice or more. Windows are compared by 64-bit hashes, built by doubling."""

    def shifted(h: Column, by: int) -> Column:
        return let(h, lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - by), F.slice(v, F.lit(by + 1), F.size(v) - by), lambda a, b: F.xxhash64(a, b)))

    h = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        h = shifted(h, by)

    def positions(s: Column) -> Column:
        m = F.size(s) - 1
        twins = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.when(b.isNull() | (b - a > window), F.lit(window)).otherwise(b - a))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(v: Column) -> Column:
        pairs = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    return F.when(n > window, let(h, count)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row for each row of docs: _row, doc_id, the counted statistics and FEATURES. Null text has no words.

    carry: the whole row of docs goes along, as the struct _doc.
    """
    kept = ["_doc"] if carry else []
    docs = docs.select("doc_id", "text", *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] * carry)
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    # exploding one-element arrays keeps words and lines from being computed for each use
    d = numbered(docs).select("_row", "doc_id", *kept, text.alias("text"), F.explode(F.array(F.struct(words.alias("w"), lines.alias("l")))).alias("x"))
    d = d.select("_row", "doc_id", *kept, "text", F.col("x.w").alias("w"), F.col("x.l").alias("l"))
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("long")
    d = d.select(
        "_row",
        "doc_id",
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w"), F.size("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        only("A-Z").alias("n_capitals"),
        only("!?").alias("n_marks"),
        F.size(F.filter("l", lambda x: x.rlike(rf"[.!?…\"')\]][{WS}]*$"))).cast("long").alias("n_closed"),
    )
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    ratios = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_distinct", "n_words"), ("n_capitals", "word_chars"), ("n_marks", "n_words"), ("n_closed", "n_lines"))
    return d.select("*", *[per(a, b).alias(f) for f, (a, b) in zip(FEATURES, ratios)])


def base_failed() -> Column:
    """The fixed part of the verdict: too few words, or too many of them repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _all(rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, *tests: Column) -> list[tuple[int, int]]:
    """(bad, good) rows that pass each test."""
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    r = rows.agg(*[n(t & F.col("bad") if b else t & ~F.col("bad")).alias(f"c{i}_{b}") for i, t in enumerate(tests) for b in (1, 0)]).first()
    return [(r[f"c{i}_1"], r[f"c{i}_0"]) for i in range(len(tests))]


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list for rows with FEATURES and `bad` (boolean): sequential covering with growing and pruning.

    Two of three rows grow a rule, by FOIL gain over histograms of THRESHOLDS quantiles of each feature; the others
    prune it, and drop it, and all further ones, where its precision or support there is too low. Rows covered go. No
    rows, or rows of one kind, give an empty list.
    """
    steps = sorted({*(i / THRESHOLDS for i in range(1, THRESHOLDS)), *(x for e in (0.001, 0.003, 0.01, 0.02) for x in (e, 1 - e))})
    some = lambda f: F.when(F.col(f) > 0, F.col(f))
    cuts = labelled.agg(*[F.percentile_approx(x, steps, 2000).alias(f"{k}{f}") for f in FEATURES for k, x in (("all_", F.col(f)), ("some_", some(f)))]).first()
    cuts = {f: sorted({*(cuts[f"all_{f}"] or []), *(cuts[f"some_{f}"] or [])}) for f in FEATURES}
    below = lambda f: F.size(F.filter(F.lit(cuts[f]).cast("array<double>"), lambda t: t < F.col(f)))
    bins = F.array(*map(below, FEATURES))
    rows = stage(labelled.select("bad", *FEATURES, bins.alias("bins"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).alias("grow")), "labelled")
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            cells = left.where(F.col("grow") & _all(rule)).select("bad", F.posexplode("bins").alias("f", "bin"))
            found = cells.groupBy("f", "bin").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
            total = [sum(r[k] for r in found if r["f"] == 0) for k in ("p", "n")]
            if not total[0] or not total[1]:
                break
            tests: list[tuple[float, Condition]] = []
            for i, f in enumerate(FEATURES):
                at = {r["bin"]: (r["p"], r["n"]) for r in found if r["f"] == i}
                p = n = 0
                for k, t in enumerate(cuts[f]):
                    p, n = p + at.get(k, (0, 0))[0], n + at.get(k, (0, 0))[1]
                    for above, (x, y) in ((False, (p, n)), (True, (total[0] - p, total[1] - n))):
                        if x >= SUPPORT:
                            gain = x * (math.log2(x / (x + y)) - math.log2(total[0] / sum(total)))
                            tests.append((gain, Condition(f, above, t)))
            top = max((gain for gain, _ in tests), default=0)
            # of a feature's thresholds that gain about as much, the one that rejects least
            feature = next((c.feature, c.above) for gain, c in tests if gain == top) if top > 0 else None
            near = [c for gain, c in tests if feature == (c.feature, c.above) and gain >= NEARLY * top]
            if not near:
                break
            pick = (max if near[0].above else min)(near, key=lambda c: c.threshold)
            if pick in rule:
                break
            rule.append(pick)
        if not rule:
            break
        prefixes = [tuple(rule[:k]) for k in range(1, len(rule) + 1)]
        seen = _counts(left.where(~F.col("grow")), *map(_all, prefixes))
        score = [(p - n) / (p + n + 1) for p, n in seen]
        k = score.index(max(score))
        p, n = seen[k]
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(prefixes[k])
        left = left.where(~_all(prefixes[k]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects; false where the base statistics fail."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(_all(rule), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(statistics with base_failed and kept, the list learned from labels): one row for each row of docs.

    Only labelled documents that pass the base statistics teach. Labels with null in doc_id or quality teach nothing;
    of several for one document the lowest counts. Null or repeated doc_ids are rows of their own. Empty tables give
    no rows, or an empty list. Other columns are ignored.
    """
    rows = stage(statistics(docs), "statistics")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rules = learn(rows.where(~base_failed()).join(known, "doc_id"))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules)), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base statistics and the learned list keep.

    All columns stay, whatever their names. Nulls, repeated rows and empty tables are as in judge; a null text has too few
    words and goes. The list runs over docs itself: counting statistics once more costs less than sending all texts through a shuffle.
    """
    docs = settled(docs)
    _, rules = judge(docs, labels)
    return statistics(docs, carry=True).where(verdict(rules)).select("_doc.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    judged, _ = judge(read("documents"), read("labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
