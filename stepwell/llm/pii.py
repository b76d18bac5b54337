"""Personal data by bootstrapped contextual extraction, in DataFrame expressions alone.

Four kinds of entities have fixed forms; those found, and digests written as keys are, are the seeds. The words before a
seed are lexical patterns. All tokens with digits or @ signs are instances; pattern and instance scores are iterated on
the graph of which pattern introduces which instance, and what confident patterns introduce is an identifier though no
fixed form knows it. A pattern is the less confident the more often its words stand before anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import WS, let, numbered, settled, stage

#: The fixed forms, in their order. Each gives the contract's leftmost non-overlapping matches but is linear on long
#: runs: runs are taken whole, and a match starts where a run does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Digests, which teach contexts though they have no kind: keys and tokens are often written so.
DIGEST = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Shapes of fixed forms: what has one but is none (a number that fails its check) is no identifier.
FAILED = r"^(?:[0-9](?:[\x20-]?[0-9]){13,18}|[0-9]++(?:\.[0-9]++){3})$"
ROUNDS = 3
#: A pattern needs so many different seeds; its score is shrunk by SHRINK unknown instances.
SUPPORT = 3
SHRINK = 1.0
#: What an instance needs to be an identifier: its score, code points, and digits or an @.
ACCEPT = 0.8
LEAST_LENGTH = 6
LEAST_DIGITS = 3

_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Running sums of array<long>, in blocks, so that the work stays near linear."""

    def sums(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(grown))

    def of(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        part = lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))
        totals = F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda acc, x: acc + x))
        starts = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        blocks = let(starts, lambda s: F.transform(numbers, lambda b: sums(part(b), F.element_at(s, b + 1))))
        return F.flatten(blocks)

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(lengths, of))


_FOUND_TYPE = "array<struct<s:bigint,e:bigint,m:string,gap:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches as structs (s, e, m, gap): start, end in code points, the match, the text since the last one."""

    def placed(hits: Column, gaps: Column) -> Column:
        wide = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        ends = let(F.slice(wide, F.lit(1), F.size(hits)), _running)
        both = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("m"), g.alias("gap")))
        both = F.slice(both, F.lit(1), F.size(hits))
        return F.zip_with(both, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"), x["gap"].alias("gap")))

    def found(hits: Column) -> Column:
        some = let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))
        return F.when(F.size(hits) > 0, some).otherwise(F.array().cast(_FOUND_TYPE))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def _is_card(m: Column) -> Column:
    def luhn(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
            x = F.when(i % 2 == 1, 2 * x).otherwise(x)
            return acc + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0

    return let(_digits(m), luhn)


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def base_spans(text: Column) -> Column:
    """The fixed forms' spans, array of (s, k, e), k the kind's place in KINDS; by start, then kind."""
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    parts = [
        F.when(F.contains(text, F.lit("@")), F.transform(_matches(text, EMAIL), span(0))).otherwise(none),
        F.transform(F.filter(_matches(text, IP), lambda x: _is_ip(x["m"])), span(1)),
        F.transform(F.filter(_matches(text, CARD), lambda x: _is_card(x["m"])), span(2)),
        F.when(F.contains(text, F.lit("+")), F.transform(F.filter(_matches(text, PHONE), lambda x: _is_phone(x["m"])), span(3))).otherwise(none),
    ]
    return F.sort_array(F.concat(*parts))


def _words(text: Column) -> Column:
    """The words of a text, lower case, digits as 0."""
    plain = F.btrim(F.regexp_replace(F.lower(text), "[0-9]", "0"), F.lit(" \t\n\x0b\f\r"))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, f"[{WS}]+"))


def _label(word: Column) -> Column:
    """What leads up to a value inside a word: up to its last = or :, if more follows; else empty."""
    return F.regexp_extract(word, r"^(?:[^=:]*+[=:])++(?=.)", 0)


def _patterns(words: Column, i: Column) -> Column:
    """The patterns of word i, hashed: the label in it or the word before it, and that with one word more. Words that a
    text's start cuts off are empty."""
    at = lambda k: F.coalesce(F.get(words, k), F.lit(""))
    word = at(i)
    label = F.when(F.contains(word, F.lit("=")) | F.contains(word, F.lit(":")), _label(word)).otherwise(F.lit(""))
    plain = F.array(F.xxhash64(at(i - 1)), F.xxhash64(at(i - 2), at(i - 1)))
    return let(label, lambda x: F.when(x == "", plain).otherwise(F.array(F.xxhash64(x), F.xxhash64(at(i - 1), x))))


def instances(text: Column, words: Column) -> Column:
    """Tokens with digits or @ signs: array of (s, e, m, p), m without label and marks around it, p its patterns."""

    def trim(x: Column, i: Column) -> Column:
        label = _label(x["m"])
        rest = F.substr(x["m"], F.length(label) + 1)
        head = F.regexp_extract(rest, r"^[\"'(\[{<]*+", 0)
        body = F.regexp_replace(F.substr(rest, F.length(head) + 1), r"[^\p{L}\p{N}]++$", "")
        start = x["s"] + F.length(label) + F.length(head)
        return F.struct(start.alias("s"), (start + F.length(body)).alias("e"), body.alias("m"), _patterns(words, i).alias("p"))

    def found(places: Column) -> Column:
        return F.filter(F.zip_with(_matches(text, TOKEN), places, trim), lambda x: x["m"].rlike("[0-9@]"))

    places = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,p:array<bigint>>>")
    return F.when(text.rlike("[0-9@]"), let(places, found)).otherwise(none)


def score(edges: DataFrame, seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Instances (surface) with their score, from edges (pattern, surface, n, seed, never) and seen (pattern, every).

    A pattern's score is what its instances' scores add up to, of all the places (every) where its words stand before
    anything, shrunk; seeds count 1. An instance's is the noisy or of its patterns'; what is never an identifier has 0.
    Patterns with too few different seeds, or accepted instances, score 0. A pattern with very many instances is only a
    key of sums and of a join whose other side has one row for it.
    """
    edges = stage(edges, "graph")
    start = stage(edges.groupBy("surface").agg(F.max(F.col("seed").cast("double")).alias("w"), F.max("never").alias("never")), "scores")
    now, out = start.select("surface", "w"), None
    for _ in range(rounds):
        on = edges.join(now, "surface")
        patterns = on.groupBy("pattern").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum((F.col("w") >= ACCEPT).cast("long")).alias("sure"))
        patterns = patterns.where(F.col("sure") >= SUPPORT).join(seen, "pattern").select("pattern", F.least(F.col("w") / (F.col("every") + SHRINK), F.lit(1.0)).alias("c"))
        some = edges.join(patterns, "pattern").groupBy("surface").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("v"))
        out = stage(start.join(some, "surface", "left").select("surface", F.col("w").alias("was"), F.when(F.col("never"), 0.0).otherwise(F.coalesce("v", F.lit(0.0))).alias("w")), "scores")
        now = out.select("surface", F.greatest("was", "w").alias("w"))
    return out.select("surface", "w")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, FOUND)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (_row, doc_id, base, found, spans), one for each row of docs: arrays of (s, k, e) in code points.

    Null text is empty. Found identifiers don't overlap base spans. Repeated rows each count as occurrences, but a
    pattern's support counts different surfaces. Null or repeated doc_ids are rows of their own. An empty table gives
    no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    docs = settled(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    d = numbered(docs).select("_row", "doc_id", text.alias("text"), F.explode(F.array(_words(text))).alias("words"))
    d = d.select("_row", "doc_id", base_spans(F.col("text")).alias("base"), instances(F.col("text"), F.col("words")).alias("tokens"))
    over = F.transform("tokens", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["m"].alias("m"), t["p"].alias("p"), F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])).alias("base")))
    rows = stage(d.select("_row", "doc_id", "base", over.alias("tokens")), "spans")
    each = rows.select("_row", F.explode("tokens").alias("t")).select("_row", "t.*").withColumn("surface", F.xxhash64("m"))
    each = each.withColumn("seed", F.col("base") | (F.col("m").rlike(DIGEST) & F.col("m").rlike("[a-f]") & F.col("m").rlike("[0-9]"))).withColumn("never", ~F.col("base") & F.col("m").rlike(FAILED))
    edges = each.select("surface", "seed", "never", F.explode("p").alias("pattern")).groupBy("pattern", "surface").agg(F.max("seed").alias("seed"), F.max("never").alias("never"), F.count("*").alias("n"))
    edges = stage(edges, "edges")
    able = stage(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"), "able")
    words = docs.select(F.explode(F.array(_words(text))).alias("words")).where(F.size("words") > 0)
    all_ = words.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _patterns(F.col("words"), i)))).alias("pattern"))
    seen = stage(all_.join(able, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("every")), "seen")
    sure = score(edges.join(able, "pattern", "left_semi"), seen, rounds).where(F.col("w") >= ACCEPT).select("surface", F.lit(True).alias("sure"))
    able = (F.length("m") >= LEAST_LENGTH) & ((F.length(_digits(F.col("m"))) >= LEAST_DIGITS) | F.contains("m", F.lit("@")))
    new = each.where(~F.col("base") & able).join(sure, "surface", "left_semi")
    new = new.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e"))).alias("found"))
    out = rows.select("_row", "doc_id", "base").join(new, "_row", "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")))
    return out.withColumn("spans", F.sort_array(F.concat("base", "found")))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    d = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    more = [F.size(c).cast("long").alias(n) for c, n in (("found", "n_found"), ("spans", "n_spans"))]
    return d.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), *more)
