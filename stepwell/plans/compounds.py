"""Compounds: units that come free once each of their parts is known in one of its forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.storage import stage


@dataclass
class Compounds:
    """whole (rule_id, kind, key) and part (rule_id, part_no, kind, key): OR within a part, AND across them."""

    whole: DataFrame
    part: DataFrame


def over(inventory: DataFrame, pairs: DataFrame) -> Compounds:
    """Rules from pairs (word, parts array<string>) over the lemmas a corpus has: of a word's lemmas the first with a
    capital, else the first. Rules with a word or part that nothing names are dropped."""
    lemma = inventory.where("kind = 'lemma'").select("kind", "key", F.lower("key").alias("word"))
    named = lemma.groupBy("word").agg(F.min(F.struct((F.col("key") == F.lower("key")).alias("plain"), "key")).alias("m")).select("word", F.lit("lemma").alias("kind"), "m.key")
    rule = F.xxhash64("word", "parts").alias("rule_id")
    rules = pairs.select(rule, "word", "parts")
    whole = rules.select("rule_id", "word").join(named, "word").select("rule_id", "kind", "key")
    part = rules.select("rule_id", F.size("parts").alias("n"), F.posexplode("parts").alias("part_no", "word")).join(named, "word")
    full = part.groupBy("rule_id", "n").agg(F.count_distinct("part_no").alias("have")).where("have = n").select("rule_id")
    part = part.join(full, "rule_id", "left_semi").select("rule_id", "part_no", "kind", "key")
    return Compounds(whole.join(full, "rule_id", "left_semi"), part.join(whole.select("rule_id").distinct(), "rule_id", "left_semi"))


def granted(known: DataFrame, rules: Compounds) -> DataFrame:
    """Units of rules all of whose parts are known, that are not known yet."""
    need = rules.part.groupBy("rule_id").agg(F.count_distinct("part_no").alias("need"))
    met = rules.part.join(known, ["kind", "key"], "left_semi").groupBy("rule_id").agg(F.count_distinct("part_no").alias("met"))
    ready = need.join(met, "rule_id").where("met = need").select("rule_id")
    return rules.whole.join(ready, "rule_id", "left_semi").select("kind", "key").distinct().join(known, ["kind", "key"], "left_anti")


def derivable(known: DataFrame, rules: Compounds | None, max_rounds: int = 100) -> DataFrame:
    """known with every compound that follows, and what follows from those."""
    if rules is None:
        return known
    for _ in range(max_rounds):
        new = stage(granted(known, rules), "granted")
        if new.isEmpty():
            return known
        known = stage(known.unionByName(new), "known")
    raise RuntimeError("compounds did not settle")
