"""What a corpus can ever teach: closures over sole unknowns, with or without units bought from outside the goals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.operators.index import sized
from stepwell.plans.compounds import derivable
from stepwell.storage import stage, unstage

_UNIT = ["kind", "key"]


@dataclass
class Reached:
    """known: all units reached, the seed too; bought: (kind, key, goals freed) in order; rounds: jobs' rounds."""

    known: DataFrame
    bought: list[tuple[str, str, list[str]]] = field(default_factory=list)
    rounds: int = 0
    open: DataFrame | None = None


def _lose(left: DataFrame, new: DataFrame, n: int) -> DataFrame:
    out = stage(left.join(sized(new, n), _UNIT, "left_anti"), "open")
    unstage(left)
    return out


def _sole(left: DataFrame) -> DataFrame:
    per = left.groupBy("sentence_id").agg(F.count("*").alias("n"), F.min(F.struct(*_UNIT)).alias("u"))
    return per.where("n = 1").select("u.*")


def reachable(units: DataFrame, known: DataFrame, goals: DataFrame | None, budget: int = 0, compounds=None, max_rounds: int = 1000) -> Reached:
    """Learns, round by round, every goal that is some sentence's only unknown (any unit if goals is None).

    Which comes first does not matter, so a round takes all at once; edges of learned units leave the table, which is
    staged, so plans stay short. With a budget, when a round finds nothing the unit that is the only unknown of the
    most sentences is bought (ties: greatest key) and rounds go on. Compounds whose parts are known come free.
    """
    goals = goals.select(*_UNIT).distinct() if goals is not None else None
    have = stage(derivable(known.select(*_UNIT).distinct(), compounds), "known")
    left = stage(units.select("sentence_id", *_UNIT).join(have, _UNIT, "left_anti"), "open")
    out, parts = Reached(have), 0

    def settle() -> int:
        nonlocal left, have
        taught = 0
        for _ in range(max_rounds):
            new = _sole(left).distinct()
            if goals is not None:
                new = new.join(goals, _UNIT, "left_semi")
            new = stage(new, "new")
            n = new.count()
            out.rounds += 1
            if not n:
                return taught
            taught += learn(new, n)
        raise RuntimeError("the closure did not settle")

    def learn(new: DataFrame, n: int) -> int:
        nonlocal left, have, parts
        if compounds is None:
            # what is open is unknown, so all of new is gained, and the known units are the parts learned so far
            parts += 1
            have = have.unionByName(new) if parts % 32 else stage(have.unionByName(new), "known")
            left = _lose(left, new, n)
            return n
        grown = stage(derivable(have.unionByName(new), compounds).distinct(), "known")
        gained = stage(grown.join(have, _UNIT, "left_anti"), "gained")
        n = gained.count()
        left = _lose(left, gained, n)
        have = grown
        return n

    settle()
    while budget > 0:
        sole = _sole(left)
        if goals is not None:
            sole = sole.join(goals, _UNIT, "left_anti")
        best = sole.groupBy(*_UNIT).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("key"), F.desc("kind")).first()
        if best is None:
            break
        before = have
        learn(units.sparkSession.createDataFrame([(best["kind"], best["key"])], "kind string, key string"), 1)
        settle()
        freed = have.join(before, _UNIT, "left_anti")
        freed = freed.join(goals, _UNIT, "left_semi") if goals is not None else freed
        out.bought.append((best["kind"], best["key"], sorted(r["key"] for r in freed.collect())))
        budget -= 1
    out.known, out.open = stage(have, "known"), left
    return out


def stranded(units: DataFrame, reached: Reached, goals: DataFrame) -> DataFrame:
    """(kind, key, rank, said): goals never reached, by how many sentences say them; 0: never said."""
    lost = goals.join(reached.known, _UNIT, "left_anti")
    said = units.join(lost.select(*_UNIT), _UNIT, "left_semi").groupBy(*_UNIT).agg(F.count("*").alias("said"))
    return lost.join(said, _UNIT, "left").withColumn("said", F.coalesce("said", F.lit(0)))


def blockers(units: DataFrame, reached: Reached, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(need, frees): of each stranded goal the sentence with the fewest other unknowns (ties: least sentence_id) and
    their number; and of each other unknown there the goals it stands in the way of."""
    lost = goals.select(*_UNIT).join(reached.known, _UNIT, "left_anti")
    unknown = units.select("sentence_id", *_UNIT).join(reached.known, _UNIT, "left_anti")
    size = unknown.groupBy("sentence_id").agg(F.count("*").alias("n"))
    mine = unknown.join(lost, _UNIT, "left_semi").join(size, "sentence_id")
    best = mine.groupBy(*_UNIT).agg(F.min(F.struct("n", "sentence_id")).alias("b"))
    need = best.select(F.col("kind").alias("goal_kind"), F.col("key").alias("goal"), "b.sentence_id", (F.col("b.n") - 1).alias("cost"))
    other = need.join(unknown, "sentence_id").where("key <> goal OR kind <> goal_kind")
    return need, other.groupBy(*_UNIT).agg(F.count("*").alias("frees"))


def unblock(units: DataFrame, known: DataFrame, max_passes: int = 12, compounds=None, most_edges: int = 2_000_000) -> list[tuple[str, str]]:
    """Units to know beforehand so that everything said is reached: closures in turn with a greedy vertex cover of the
    graph of two-unknown sentences (highest degree, ties greatest key). The graph is collected as counted pairs, and a
    graph of more than most_edges pairs is refused."""
    seed: list[tuple[str, str]] = []
    spark = units.sparkSession
    for _ in range(max_passes):
        r = reachable(units, known, None, compounds=compounds)
        two = r.open.groupBy("sentence_id").agg(F.count("*").alias("n"), F.min(F.struct("key", "kind")).alias("a"), F.max(F.struct("key", "kind")).alias("b")).where("n = 2")
        pairs = two.groupBy("a", "b").agg(F.count("*").alias("n"))
        edges = {(tuple(x["a"]), tuple(x["b"])): x["n"] for x in pairs.limit(most_edges + 1).toLocalIterator()}
        if len(edges) > most_edges:
            raise ValueError(f"over {most_edges} pairs of unknowns: narrow the corpus")
        if not edges:
            break
        cover = vertex_cover(edges)
        seed += [(kind, key) for key, kind in cover]
        # open edges are those of unknown units alone, so the next closure goes on from them with the cover as all it knows
        units, known = r.open, spark.createDataFrame([(kind, key) for key, kind in cover], "kind string, key string")
        known = known if compounds is None else known.unionByName(r.known)
    return seed


def vertex_cover(edges: dict) -> list:
    """Greedy: the end of the most edges (weights count, ties greatest) until none is left."""
    import heapq

    near: dict = {}
    degree: dict = {}
    for (a, b), n in edges.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = n
            degree[x] = degree.get(x, 0) + n
    order = sorted(degree)
    place = {x: i for i, x in enumerate(order)}
    heap = [(-n, -place[x]) for x, n in degree.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        n, p = heapq.heappop(heap)
        x = order[-p]
        if not degree.get(x) or -n != degree[x]:
            continue
        out.append(x)
        degree[x] = 0
        for y, w in near.pop(x, {}).items():
            if degree.get(y):
                near[y].pop(x, None)
                degree[y] -= w
                if degree[y]:
                    heapq.heappush(heap, (-degree[y], -place[y]))
    return out
