"""Closures, walks and covers against plain Python."""

import itertools
import random
import tracemalloc

import pytest

from stepwell.operators import index
from stepwell.plans import compounds, labels, reach, videos, walk

UNITS = "sentence_id long, video_id long, channel string, kind string, key string"


def edges(spark, sents):
    rows = [(i, 1, "c", "lemma", k) for i, ks in enumerate(sents) for k in ks]
    return spark.createDataFrame(rows, UNITS)


def names(spark, keys):
    return spark.createDataFrame([("lemma", k) for k in keys], "kind string, key string")


def ranked(spark, keys):
    return spark.createDataFrame([("lemma", k, i) for i, k in enumerate(keys)], "kind string, key string, rank int")


def texts(spark, n):
    return spark.createDataFrame([(i, f"Text number {i} says this much.") for i in range(n)], "sentence_id long, text string")


def closed(sents, known, goals, budget=0):
    known, bought = set(known), []
    while True:
        while True:
            new = [u for s in sents if len(m := s - known) == 1 for u in m if u in goals]
            if not new:
                break
            known.add(random.choice(new))
        if budget <= 0:
            return known, bought
        gain = {}
        for s in sents:
            if len(m := s - known) == 1:
                (u,) = m
                gain[u] = gain.get(u, 0) + 1
        if not gain:
            return known, bought
        best = max(gain, key=lambda u: (gain[u], u))
        known.add(best)
        bought.append(best)
        budget -= 1


def corpus(seed, n=40, units=18):
    r = random.Random(seed)
    return [set(r.sample([f"u{i:02d}" for i in range(units)], r.randint(1, 4))) for _ in range(n)]


def test_index_states(spark):
    e = edges(spark, [{"ich", "sein"}, {"ich", "sein", "haus"}, {"ich", "haus", "baum"}, {"ich", "haus", "baum", "x"}])
    g = index.gap(e, names(spark, ["ich", "sein"]))
    assert {r.sentence_id: r.unknown for r in g.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert [(r.key, r.candidates) for r in index.frontier(g).collect()] == [("haus", 1)]
    assert {r.key: r.unlocks for r in index.lookahead(g).collect()} == {"haus": 1, "baum": 1}


@pytest.mark.parametrize("budget", [0, 3])
def test_reachable_any_order(spark, budget):
    sents = corpus(5)
    goals = {f"u{i:02d}" for i in range(3, 14)}
    want, bought = closed(sents, {"u00", "u01"}, goals, budget)
    r = reach.reachable(edges(spark, sents), names(spark, ["u00", "u01"]), names(spark, goals), budget)
    assert {x.key for x in r.known.collect()} == want
    assert [b[1] for b in r.bought] == bought


def test_blocked_and_cascade(spark):
    go = lambda sents, known, goals, b=0: {x.key for x in reach.reachable(edges(spark, sents), names(spark, known), names(spark, goals), b).known.collect()}
    assert go([{"ich", "spam", "goal"}], ["ich"], ["goal"]) == {"ich"}
    assert go([{"ich", "one"}, {"ich", "one", "two"}], ["ich"], ["one", "two"]) == {"ich", "one", "two"}
    assert "goal" in go([{"spam", "goal"}, {"spam", "ich"}, {"egg", "ich"}, {"egg", "other"}], ["ich"], ["goal", "other"], 4)


def test_compounds(spark):
    inv = names(spark, ["krankenhaus", "krank", "haus", "arzt", "krankenhausarzt"])
    pairs = spark.createDataFrame([("krankenhaus", ["krank", "haus"]), ("krankenhausarzt", ["krankenhaus", "arzt"]), ("nie", ["fehlt", "haus"])], "word string, parts array<string>")
    rules = compounds.over(inv, pairs)
    got = {x.key for x in compounds.derivable(names(spark, ["krank", "haus", "arzt"]), rules).collect()}
    assert got == {"krank", "haus", "arzt", "krankenhaus", "krankenhausarzt"}
    assert {x.key for x in compounds.derivable(names(spark, ["krank"]), rules).collect()} == {"krank"}


def test_grants_are_free(spark):
    inv = names(spark, ["kh", "a", "b", "goal"])
    rules = compounds.over(inv, spark.createDataFrame([("kh", ["a", "b"])], "word string, parts array<string>"))
    e = edges(spark, [{"kh", "goal"}])
    assert "goal" in {x.key for x in reach.reachable(e, names(spark, ["a", "b"]), names(spark, ["goal"]), compounds=rules).known.collect()}
    assert "goal" not in {x.key for x in reach.reachable(e, names(spark, ["a", "b"]), names(spark, ["goal"])).known.collect()}


def test_walk_is_the_naive_walk(spark):
    sents = corpus(9, 60, 20)
    e, k, g = edges(spark, sents), names(spark, ["u00", "u01", "u02"]), ranked(spark, [f"u{i:02d}" for i in range(4, 12)])
    fast = [(r.kind, r.key, r.gain) for r in walk.roadmap(e, texts(spark, 60), k, g, [("p", {})], 6).orderBy("position").collect()]
    assert fast == walk.naive(e, k, g, 6)


def test_each_step_teaches_one(spark):
    sents = corpus(2, 60, 20)
    known = {"u00", "u01", "u02"}
    steps = walk.roadmap(edges(spark, sents), texts(spark, 60), names(spark, known), ranked(spark, []), [("p", {})]).orderBy("position").collect()
    assert steps
    for s in steps:
        assert sents[s.sentence_id] - known == {s.key}
        assert s.readable == sum(not (x - known) for x in sents) and s.occurrences == sum(s.key in x for x in sents)
        known.add(s.key)
    assert all(len(x - known) != 1 for x in sents)


def test_gain_and_priority_and_wall(spark):
    run = lambda sents, known, goals, **o: walk.roadmap(edges(spark, sents), texts(spark, 9), names(spark, known), ranked(spark, goals), [("p", o)]).orderBy("position").collect()
    first = run([{"ich", "a"}, {"ich", "b"}, {"ich", "b", "c"}], ["ich"], [], weight=0.0)[0]
    assert (first.key, first.gain) == ("b", 2)
    assert run([{"ich", "rare"}, {"ich", "common"}], ["ich"], ["common", *[f"x{i}" for i in range(998)], "rare"])[0].key == "common"
    assert run([{"a", "b", "c"}], ["zz"], []) == []


def test_relax(spark):
    run = lambda sents: walk.roadmap(edges(spark, sents), texts(spark, 9), names(spark, ["zz"]), ranked(spark, []), [("p", {"relax": True})]).orderBy("position").collect()
    steps = run([{"A"}, {"B", "C"}])
    assert len(steps) == 2 and steps[1].beside and {steps[1].key, steps[1].beside} == {"B", "C"}
    assert run([{"B", "C", "D"}]) == []


def test_refresh_goes_on(spark):
    sents = corpus(4, 60, 20)
    e, t, k, g = edges(spark, sents), texts(spark, 60), names(spark, ["u00", "u01", "u02"]), ranked(spark, [])
    whole = walk.roadmap(e, t, k, g, [("p", {})]).orderBy("position").collect()
    old = walk.roadmap(e, t, k, g, [("p", {})], 3)
    more = walk.refresh(e, t, k, g, old, [("p", {})]).orderBy("position").collect()
    assert [(r.position, r.key) for r in more] == [(r.position, r.key) for r in whole]


def test_frontier_is_a_fresh_one():
    import numpy as np

    r = random.Random(1)
    sents = [np.array(sorted(r.sample(range(15), r.randint(1, 5)))) for _ in range(50)]
    f = walk.Frontier(sents, 15)
    known = np.zeros(15, bool)
    for u in r.sample(range(15), 12):
        f.learn(u)
        known[u] = True
        new = walk.Frontier(sents, 15, known)
        assert (f.left == new.left).all() and (f.ones == new.ones).all() and (f.twos == new.twos).all() and (f.left >= 0).all()


def test_video_walk(spark):
    rows = [(i, v, "c", "lemma", k) for v, ss in ((1, [["ich", "alpha"], ["ich", "beta"]]), (2, [["ich", "gamma"], ["ich", "delta"]])) for i, s in enumerate(ss, v * 10) for k in s]
    e = spark.createDataFrame(rows, UNITS)
    m = spark.createDataFrame([(1, 10.0), (2, 10.0)], "video_id long, minutes double")
    order = lambda taste: [r.video_id for r in videos.walk(e, names(spark, ["ich"]), m, spark.createDataFrame(taste, "video_id long, taste double"), floor=0).orderBy("position").collect()]
    assert order([(9, 1.0)]) == [2, 1]
    assert order([(1, 2.0)]) == [1, 2]


def test_cover_is_the_cheapest():
    r = random.Random(3)
    for _ in range(60):
        vids = range(r.randint(2, 8))
        mins = {v: r.randint(5, 40) for v in vids}
        supply = {u: {v: r.randint(1, 3) for v in vids if r.random() < 0.5} for u in "abcde"}
        supply = {u: s for u, s in supply.items() if s}
        c = videos.solve(supply, mins, 2)
        if not supply:
            assert c.status == "nothing to cover"
            continue
        cost = min(sum(mins[v] for v in p) for k in range(len(vids) + 1) for p in itertools.combinations(vids, k) if not videos.audit(supply, p, 2))
        assert c.status == "Optimal" and c.minutes == cost and not videos.audit(supply, c.videos, 2)


def test_cover_facts():
    assert videos.solve({"a": {"long": 5, "short": 5}}, {"long": 90, "short": 10}).videos == ("short",)
    assert videos.solve({"a": {"both": 1, "ja": 1}, "b": {"both": 1, "jb": 1}}, {"both": 30, "ja": 20, "jb": 20}, 1).videos == ("both",)
    thin = videos.solve({"thin": {"v": 1}}, {"v": 5})
    assert thin.status == "Optimal" and thin.short == {"thin": (1, 1)}
    assert videos.audit({"a": {1: 2, 2: 3}}, [1], 5) == [("a", 2, 5)]


def test_cover_of_many_videos_takes_little_memory():
    r = random.Random(1)
    vids = range(30_000)
    supply = {f"u{u}": {v: r.choice((1, 1, 2)) for v in r.sample(vids, 600)} for u in range(100)}
    mins = {v: r.randint(1, 40) for v in vids}
    tracemalloc.start()
    try:
        c = videos.solve(supply, mins)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert c.status == "Feasible" and c.nodes == 200 and not videos.audit(supply, c.videos, 5) and peak < 60e6


def test_cover_reads_its_supply_in_a_task(spark, monkeypatch):
    r = random.Random(2)
    supply = {u: {v: r.randint(1, 3) for v in range(30) if r.random() < 0.4} for u in "abcdefg"} | {"thin": {3: 1}}
    mins = {v: float(r.randint(1, 40)) for v in range(30)}
    s = spark.createDataFrame([(u, v, n) for u, x in supply.items() for v, n in x.items()], "key string, video_id long, n long")
    m = spark.createDataFrame(list(mins.items()), "video_id long, minutes double")
    want = videos.solve(supply, mins)
    monkeypatch.setattr(videos, "solve", None)  # that would hold the supply on the driver
    assert videos.cover(s, m) == want and want.short == {"thin": (1, 1)}
    assert videos.cover(s.where("n > 9"), m).status == "nothing to cover"


def test_vertex_cover():
    edges_ = {("a", "b"): 1, ("a", "c"): 1, ("d", "e"): 1}
    assert reach.vertex_cover(edges_) == ["a", "e"]


def test_labels():
    for builds in ((), ("subtitle",), ("subtitle:llm", "generated")):
        for bits in itertools.product([False, True], repeat=7):
            good, strict, only, goals, beginner, unblock, relax = bits
            p = labels.Plan(builds, good, strict, only, goals, "b1" if goals else "", beginner, unblock, relax)
            assert labels.read(labels.write(p)) == p
    assert labels.read("subtitle:good:strict:goals:b1:unblock:relax").goal_list == "b1"
    assert labels.stored(["x", "y"], {"y"}) == "y"
