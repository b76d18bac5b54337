"""Each corpus operator against a plain version, on small tables with nulls, ties, empty and long texts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from stepwell.llm import common, exact_dedup, html_extract, lm_score, mixing, packing, pii, quality_rules, sharding, simhash, substring, ties

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, 0 if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def text(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Texts with the cases every operator must take."""
    r = random.Random(1)
    base = [text(r, n) for n in (3, 30, 60, 90, 200)]
    return [None, "", "   \n\t ", "x", *base, *base, base[2].upper(), base[3] + " more", base[1].replace(" ", "\n"), "é😀 " * 30, "z" * 5000, text(r, 6000), "a\x00b", "same line\n" * 40]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


EXTRA = [("_row", 1), ("size", 2), ("target", 3), ("kept", 4), ("h", 5), ("copies", 6), ("_doc", 7), ("_n", 8), ("_i", 9), ("a.b", 10)]


def extra(df):
    """Other columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for n, v in EXTRA:
        df = df.withColumn(n, F.lit(v))
    return df


def test_repeated_rows_and_null_ids(spark):
    ids, texts = [None, None, 5, 5, 7], ["a b c d e", "a b c d e", "q r s t u", "q r s t u", None]
    d = frame(spark, texts, ids)
    e = exact_dedup.dedup(d).collect()
    assert len(e) == 5 and sum(r.kept for r in e) == 3
    assert simhash.classes(d).count() == 5 and simhash.keep_one(d).count() == 3
    assert sharding.shard(d).count() == 5 and mixing.copies(d).count() == 5 and packing.pack(d).where("start = 0").count() == 5


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pii.find(empty).count() == packing.pack(empty).count() == mixing.copies(empty).count() == sharding.shard(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == simhash.classes(empty).count() == substring.passages(empty).count() == 0
    assert quality_rules.judge(empty, labels)[0].count() == lm_score.score(empty, labels).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extra_columns(spark, odd):
    d = extra(frame(spark, odd))
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    n = len(odd)
    for out in (exact_dedup.dedup(d), simhash.classes(d), sharding.shard(d), mixing.copies(d), pii.find(d), quality_rules.judge(d, labels)[0], lm_score.score(d, labels)):
        assert out.count() == n
    substring.passages(d).count()
    for out in (exact_dedup.keep_first(d), simhash.keep_one(d), mixing.mixed(d), quality_rules.keep_good(d, labels)):
        rows = out.collect()
        assert out.columns == d.columns and 0 < len(rows) <= 2 * n
        assert {tuple(x) for x in rows} <= {tuple(x) for x in d.collect()}


def test_text_ids(spark, odd):
    from pyspark.sql import functions as F

    d = frame(spark, odd).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.createDataFrame([("d5", 1, 0), ("d6", 0, 0)], "doc_id string, quality int, toxic int")
    for out in (exact_dedup.dedup(d), simhash.classes(d), sharding.shard(d), mixing.copies(d), pii.find(d), quality_rules.judge(d, labels)[0], lm_score.score(d, labels)):
        assert out.count() == len(odd)


def test_shuffled_input(spark, odd):
    """The result of a shuffle is numbered once, though it is read twice."""
    d = frame(spark, odd).repartition(5, "text")
    assert sorted(x.doc_id for x in simhash.keep_one(d).collect()) == sorted(x.doc_id for x in simhash.keep_one(frame(spark, odd)).collect())


# 1
RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "phone" and 10 <= len(d) <= 15


def base_spans(t):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(RX) for m in re.finditer(RX[kind], t or "") if valid(kind, m[0]))


def test_pii_base(spark, odd):
    r = random.Random(4)
    soup = ["".join(r.choice("ab0123456789.@+-() _,") for _ in range(400)) for _ in range(60)]
    cards = ["4111 1111 1111 1111", "x4111-1111-1111-1111.", "41111111111111111111 4111111111111111", "1.2.3.4.5.6.7.8 001.02.3.255 256.1.1.1", "a@b.c_d@e.f@g.h", "+1 (22) 333-44445 +1234", "é😀a@b.co"]
    texts = [*odd, *soup, *cards, "1.1.1.1 " * 600]
    got = {x.doc_id: x for x in pii.find(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(x.s, x.k, x.e) for x in got[i].base] == base_spans(t), t


def test_pii_finds_by_context(spark):
    r = random.Random(2)
    known = [f"mail to contact: u{i}@mail{i}.com now {text(r, 5)}" for i in range(12)]
    new = [f"mail to contact: user-{i}77231 now {text(r, 5)}" for i in range(3)]
    other = [f"see page {1000 + i} of part 4{i}1200 {text(r, 5)}" for i in range(12)]
    got = {x.doc_id: [(s.s, s.k, s.e) for s in x.spans] for x in pii.find(frame(spark, known + new + other)).collect()}
    for i in range(12, 15):
        assert [new[i - 12][a:b] for a, k, b in got[i] if k == 4] == [f"user-{i - 12}77231"]
    assert all(not got[i] for i in range(15, 27))
    assert all([k for _, k, _ in got[i]] == [0] for i in range(12))


def test_pii_learns_keys_and_leaves_decoys(spark):
    """Digests after a key teach its context; values of other shapes there are found, numbers after common words not."""
    r = random.Random(28)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(8)]
    seeds = [f'{text(r, 9)} token = "{x}" {text(r, 9)} mail u{i}@mail.com the end' for i, x in enumerate(hexes)]
    new = [f"{text(r, 9)} TOKEN = 'Zq{r.randint(100, 999)}-{r.randint(100, 999)}xK'!! {text(r, 9)}" for _ in range(4)]
    decoys = [f"{text(r, 5)} the {r.randint(10**15, 10**16 - 1)} the {text(r, 9)} the version 2.0.{" token = 4111111111111112" * (k < 2)}" for k in range(20)]
    got = {x.doc_id: [(seeds + new + decoys)[x.doc_id][s.s : s.e] for s in x.found] for x in pii.find(frame(spark, seeds + new + decoys)).collect()}
    assert [got[i] for i in range(8)] == [[x] for x in hexes]
    assert all(len(got[i]) == 1 and got[i][0].startswith("Zq") and got[i][0].endswith("xK") for i in range(8, 12))
    assert not any(got[i] for i in range(12, 32))


# 2
PAGES = {
    "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two.<p>Three &#233;.</article><footer>&copy; me</footer>": "A & B\nOne two.\nThree é.",
    "<header>Site</header><main><h2>Head</h2><div class='ad'>Buy</div><p>Body  text\n here.</p><form><input><label>Mail</label></form></main><aside>Side</aside>": "Head\nBody text here.",
    "<article><p>Text.</p><script>if (a<b) {'</p>'}</script><!-- <p>no</p> --><section class='comments'><p>I liked this article a lot, thanks for it.</p></section></article>": "Text.",
    "<nav>menu</nav>": "",
    None: "",
    "": "",
}


def test_html(spark):
    d = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extract(d).collect()}
    for i, want in enumerate(PAGES.values()):
        assert (got[i].text, got[i].n_chars) == (want, len(want))


def test_cut_is_the_minimum():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 9)
        t = [(r.randint(0, 6), r.randint(0, 6)) for _ in range(n)]
        e = [(i, j, r.choice([0.5, 1, 2, 3])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4]
        cost = lambda x: sum(a if y else b for (a, b), y in zip(t, x)) + sum(w for i, j, w in e if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_extract.min_cut(t, e)) == pytest.approx(min(map(cost, itertools.product([0, 1], repeat=n))))


def test_html_survives_noise():
    r = random.Random(6)
    for _ in range(200):
        html_extract.main_text("".join(r.choice(["<p>", "</p>", "<div class='", "'>", "<a href=", ">", "text ", "<!--", "-->", "<script>", "</script>", "&amp", "<", "</", "<li>", '"']) for _ in range(80)))


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<a '", "<object>", "<svg>", "<!-", "<p title=\"x", "<li><form>"])
def test_html_is_linear(unit):
    import time

    began = time.perf_counter()
    html_extract.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 10


# 3
def test_packing(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    tok.encode_special_tokens = True
    texts = [*odd, "<|endoftext|> x", "a" * 3000, " " * 300 + "x", "\r\n 　 mixed  white"]
    rows = packing.pack(frame(spark, texts), with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids == part and r.length & (r.length - 1) == 0 and 1 <= r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.offset == 0
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_cuts():
    for n in range(1, 5000, 7):
        c = packing.cuts(n)
        assert [s for s, _ in c] == [0, *itertools.accumulate(x for _, x in c)][:-1] and sum(x for _, x in c) == n


# 4
def test_lm_score(spark, odd, monkeypatch):
    monkeypatch.setattr(lm_score, "_BLOCK", 4000)  # several blocks
    quality = {i: int(i % 2 == 0) for i in range(0, len(odd), 3)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.score(frame(spark, odd), labels).collect()}
    words = {i: [x.lower() for x in WORD.findall(t or "")] for i, t in enumerate(odd)}
    one, two = ({True: collections.Counter(), False: collections.Counter()} for _ in range(2))
    for i, w in words.items():
        for target in {False, quality.get(i) == 1}:
            one[target].update(w)
            two[target].update(zip(w, w[1:]))
    vocabulary = len(one[False])

    def loss(w, target, own):
        ones, twos = (collections.Counter(x) if own else {} for x in (w, list(zip(w, w[1:]))))
        n = one[target].total() - len(w) * own
        out = []
        for i, x in enumerate(w):
            q = (one[target][x] - ones.get(x, 0) + 1) / (n + vocabulary)
            if i:
                b = (w[i - 1], x)
                c = two[target][b] - twos.get(b, 0)
                q = (c + lm_score.SMOOTH * q) / (max(one[target][w[i - 1]] - ones.get(w[i - 1], 0), c) + lm_score.SMOOTH)
            out.append(-np.log(q))
        return float(np.mean(out))

    assert set(got) == set(words)
    for i, w in words.items():
        assert got[i].n_tokens == len(w)
        if w:
            assert got[i].background_loss == pytest.approx(loss(w, False, True)) and got[i].target_loss == pytest.approx(loss(w, True, quality.get(i) == 1))
            assert got[i].score == pytest.approx(got[i].target_loss - got[i].background_loss)
        else:
            assert got[i].score is None


def test_lm_score_tells_kinds_apart(spark):
    r = random.Random(8)
    kind = lambda letters: " ".join("".join(r.choice(letters) for _ in range(3)) for _ in range(150))
    texts = [kind("abc") for _ in range(30)] + [kind("xyz") for _ in range(30)]
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    s = {x.doc_id: x.score for x in lm_score.score(frame(spark, texts), labels).collect()}
    assert max(s[i] for i in range(1, 30, 2)) < min(s[i] for i in range(31, 60, 2))


# 5
def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        over = [n for n in free if left * w[n] / sum(w[x] for x in free) > 2 * sizes[n]]
        if not over:
            out |= {n: left * w[n] / sum(w[x] for x in free) for n in free}
            break
        for n in over:
            out[n] = 2.0 * sizes[n]
        left -= sum(out[n] for n in over)
        free -= set(over)
    return out


def test_mixing(spark):
    r = random.Random(9)
    texts = [text(r, r.randint(0, 60)) for _ in range(900)] + [None, ""]
    d = spark.createDataFrame([(i, t, "en", r.choice(["a", "a", "b", "c", "é", None]), 0) for i, t in enumerate(texts)], DOCS)
    source = {x.doc_id: x.source for x in d.collect()}
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[source[i]] += len(WORD.findall(t or ""))
    want = water(sizes)
    rows = mixing.copies(d).collect()
    taken = collections.Counter()
    for x in rows:
        assert x.size == len(WORD.findall(texts[x.doc_id] or "")) and x.source_size == sizes[source[x.doc_id]]
        assert x.target == pytest.approx(want[source[x.doc_id]]) and x.copies in (0, 1, 2)
        taken[source[x.doc_id]] += x.copies * x.size
    assert all(abs(taken[s] - want[s]) <= 61 for s in sizes)
    again = {x.doc_id: x.copies for x in mixing.copies(d.repartition(5)).collect()}
    assert again == {x.doc_id: x.copies for x in rows}


def test_pivot_keeps_words_and_chances():
    r = random.Random(10)
    sizes, p = [r.randint(1, 50) for _ in range(200)], [r.random() for _ in range(200)]
    hits = np.zeros(200)
    for k in range(400):
        out, held, left = mixing.pivot(sizes, p, k)
        got = sum(s * x for s, x in zip(sizes, out)) + (sizes[held] * left if held >= 0 else 0)
        assert got == pytest.approx(sum(s * x for s, x in zip(sizes, p)))
        hits += out
        if held >= 0:
            hits[held] += left
    assert np.abs(hits / 400 - p).max() < 0.12


def test_mixing_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    test_mixing(spark)


# 6
def test_sharding(spark, odd, monkeypatch):
    r = random.Random(11)
    texts = [*odd, *[text(r, r.randint(1, 80)) for _ in range(800)], *["copy of one text " * 5] * 500]
    monkeypatch.setattr(sharding, "RANGE_ROWS", 40)
    rows = sharding.shard(frame(spark, texts)).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        assert x["size"] == len(raw) + 1 and x.text_crc32 == zlib.crc32(raw) and x.law == "bytes" and x.grown_shard is None
        by[x.shard].append(x)
    for part in by.values():
        assert sorted(x.slot for x in part) == list(range(len(part)))
    total, largest = sum(x["size"] for x in rows), max(x["size"] for x in rows)
    assert set(by) == set(range(8)) and all(abs(sum(x["size"] for x in p) - total / 8) <= largest for p in by.values())


# 7
def plain_stats(t):
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd):
    r = random.Random(12)
    texts = [*odd, *[" ".join(r.choice("ab") for _ in range(n)) for n in (7, 8, 9, 16, 17, 40)], "a b c d e f g h i " * 3, "#*$%&|<>\n\n#\n#", "x y\nx y\n \nx y"]
    got = {x.doc_id: x for x in quality_rules.statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_stats(t), t


def test_quality_learns(spark):
    r = random.Random(13)
    good = [text(r, 60) + "." for _ in range(150)]
    bad = [" ".join(w + "#%" for w in text(r, 60).split()) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    d, rules = quality_rules.judge(frame(spark, good + bad), labels)
    kept = {x.doc_id: x.kept for x in d.collect()}
    assert rules and all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 210))
    same = quality_rules.judge(frame(spark, good), labels.where("quality = 1"))
    assert same[1] == [] and same[0].where("kept").count() == 150


# 8
def test_exact_dedup(spark, odd):
    r = random.Random(14)
    texts = [*odd, *[r.choice(["one text", "one  text", "onetext ", "other"]) for _ in range(200)]]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    groups = collections.defaultdict(list)
    for i, n in enumerate(norm):
        groups[n].append(i)
    for x in exact_dedup.dedup(frame(spark, texts)).collect():
        g = groups[norm[x.doc_id]]
        keep = min(g, key=lambda i: (-len(texts[i] or ""), i))
        assert (x.keep_id, x.group_size, x.kept, x.text_sha256) == (keep, len(g), keep == x.doc_id, hashlib.sha256(norm[x.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 3000, 60000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_has(keys, *f).all()
    if n >= 3000:
        assert exact_dedup.fuse_has(np.random.default_rng(-n % 99 + 1).integers(0, 2**63, 50_000).astype(np.uint64), *f).mean() < 0.01 and len(f[3]) < 1.6 * n


# 9
def plain_print(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 4] for i in range(len(w) - 3)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    t = ["a b c d", "é😀 z", ""]
    assert [r[0] % 2**64 for r in spark.createDataFrame([(x,) for x in t], "t string").select(F.xxhash64("t")).collect()] == [xxhash.xxh64_intdigest(x.encode(), 42) for x in t]


def test_simhash(spark, odd):
    r = random.Random(15)
    base = text(r, 120).split()
    near = []
    for _ in range(150):
        w = list(base)
        w[r.randrange(len(w))] = "swap"
        near.append(" ".join(w))
    texts = [*odd, *near]
    prints = [plain_print(t) for t in texts]
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            comp[max(a, b)] = min(a, b)
    for x in simhash.classes(frame(spark, texts)).collect():
        assert x.fp % 2**64 == prints[x.doc_id] and x.component_id == find(x.doc_id)


def test_links_span_random_prints(spark):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 2**63, 40).astype(np.uint64)
    flips = (np.uint64(1) << r.integers(0, 64, (3000, 3)).astype(np.uint64)).tolist()
    fps = sorted({int(seeds[i % 40]) ^ a ^ b ^ c for i, (a, b, c) in enumerate(flips)})
    d = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    got = {x.node % 2**64: x.component % 2**64 for x in common.components(simhash.links(d, tile=64)).collect()}
    f = np.array(fps, np.uint64)
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    groups = collections.defaultdict(set)
    for i, x in enumerate(fps):
        groups[find(i)].add(x)
    for g in groups.values():
        assert len({got.get(x, x) for x in g}) == 1
    assert len({got.get(x, x) for x in fps}) == len(groups)


def test_components(spark):
    r = random.Random(16)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (900, 900)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


# 10
def plain_chain(a, b, n):
    best = []
    for j in range(len(a)):
        s = n[j]
        for i in range(j):
            between = (a[j] - a[i] - n[i], b[j] - b[i] - n[i])
            if min(between) > -substring.K:
                s = max(s, n[j] + best[i] - substring.GAP_COST * sum(between))
        best.append(s)
    return max(best)


def test_chains():
    r = random.Random(17)
    for _ in range(300):
        m = sorted({(r.randint(0, 60), r.randint(0, 60)): r.randint(4, 12) for _ in range(r.randint(1, 25))}.items())
        a, b, n = ([f(x) for x in m] for f in (lambda x: x[0][0], lambda x: x[0][1], lambda x: x[1]))
        found = substring.chains(a, b, n)
        for c in found:
            assert all(a[i] + n[i] - a[j] < substring.K and b[i] + n[i] - b[j] < substring.K for i, j in zip(c, c[1:]))
        assert sorted(i for c in found for i in c) == list(range(len(m)))
        c = found[0]
        score = sum(n[i] for i in c) - substring.GAP_COST * sum(a[j] - a[i] - n[i] + b[j] - b[i] - n[i] for i, j in zip(c, c[1:]))
        assert score == pytest.approx(plain_chain(a, b, n))


def test_stretches():
    r = random.Random(27)
    for _ in range(100):
        rows = sorted({(r.randint(0, 2), 3, r.randint(0, 15), r.randint(0, 15), r.choice([4, 4, 9])) for _ in range(r.randint(1, 40))})
        cols = [np.array(c) for c in zip(*rows)]
        got = list(zip(*(c.tolist() for c in substring.stretches(*cols))))
        cells = {(a, p + i, q + i) for a, _, p, q, n in rows for i in range(n)}
        names = {a: k for k, a in enumerate(sorted({x[0] for x in rows}))}
        assert sorted((k, p + i, q + i) for k, p, q, n in got for i in range(n)) == sorted((names[a], p, q) for a, p, q in cells)
        assert got == sorted(got) and not any((k, p + n, q + n) in {(names[a], x, y) for a, x, y in cells} for k, p, q, n in got)


def test_passages(spark, odd):
    r = random.Random(18)
    shared = [text(r, 55) for _ in range(4)]
    fuzzy = text(r, 80).split()
    changed = [w if i % 19 else "other" for i, w in enumerate(fuzzy)]
    texts = [text(r, 40) + " " + shared[k % 4] + " " + text(r, 30) for k in range(16)] + [text(r, 20) + " " + " ".join(fuzzy), " ".join(changed) + " " + text(r, 25)] + [text(r, 150) for _ in range(10)] + [None, "", "a b", text(r, 60)[:-3] + " " + shared[0][: len(shared[0]) // 2]]
    rows = substring.passages(frame(spark, texts)).collect()
    hit = {x.doc_id for x in rows} | {x.other_id for x in rows}
    assert hit == set(range(18))
    by = collections.defaultdict(set)
    for x in rows:
        assert x.end - x.start >= 50 and x.similarity >= 0.8
        by[x.class_id] |= {x.doc_id, x.other_id}
    assert sorted(map(sorted, by.values())) == [[k, k + 4, k + 8, k + 12] for k in range(4)] + [[16, 17]]
    one = next(x for x in rows if {x.doc_id, x.other_id} == {0, 12})
    assert shared[0] in " ".join(texts[one.doc_id].split()[one.start : one.end])


def test_passages_of_repeated_words(spark):
    run = " ".join(w for w in ("wher", "th", "inwhorst", "ernd") for _ in range(17))
    assert {x.similarity for x in substring.passages(frame(spark, [run, run])).collect()} == {1.0}


def substituted(r, words, alike):
    out = list(words)
    for i in r.sample(range(len(words)), round(len(words) * (1 - alike))):
        out[i] = "other" + str(r.random())
    return out


def test_fuzzy_passages_are_seeded(spark):
    """Every pair that shares 52 words at 0.80 to 0.90 has matches to chain."""
    r = random.Random(19)
    texts = []
    for k in range(80):
        passage = text(r, 52).split()
        texts += [" ".join([*text(r, 60).split(), *p, *text(r, 60).split()]) for p in (passage, substituted(r, passage, (0.8, 0.82, 0.85, 0.9)[k % 4]))]
    ids = {row._row: row.doc_id for row in common.numbered(frame(spark, texts)).select("_row", "doc_id").collect()}
    assert {(ids[m.a], ids[m.b]) for m in substring.matches(common.numbered(frame(spark, texts)).select("_row", "text"))[0].collect()} >= {(k, k + 1) for k in range(0, 160, 2)}


def test_segments():
    """All columns of any stretch that is long and alike enough are held, and nothing else."""
    r = random.Random(20)
    for _ in range(300):
        ops = np.array(r.choices(range(4), [r.choice([3, 8, 16]), 1, r.choice([0, 1]), r.choice([0, 1])], k=r.randint(1, 50)))

        def good(i, j):
            x, y, edits = (int(v[i:j].sum()) for v in (ops != substring.ONLY_Y, ops != substring.ONLY_X, ops != substring.SAME))
            return min(x, y) >= 5 and 5 * edits <= max(x, y)

        want, got = np.zeros(len(ops), bool), np.zeros(len(ops), bool)
        for i, j in itertools.combinations(range(len(ops) + 1), 2):
            if ops[i] == ops[j - 1] == substring.SAME and good(i, j):
                want[i:j] = True
        for i, j in substring.segments(ops, 5, 0.8):
            assert good(i, j)
            got[i:j] = True
        assert (got == want).all()


def test_passages_of_a_template(spark):
    """Equal paragraphs with other words between are each in a row, though the whole is too unlike."""
    r = random.Random(21)
    same = [text(r, 55) for _ in range(8)]
    texts = [" ".join(w for p in same for w in (text(r, 20), p)) for _ in range(2)]
    rows = substring.passages(frame(spark, texts)).collect()
    for k in range(8):
        lo = 75 * k + 20
        assert any(x.start <= lo and lo + 55 <= x.end for x in rows)


def test_fuzzy_passages_are_found(spark):
    """60 words at 0.85 in pairs of texts, with words substituted, left out and put in."""
    r = random.Random(22)
    texts = []
    for _ in range(20):
        one = text(r, 60).split()
        two = list(one)
        for i in sorted(r.sample(range(3, 57), 9), reverse=True):
            two[i : i + 1] = r.choice([["other"], [], ["other", two[i]]])
        texts += [" ".join([text(r, 40), *p, text(r, 40)]) for p in (one, two)]
    rows = substring.passages(frame(spark, texts)).collect()
    assert {(x.other_id, x.doc_id) for x in rows} == {(k, k + 1) for k in range(0, 40, 2)}


def test_passages_between_common_parts(spark):
    """Two middle texts share 50 words whose parts, overlapping and all too short, are in earlier and later texts."""
    r = random.Random(23)
    first, middle, last = [], [], []
    for _ in range(6):
        p = text(r, 50).split()
        around = lambda words: " ".join([text(r, 40), *words, text(r, 40)])
        first += [around(p[:35]), around(p[25:])]
        middle += [around(p), around(p)]
        last += [around(p[:35]), around(p[25:])]
    rows = substring.passages(frame(spark, first + middle + last)).collect()
    assert {(x.other_id, x.doc_id) for x in rows} == {(k, k + 1) for k in range(12, 24, 2)}


def test_six_documents(spark):
    """3 and 4 share 80 words of which 1 and 5 hold the first 45, 2 and 6 the last 45."""
    r = random.Random(24)
    p = text(r, 80).split()
    around = lambda words: " ".join([text(r, 60), *words, text(r, 60)])
    rows = substring.passages(frame(spark, list(map(around, (p[:45], p[35:], p, p, p[:45], p[35:]))), [1, 2, 3, 4, 5, 6])).collect()
    assert {(x.other_id, x.doc_id) for x in rows} == {(3, 4)}


def test_recall_at_even_edits(spark):
    """Passages of 100 words with each nth word another, all within the threshold."""
    r = random.Random(5)
    texts = []
    for every in (5, 6, 7, 8, 10):
        for _ in range(20):
            p = text(r, 100).split()
            texts += [" ".join([text(r, 50), *x, text(r, 50)]) for x in (p, [w if i % every != every // 2 else "other" + str(r.random()) for i, w in enumerate(p)])]
    rows = substring.passages(frame(spark, texts)).collect()
    assert {(x.other_id, x.doc_id) for x in rows} == {(k, k + 1) for k in range(0, len(texts), 2)}


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
    return row[-1]


def test_passages_against_all_pairs(spark):
    """Copies with random edits: all pairs that brute force finds are tied in a class, and each row is as alike as it says."""
    r = random.Random(25)
    texts = []
    for _ in range(12):
        p = text(r, 50).split()
        for _ in range(3):
            q = list(p)
            for i in sorted(r.sample(range(50), r.randint(0, 10)), reverse=True):
                q[i : i + 1] = r.choice([["new" + text(r, 1)], [], [q[i], "new" + text(r, 1)]])
            texts.append(" ".join(q))
    texts += [text(r, 60) for _ in range(10)]
    r.shuffle(texts)
    words = [t.split() for t in texts]
    want = set()
    for i, j in itertools.combinations(range(len(words)), 2):
        x, y = words[i], words[j]
        if min(len(x), len(y)) >= 50 and x[0] == y[0] and x[-1] == y[-1] and edit_distance(x, y) <= 0.2 * max(len(x), len(y)):
            want.add((i, j))
    rows = substring.passages(frame(spark, texts)).collect()
    of = {}
    for x in rows:
        of[x.doc_id] = of[x.other_id] = x.class_id
        u, v = words[x.doc_id][x.start : x.end], words[x.other_id][x.other_start : x.other_end]
        assert min(len(u), len(v)) >= 50 and 1 - edit_distance(u, v) / max(len(u), len(v)) >= x.similarity - 1e-9 and x.similarity >= 0.8 - 1e-9
    assert len(want) > 5 and all(i in of and of.get(i) == of.get(j) for i, j in want)


def test_common_seeds_meet(spark, monkeypatch):
    """Many copies of a passage, hot in a block and over all: one class, and not all pairs."""
    monkeypatch.setattr(substring, "HOT", 8)
    monkeypatch.setattr(substring, "FEW", 4)
    r = random.Random(26)
    p = text(r, 55)
    texts = [f"{text(r, 20)} {p} {text(r, 20)}" for _ in range(300)]
    rows = substring.passages(frame(spark, texts)).collect()
    assert {x.class_id for x in rows} == {0} and {x.doc_id for x in rows} | {x.other_id for x in rows} == set(range(300))
    assert len(rows) < 3000


def test_common_seeds_lose_no_link(spark, tmp_path):
    """The last two share 60 words, each sixth another; every run of five between lies apart in nine earlier documents."""
    r = random.Random(27)
    p = text(r, 60).split()
    runs = [p[i : i + 5] for i in range(0, 60, 6)]
    texts = [" ".join(w for run in runs for w in (text(r, 60), *run)) for _ in range(9)]
    texts += [" ".join([text(r, 50), *x, text(r, 50)]) for x in (p, [f"other{i}" if i % 6 == 5 else w for i, w in enumerate(p)])]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = substring.op10_substring(spark, str(tmp_path)).collect()
    assert {(x.other_id, x.doc_id, x.class_id) for x in rows} == {(9, 10, 9)}


def test_all_met():
    r = np.random.default_rng(28)
    row, pos, h = r.integers(0, 6, 200), np.arange(200), r.integers(0, 20, 200).astype(np.uint64)
    want = sorted((row[i], row[j], pos[i], pos[j]) for i in range(200) for j in range(200) if h[i] == h[j] and row[i] < row[j])
    got = list(substring.all_met(row, pos, h, 50))
    assert len(got) > 2 and sorted(zip(*np.concatenate(got, axis=1).tolist())) == want
    assert not list(substring.all_met(row[:0], pos[:0], h[:0]))


def test_a_common_line_brings_none_together(spark):
    """A line of 13 words in 60 texts gives no seeds that meet; a passage of 60 words, 10 of them other, does."""
    r = random.Random(29)
    line, p = text(r, 13), text(r, 60).split()
    texts = [f"{text(r, 60)} {line} {text(r, 60)}" for _ in range(60)]
    frame_of = lambda texts: ties.met(ties.blocks(spark.createDataFrame(list(enumerate(texts)), "_row long, text string")), 50, 0.8)
    assert frame_of(texts).count() == 0
    texts += [" ".join([text(r, 50), *x, line]) for x in (p, [f"other{i}" if i % 6 == 5 else w for i, w in enumerate(p)])]
    assert {x.row for x in frame_of(texts).where("h IS NOT NULL").collect()} == {60, 61}


def test_longest_runs():
    """Of words from few kinds, as brute force finds them on each diagonal; one word over and over gives no product."""
    r = np.random.default_rng(30)
    for _ in range(30):
        x, y = (r.integers(0, 3, r.integers(0, 40)).astype(np.uint32) for _ in range(2))
        want = []
        for p, q in itertools.product(range(len(x)), range(len(y))):
            if not (p and q and x[p - 1] == y[q - 1]):
                n = next((n for n in range(min(len(x) - p, len(y) - q)) if x[p + n] != y[q + n]), min(len(x) - p, len(y) - q))
                want += [(p, q, n)] * (n >= substring.K)
        u, v = ties.Side(x), ties.Side(y)
        u.sort()
        assert list(zip(*(z.tolist() for z in ties.runs(u, v)))) == want
    u, v = ties.Side(np.ones(3000, np.uint32)), ties.Side(np.ones(2000, np.uint32))
    u.sort()
    assert len(ties.runs(u, v)[0]) == 4993


def test_classes_are_those_of_all_pairs(spark):
    """Edited copies, a group of many near copies, a copy, a null: the classes of all pairs, from fewer of their rows."""
    r = random.Random(31)
    texts = []
    for size in (2, 3, 4, 5, 40):
        p = text(r, 70).split()
        for _ in range(size):
            q = list(p)
            for i in r.sample(range(70), r.randint(0, 12)):
                q[i] = "new" + text(r, 1)
            texts.append(" ".join([text(r, 20), *q]))
    docs = frame(spark, [*texts, texts[0], None])
    got, want = substring.classes(docs).collect(), substring.passages(docs, few=None).collect()
    of = lambda rows: {i: x.class_id for x in rows for i in (x.doc_id, x.other_id)}
    assert of(got) == of(want) and len(of(got)) > 40 and set(got) <= set(want) and len(got) < len(want) / 2


def test_who_shares_a_part_of_a_line_is_not_compared(spark, monkeypatch):
    """24 texts repeat lines of which 18 of 40 words are the same; two of them share a passage, behind a seed that others have."""
    r = random.Random(37)
    part, p = text(r, 18), text(r, 60)
    texts = [" ".join(f"{part} {line}" for _ in range(5)) for line in (text(r, 22) for _ in range(24))]
    texts[3], texts[20] = f"{texts[3]} {p}", f"{p} {texts[20]}"
    seen, real = [], ties.links
    monkeypatch.setattr(ties, "links", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    rows = substring.classes(frame(spark, texts)).collect()
    assert {(x.other_id, x.doc_id) for x in rows} == {(3, 20)} and sum(seen) < 60


def test_no_passage_is_apart_by_the_words_around_a_seed():
    """Passages of 50 to 400 words, as alike as they must be, in other text: the two meet in some seed that both have."""
    r = random.Random(38)
    far, tried = ties.reach(50, 0.8), 0
    for n in [50, 51, 60, 99, 100, 124, 150, 200, 400] * 6:
        x = np.array([r.randrange(1, 1 << 32) for _ in range(n)], np.uint32)
        y = x.tolist()
        for i in sorted(r.sample(range(1, n - 1), n // 5), reverse=True):
            how = r.choice(["other", "less", "more"])
            y[i : i + 1] = [r.randrange(1, 1 << 32)] if how == "other" else [] if how == "less" else [y[i], r.randrange(1, 1 << 32)]
        a, b = (np.concatenate([[r.randrange(1, 1 << 32) for _ in range(150)], z, [r.randrange(1, 1 << 32) for _ in range(150)]]).astype(np.uint32) for z in (x, y))
        u, v = ties.Side(a), ties.Side(b)
        u.sort()
        if not ties.shared(u, v, 50, 0.8):
            continue
        tried += 1
        g, h = (ties.grams(z.astype(np.uint64), ties.K) for z in (a, b))
        both = [k for k in np.intersect1d(g, h)]
        met = [ties.meetings([ties.around(np.flatnonzero(s == k), z, far) for s, z in ((g, a), (h, b))], [0, 1], 50, 0.8, True) for k in both]
        # whichever seed is the rarest of a passage of fewer than twice the words: any may be
        assert all(met) if n < 100 else any(met)
    assert tried > 20
    ends = np.arange(1, 46, dtype=np.uint32)
    assert not ties.meetings([ends, ends, np.zeros(0, np.uint32)], [0, 1, 2], 50, 0.8, False)
    wide = np.arange(1, 61, dtype=np.uint32)
    assert ties.meetings([wide] * 4, [0, 1, 1, 2], 50, 0.8, False) == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]
    assert ties.meetings([wide] * 4, [0, 1, 1, 2], 50, 0.8, True) == [(0, 1), (0, 3)]


def test_seeds_of_one_class_bring_none_together(spark):
    """Three texts share a passage; those of one label have no seed that counts, and enough seeds near one must be in both."""
    r = random.Random(41)
    p = text(r, 60)
    rows = ties.met(ties.blocks(spark.createDataFrame([(i, f"{text(r, 30)} {p}") for i in range(3)], "_row long, text string")), 50, 0.8).where("h IS NULL")
    meet = lambda labels: ties.near_enough(ties.parted(ties.labelled(rows.selectExpr("row", f"element_at(array({labels}), int(row) + 1) label", "at", "seeds")), 50, 0.8), 50, 0.8).collect()
    assert not meet("0L, 0L, 0L") and {x.row for x in meet("0L, 0L, 2L")} == {0, 1, 2}
    behind = np.ones(20, np.uint16)
    start, both = np.zeros(1, np.int64), np.arange(20) < 18
    assert ties.enough(both, start, behind, 50, 0.8)[0] and not ties.enough(both & (np.arange(20) > 0), start, behind, 50, 0.8)[0]
    assert not ties.enough(both, start, behind * 4, 50, 0.8)[0]
