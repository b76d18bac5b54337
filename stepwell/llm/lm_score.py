"""Cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary, the words of all documents, and have the same order and smoothing; the target's counts
come from the documents labelled good, the background's from all. Each token's two losses differ by what the target
model knows better; a document's score is the mean difference. A document's own counts are left out of both models while
it is scored.

The counts are a distributed table of all words and bigrams that grows with the corpus. Documents are dealt into blocks;
a block asks once for each of its words and bigrams, so that a common one costs a row a block and not a row a document,
and each gets the counts over all blocks back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import numbered, release, settled, ship, stage
from stepwell.llm.words import grams, hashed, packed, unpacked

#: Weight of the unigram estimate in a bigram's, in counts.
SMOOTH = 4.0
#: Bytes of text of a block, about (a longer text is a block of its own), and of all texts to a bucket of counts.
_BLOCK = 6 << 20
_BUCKET = 64_000_000
#: Bits of a hash within a bucket.
_KEY = 36


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_row, doc_id, text, target), settled: target where a label calls the document good."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("target", F.lit(True))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(good.hint("merge"), "doc_id", "left")
    return numbered(settled(rows.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")))).select("_row", "doc_id", "text", "target")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (_row, ..., text, target) in tables of about _BLOCK bytes of text, the same at each scan."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        sizes = pc.binary_length(b.column("text")).fill_null(0).to_pylist()
        lo = 0
        for i, n in enumerate(sizes):
            if size and size + n > _BLOCK:
                held.append(b.slice(lo, i - lo))
                yield pa.Table.from_batches(held)
                held, size, lo = [], 0, i
            size += n
        held.append(b.slice(lo))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of each key among them, how often each has it)."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], place, np.bincount(place, minlength=int(new.sum()))


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, document of each, bigrams, the place of each one's second word, words of each document)."""
    texts = table.column("text").combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    w, bounds = hashed(texts)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    second = np.flatnonzero(np.append(False, doc[1:] == doc[:-1])[: len(doc)])
    return w, doc, grams(w, 2)[second - 1], second, n


def counts(rows: DataFrame) -> DataFrame:
    """The counts of all words and bigrams, for each block in the order of its distinct ones: rows (block, part, all,
    good), staged; part tells words' buckets, then bigrams'. Rows without block give a bucket's words, v distinct, n in
    all, g in the target."""
    spark = rows.sparkSession
    ship(spark)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _BUCKET))
    bits = max(1, (buckets - 1).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            w, doc, pairs, second, _ = _tokens(table)
            target = table.column("target").to_numpy()[doc] if len(doc) else np.zeros(0, bool)
            out = []
            for kind, h, good in ((0, w, target), (1, pairs, target[second])):
                keys, place, n = _runs(h)
                g = np.bincount(place, weights=good, minlength=len(keys)).astype(np.uint32)
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                key = (keys << np.uint64(bits)) >> np.uint64(64 - _KEY)
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys)).tolist() if len(keys) else [0]
                for i, j in zip(cuts, cuts[1:]):
                    delta = np.diff(key[i:j], prepend=np.uint64(0))
                    out.append((int(bucket[i]) + (kind << bits), packed(delta), packed(n[i:j].astype(np.uint32)), packed(g[i:j])))
            block = table.column("_row")[0].as_py()
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], ["block", "part", "key", "all", "good"])

    def add(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        key = [np.cumsum(unpacked(x.as_py(), np.uint64)) for x in t.column("key")]
        cuts = np.cumsum([0, *map(len, key)]).tolist()
        keys, place, _ = _runs(np.concatenate(key))
        out, sums = {}, []
        for name in ("all", "good"):
            own = np.concatenate([unpacked(x.as_py(), np.uint32) for x in t.column(name)])
            total = np.bincount(place, weights=own, minlength=len(keys)).astype(np.uint64)
            sums.append(int(total.sum()))
            back = total[place]
            out[name] = pa.array([*(packed(back[i:j]) for i, j in zip(cuts, cuts[1:])), None], pa.binary())
        word = not part >> bits
        last = lambda x: pa.array([None] * (len(cuts) - 1) + [x if word else 0], pa.int64())
        blocks = pa.array([*t.column("block").to_pylist(), None], pa.int64())
        return pa.table({"block": blocks, "part": pa.array([part] * len(cuts), pa.int32()), **out, "v": last(len(keys)), "n": last(sums[0]), "g": last(sums[1])})

    asked = rows.select("_row", "text", "target").mapInArrow(ask, "block long, part int, key binary, all binary, good binary")
    return stage(asked.groupBy("part").applyInArrow(add, "block long, part int, all binary, good binary, v long, n long, g long"), "counts")


def _own(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each token's document has it."""
    _, at, n = _runs(doc * (int(place.max(initial=0)) + 1) + place)
    return n[at]


def losses(one: np.ndarray, two: np.ndarray, second: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Loss of each token: one has the counts of words, two those of the bigrams that end at the places second; total
    (of each token's document) all words counted."""
    p = (one + 1.0) / (total + vocabulary)
    p[second] = (two + SMOOTH * p[second]) / (np.maximum(one[second - 1], two) + SMOOTH)
    return -np.log(p)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_tokens, target_loss, background_loss, score), one for each row of docs; a lower score is more
    like the target. Losses are means over tokens, in nats.

    Null or empty text: no tokens, losses null. Null or repeated doc_ids are rows of their own; a label counts for
    all rows with its doc_id. Without good labels the target model is the smoothing alone. An empty table gives no
    rows. Other columns are ignored.
    """
    rows = flagged(docs, labels)
    release(docs.sparkSession)
    found = counts(rows)
    release(docs.sparkSession)
    words, n_all, n_good = (x or 0 for x in found.agg(F.sum("v"), F.sum("n"), F.sum("g")).first())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            whole = table.select(["doc_id", "text", "target"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            yield pa.RecordBatch.from_arrays([table.column("_row").slice(0, 1).combine_chunks(), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    def judge(docs_: pa.Table, totals: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(docs_.column("docs")[0].as_py()).read_all()
        w, doc, pairs, second, n = _tokens(table)
        target = table.column("target").to_numpy()
        order = np.argsort(totals.column("part").to_numpy())
        of = {c: np.concatenate([np.zeros(0), *(unpacked(totals.column(c)[int(i)].as_py(), np.uint64).astype(np.float64) for i in order)]) for c in ("all", "good")}
        distinct, one, _ = _runs(w)
        _, two, _ = _runs(pairs)
        own = _own(doc, one), _own(doc[second], two)
        means = {}
        for c, total, mine in (("all", n_all, np.ones(len(n), bool)), ("good", n_good, target)):
            first = np.maximum(of[c][one] - own[0] * mine[doc], 0)
            both = np.maximum(of[c][len(distinct) + two] - own[1] * mine[doc[second]], 0)
            loss = losses(first, both, second, np.maximum(total - n * mine, 0)[doc].astype(np.float64), words)
            means[c] = np.bincount(doc, weights=loss, minlength=len(n)) / np.maximum(n, 1)
        empty = n == 0
        cols = (means["good"], means["all"], means["good"] - means["all"])
        return pa.table([table.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=empty) for x in cols)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    blocks = rows.mapInArrow(gathered, "block long, docs binary")
    answers = found.where("block is not null").select("block", "part", "all", "good")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
