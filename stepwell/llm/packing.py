"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, equal lengths share a
bucket, and each piece is a sequence of its own, so that none crosses documents and none needs padding."""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import ship

#: The id that ends each document, and the longest sequence.
END_ID = 1
MAX_TOKENS = 2048


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def _slow(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.lru_cache(2)
def _encoder(path: str):
    """Text to ids. The same vocabulary as ranks, where it lies beside the file, gives the same ids about five times as
    fast; a text that it refuses goes through the tokenizer of the file itself."""
    import os

    ranks_file = path.removesuffix(".json") + ".tiktoken"

    def slow(text: str) -> list[int]:
        return _slow(path).encode(text, add_special_tokens=False).ids

    if not os.path.exists(ranks_file):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the pattern's engine gives up on some very long runs with an exception of its own kind
            return slow(text)

    return encode


def cuts(tokens: int, longest: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole `longest` ones, then the binary digits of the rest, large to small."""
    out = [(at, longest) for at in range(0, tokens - longest + 1, longest)]
    at, bit = len(out) * longest, longest
    while at < tokens:
        bit >>= 1
        if tokens - at >= bit:
            out.append((at, bit))
            at += bit
    return out


def pack(docs: DataFrame, longest: int = MAX_TOKENS, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (the length's
    power of two) and, if asked for, the ids themselves.

    Null or empty text is the end id alone. A special token's string in a text is ordinary text. Each row is a
    document, also where doc_ids repeat or are null. An empty table gives no rows. Other columns are ignored.
    sequence_id is the piece's place among the partitions of the scan: unique, and the same for the same files.
    """
    ship(docs.sparkSession)
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            of, rows, ids_out = [], array("q"), []
            for k, text in enumerate(b.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                raw, n = memoryview(array("I", ids).tobytes()), len(ids)
                for start, length in cuts(n, longest):
                    of.append(k)
                    rows.extend((start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
                    if with_ids:
                        ids_out.append(ids[start : start + length])
            m = np.frombuffer(rows, np.int64).reshape(-1, 4) if of else np.zeros((0, 4), np.int64)
            cols = [b.column(0).take(pa.array(of, pa.int64())), *(pa.array(np.ascontiguousarray(m[:, j])) for j in range(4))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(docs: DataFrame, path: str, **options) -> None:
    """Write the sequences with their ids, one folder for each length."""
    pack(docs, with_ids=True, **options).write.partitionBy("bucket").parquet(path)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
