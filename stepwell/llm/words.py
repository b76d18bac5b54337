"""Words of texts as arrays of 64-bit hashes, for the operators that work on them with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; words longer than this are taken whole.
_WINDOW = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What each byte counts: A-Z as a-z, white space nothing.
_WORTH = np.arange(1, 257, dtype=np.uint64)
_WORTH[0x41:0x5B] += np.uint64(32)
_WORTH[_SPACE] = 0


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS = _powers(256)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word of all texts, bounds): words bounds[i] to bounds[i + 1] are those of text i.

    A-Z are lower-cased and words split at ASCII white space, as bytes do it; null is empty. A hash is a polynomial of
    the word's bytes, mixed.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:last]
    out, at, lo = [], [], first
    while lo < last:
        hi = min(lo + _WINDOW, last)
        if hi < last:  # to the next place where no word can go on
            k = int(offsets[np.searchsorted(offsets, hi)])
            step = hi
            while step < k:
                some = np.flatnonzero(_SPACE[data[step : min(step + _WINDOW, k)]])
                if len(some):
                    k = step + int(some[0])
                step += _WINDOW
            hi = k
        x = data[lo:hi]
        space = _SPACE[x]
        new = ~space
        new[1:] &= space[:-1]
        cut = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        new[cut] = ~space[cut]
        start = np.flatnonzero(new)
        if len(start):
            x = x[start[0] :]
            rel = start - start[0]
            size = np.diff(np.append(rel, len(x)))
            place = np.arange(len(x)) - np.repeat(rel, size)
            most = int(size.max())
            powers = _POWERS if most <= len(_POWERS) else _powers(most)
            with np.errstate(over="ignore"):
                out.append(np.add.reduceat(_WORTH[x] * powers[place], rel))
            at.append(start + lo)
        lo = hi
    starts = np.concatenate([np.zeros(0, np.int64), *at])
    return mixed(np.concatenate([np.zeros(0, np.uint64), *out])), np.searchsorted(starts, offsets)


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word of a whole text."""
    return hashed(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary()).view(pa.string()))[0]


def parts(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about so many bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = len(h) - k + 1
    if n < 1:
        return h[:0]
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * np.uint64(_ODD) + h[i : i + n]
    return mixed(out)


def packed(x: np.ndarray) -> bytes:
    """An array's length and its bytes, all first bytes first, compressed: small numbers take little room."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[4:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
