"""Array kernels over UTF-8 text: word bounds, word and shingle hashes, rolling hashes.

Texts of a batch lie in one byte buffer with offsets, so that each step is a few array
operations and no step walks over characters in Python. Hashes have 64 bits and depend on
nothing but the bytes, so that they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one array step takes at once. A longer text is a step of its own.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: each input bit reaches each output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = U(0x9E3779B97F4A7C15 | 1)
BACK = U(pow(int(BASE), -1, 1 << 64))
WORD_BASE = U(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, STEP + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= STEP * 4:
            _powers[int(base)] = have
    return have[:n]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.cast(col, pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with up to `limit` bytes of text each (or one row), with buffer and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space), and for each text its first word's number."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cuts[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cuts[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = LOWER_CODE) -> np.ndarray:
    """A hash for each span of bytes; code gives each byte's value (so it can fold case)."""
    sums = np.zeros(len(data) + 1, U)
    if len(data):
        np.cumsum(code[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BACK, len(data) + 1)[starts] ^ (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def shingle_rows(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of `size` lower-cased words, in text order, repeats included.

    A text with fewer words has one shingle, its whole word sequence; one without words has none.
    """
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(first)
    n = len(hashes)
    whole = np.zeros(max(0, n - size + 1), U)
    for i in range(size):
        whole = whole * WORD_BASE + hashes[i : i + len(whole)]
    of = np.repeat(np.arange(len(counts)), counts)
    if n >= size:
        inside = of[: len(whole)] == of[size - 1 :]
        rows, out = of[: len(whole)][inside], mix(whole[inside])
    else:
        rows, out = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), U)
        for j, t in enumerate(short):
            h = U(counts[t])
            with np.errstate(over="ignore"):
                for x in hashes[first[t] : first[t + 1]]:
                    h = h * WORD_BASE + x
            extra[j] = h
        rows, out = np.concatenate([rows, short]), np.concatenate([out, mix(extra ^ U(0x5851F42D4C957F2D))])
    return rows, out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, by text and ascending, and offsets n + 1 into them."""
    rows, hashes = shingle_rows(data, offsets, size)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[keep], hashes[keep]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k bytes: entry i is of bytes i .. i + k - 1, by doubling the length."""
    if len(data) < k:
        return np.zeros(0, U)
    have, size, out, done = BYTE_CODE[data], 1, None, 0
    while True:
        if k & size:
            part = have[: len(have)]
            if out is None:
                out, done = part, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * U(pow(int(BASE), size, 1 << 64)) + part[done : done + n]
                done += size
        if done == k:
            return mix(out[: len(data) - k + 1])
        have = have[:-size] * U(pow(int(BASE), size, 1 << 64)) + have[size:]
        size *= 2


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that orders as they do; zeros follow the end."""
    padded = np.append(t, np.zeros(7, np.uint8))
    out = np.zeros(len(t), U)
    for k in range(8):
        out <<= U(8)
        out |= padded[k : k + len(t)]
    return out


#: Which bits of such a number its first 0 .. 8 bytes have.
FIRST = np.array([0, *((1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9))], U)


def strings(values: list[bytes]) -> pa.Array:
    """Bytes as a string column; bytes that are no whole UTF-8 get the replacement character."""
    return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
