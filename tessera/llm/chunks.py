"""Operator 2: substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are zero, between
LEAST and MOST bytes; a tail of fewer than LEAST bytes belongs to the last chunk. The end depends
on the last 16 bytes only, so that an insertion moves no chunk ends but those near it. A chunk is
a repeat if a chunk with the same 128-bit digest stands earlier (smaller doc_id, or same document
and earlier start). Runs of repeats of at least min_run bytes are cut out, and those that are a
whole text; shorter ones stay: lines and phrases that many texts share are no copied passages.

The first pass shuffles one combined row for each digest and task, the second one row for each
chunk; the rows of a digest that stands in a large share of all documents are dealt over many
tasks.

Defined results: a null text stays null and an empty one empty, with nothing removed. Rows with
a null or repeated doc_id count in (doc_id, text) order. Bytes that a cut through a character
would leave over are kept out of the cut: cuts are narrowed to whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

LEAST, MOST, BITS = 24, 256, 4
MIN_RUN = 80
GEAR = (text.BYTE_CODE >> np.uint64(40)).astype(np.uint16)
#: The top bits of the 16-bit gear hash, which the last 16 bytes decide.
TOP = np.uint16(((1 << BITS) - 1) << (16 - BITS))


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: sum over the last 16 bytes of GEAR[byte] << age, by doubling."""
    h = GEAR[data]
    for age in (1, 2, 4, 8):
        h[age:] = h[age:] + (h[:-age] << np.uint16(age)) if len(h) > age else h[age:]
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each text, as places in the buffer; a text's last is its end."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends: list[int] = []
        if b > a:
            last = a
            for p in (np.flatnonzero((gear(data[a:b]) & TOP) == 0) + (a + 1)).tolist():
                if p - last < LEAST:
                    continue
                while p - last > MOST:
                    last += MOST
                    ends.append(last)
                if p - last >= LEAST:
                    ends.append(p)
                    last = p
            while b - last > MOST:
                last += MOST
                ends.append(last)
            if last < b:
                ends[-1 if ends and b - last < LEAST else len(ends) :] = [b]
        out.append(ends)
    return out


def chunk_rows(keyed: DataFrame) -> DataFrame:
    """(h1, h2, rk, place): a digest, its document and start << 16 | length for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text.steps(batches, "text"):
            raw, digest, starts, sizes, of = data.tobytes(), [], [], [], []
            for i, ends in enumerate(chunk_ends(data, offsets)):
                a = base = int(offsets[i])
                for b in ends:
                    digest.append(xxhash.xxh3_128_digest(raw[a:b]))
                    starts.append(a - base)
                    sizes.append(b - a)
                    a = b
                of.append(len(ends))
            if digest:
                h = np.frombuffer(b"".join(digest), np.int64)
                place = np.array(starts, np.int64) << 16 | np.array(sizes, np.int64)
                rk = np.repeat(part.column("rk").to_numpy(), of)
                yield pa.RecordBatch.from_arrays([pa.array(h[::2]), pa.array(h[1::2]), pa.array(rk), pa.array(place)], ["h1", "h2", "rk", "place"])

    return keyed.select("rk", "text").mapInArrow(run, "h1 long, h2 long, rk long, place long")


def runs(places: np.ndarray, own: np.ndarray, digests: list, size: int, min_run: int) -> list[tuple[int, int]]:
    """The spans to cut of one document, of its chunks whose digest also occurs elsewhere or twice here."""
    order = np.argsort(places, kind="stable")
    seen: set = set()
    out: list[tuple[int, int]] = []
    for i in order.tolist():
        a, n = int(places[i]) >> 16, int(places[i]) & 0xFFFF
        if own[i] and digests[i] not in seen:
            seen.add(digests[i])
            continue
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], a + n)
        else:
            out.append((a, a + n))
    return [(a, b) for a, b in out if b - a >= min(min_run, size)]


def whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the halves of characters at its ends."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def dedup_chunks(docs: DataFrame, *extra: str, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, extra...): text is what is left."""
    keyed = frames.keyed(docs, *extra)
    rows = chunk_rows(keyed)
    twice = rows.groupBy("h1", "h2").agg(F.min("rk").alias("low"), F.count("*").alias("n")).where("n > 1")
    hits = frames.spread_join(rows, frames.cut(twice, "twice"), ["h1", "h2"], ["rk", "place"])
    spans = hits.groupBy("rk").agg(F.collect_list(F.struct("place", (F.col("low") == F.col("rk")).alias("own"), "h1", "h2")).alias("hits"))
    joined = keyed.join(spans, "rk", "left")
    rest = ["extra"] if extra else []
    schema = ", ".join(["doc_id long", "text string", "n_bytes long", "n_removed long", "n_spans long", *(f"extra {keyed.schema[c].dataType.simpleString()}" for c in rest)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text.steps(batches, "text"):
            raw, hits = data.tobytes(), part.column("hits")
            kept, removed, count = [], [], []
            for i in range(part.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                got = hits[i].values
                cuts = []
                if got is not None and len(got):
                    h1, h2 = got.field("h1").to_numpy(), got.field("h2").to_numpy()
                    spans = runs(got.field("place").to_numpy(), got.field("own").to_numpy(zero_copy_only=False), list(zip(h1.tolist(), h2.tolist())), len(own), min_run)
                    cuts = [x for x in (whole_characters(own, a, b) for a, b in spans) if x[0] < x[1]]
                at, left = 0, []
                for a, b in cuts:
                    left.append(own[at:a])
                    at = b
                left.append(own[at:])
                kept.append(b"".join(left))
                removed.append(sum(b - a for a, b in cuts))
                count.append(len(cuts))
            null = part.column("text").is_null().to_numpy(zero_copy_only=False)
            texts = pa.array([None if z else k.decode("utf-8", "replace") for z, k in zip(null, kept)], pa.string())
            columns = [part.column("doc_id"), texts, pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), *(part.column(c) for c in rest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_bytes", "n_removed", "n_spans", *rest])

    out = joined.select("doc_id", "text", "hits", *rest).mapInArrow(apply, schema)
    return frames.unpacked(out, ["doc_id", "text", "n_bytes", "n_removed", "n_spans"], extra)


def op2(spark, sf_dir: str) -> DataFrame:
    return dedup_chunks(frames.table(spark, sf_dir, "documents"))
