"""Operator 6: exact removal of repeated 100-byte strings, by two-stage suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or
same document and earlier start). One suffix array over all documents fits no machine, so equal
strings are first brought together, and then sorted:

1. Each string of LENGTH bytes has an anchor, the least-hashed GRAM-byte gram in it (leftmost on
   ties). Equal strings have equal anchors at equal places, so that they can meet by the
   anchor's hash alone. Neighbouring strings mostly share their anchor; such a run is a segment
   of up to 2 LENGTH bytes, one row.
2. Anchors that occur once are dropped. Where all segments of an anchor are equal, all but the
   earliest go whole. Both are counts and minima with map-side combine.
3. Segments of the remaining anchors, which differ at the ends of repeated passages, are sorted
   in buckets of bounded size: of all suffixes, only those smaller than their successor are
   sorted directly; the others are induced from them by a scan over the first-byte buckets. Then
   neighbours' common prefixes show which strings are equal, and the earliest stays.
4. An anchor with more than CAP different segments is no one task's work. Its strings are told
   apart by more bytes beside the anchor: a string holds half of its other bytes to the left of
   it or to the right, and those name a longer anchor, on which equal strings still meet. This
   is repeated until no anchor is large; after seven rounds an anchor is a whole string, of
   which there is one. Then step 3 sorts them like all others.

Bit filters of bounded size spare the second pass most rows; results do not depend on them.

Defined results: null and empty texts have no bytes. Rows with null or repeated doc_id stand in
(doc_id, text) order, as documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

LENGTH, GRAM = 100, 32
PIECE = 1 << 19
INDEX_BITS = 26
BUCKET_BYTES = 1 << 19
CAP = 1500
U = np.uint64


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start in the buffer, end, place of the anchor, anchor) of each run of strings with one anchor."""
    rows, starts, ends, places, anchors = [], [], [], [], []
    width = length - gram + 1
    n = len(data) - length + 1
    for a in range(0, max(0, n), PIECE):
        b = min(n, a + PIECE)
        hashes = text.rolling(data[a : b + length - 1], gram)
        # the hash's upper bits, then the place: a minimum is the leftmost of the least
        key = hashes >> U(INDEX_BITS) << U(INDEX_BITS) | np.arange(len(hashes), dtype=U)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if width > size:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        at = (key & U((1 << INDEX_BITS) - 1)).astype(np.int64)
        place = np.arange(a, b)
        row = np.searchsorted(offsets, place, "right") - 1
        ok = np.flatnonzero(place + length <= offsets[row + 1])
        if not len(ok):
            continue
        at, row, place = at[ok], row[ok], place[ok]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        rows.append(row[first])
        starts.append(place[first])
        ends.append(place[last] + length)
        places.append(at[first] + a)
        anchors.append(text.mix(hashes[at[first]]))  # least hashes are all small; mixed they fill a filter evenly
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U)
    return tuple(np.concatenate(x) for x in (rows, starts, ends, places, anchors))


def ordered(words: np.ndarray, at: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by up to `depth` bytes, but no more than `room`: eight bytes a round, ties only."""
    room = np.minimum(room, depth)
    order, slot, run = np.arange(len(at)), np.arange(len(at)), np.zeros(len(at), np.int64)
    for k in range(0, depth, 8):
        own = order[slot]
        key = words[np.minimum(at[own] + k, len(words) - 1)] & text.FIRST[np.clip(room[own] - k, 0, 8)]
        by = np.lexsort((key, run)) if k else np.argsort(key, kind="stable")
        key = key[by]
        order[slot] = own[by]
        new = np.ones(len(slot), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(new)
        tied = np.bincount(run)[run] > 1
        slot, run = slot[tied], run[tied]
        if not len(slot):
            break
    return at[order]


def two_stage(t: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of t (bytes, parts ended by 0), right for the first `depth` bytes within a part.

    Suffixes smaller than their successor are sorted directly; a scan over the first-byte buckets
    then puts each larger one into its own bucket, in the order of its successor. Where suffix and
    successor share a bucket, the scan goes in waves: a wave's predecessors follow it.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16)))
    step = np.append(step, 1)  # the last separator counts as smaller
    known = np.flatnonzero(step)
    larger = step[known[np.searchsorted(known, np.arange(n))]] < 0
    direct = np.flatnonzero(~larger)
    stop = np.flatnonzero(t == 0)
    direct = ordered(words, direct, stop[np.searchsorted(stop, direct)] - direct, depth)
    ends = np.cumsum(np.bincount(t[direct], minlength=256))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)).tolist():
        wave = np.concatenate(induced[c]) if induced[c] else direct[:0]
        whole = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[larger[wave] & (t[wave] == c)]
            whole.append(wave)
        whole.append(direct[ends[c - 1] if c else 0 : ends[c]])
        induced[c] = [np.concatenate(whole)]
        out.append(induced[c][0])
        before = out[-1][out[-1] > 0] - 1
        before = before[larger[before] & (t[before] > c)]
        before = before[np.argsort(t[before], kind="stable")]
        to, first = np.unique(t[before], return_index=True)
        for x, own in zip(to.tolist(), np.split(before, first[1:])):
            induced[x].append(own)
    return np.concatenate(out)


def repeats(data: np.ndarray, offsets: np.ndarray, rk: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of each string of `length` bytes in the parts that stands earlier in another place."""
    sizes = np.diff(offsets)
    # a zero byte would be a separator; 0xFF is no byte of UTF-8
    t = np.insert(np.where(data == 0, np.uint8(255), data), offsets[1:], np.uint8(0))
    first = offsets[:-1] + np.arange(len(sizes))
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    words = text.words_at(t)
    sa = two_stage(t, words, length)
    sa = sa[sa - first[of[sa]] + length <= sizes[of[sa]]]
    if len(sa) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # common prefixes of neighbours, up to `length`, eight bytes at a time
    same = np.arange(len(sa) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        same = same[words[sa[same] + k] == words[sa[same + 1] + k]]
    equal = np.zeros(len(sa), bool)
    equal[same + 1] = True
    # places alone in their group are done
    grouped = equal.copy()
    grouped[:-1] |= equal[1:]
    group, sa = np.cumsum(~equal)[grouped], sa[grouped]
    doc, place = rk[of[sa]], start[of[sa]] + sa - first[of[sa]]
    order = np.lexsort((place, doc, group))
    later = np.zeros(len(sa), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    return doc[order][later], place[order][later]


def halved(body: bytes, lo: int, hi: int, length: int) -> list[tuple[int, int, int, int]]:
    """The strings of `length` bytes of a segment, all of which hold body[lo:hi], in two parts:
    (start, end, lo, hi) of those that hold half of the other bytes to the left, and of the rest,
    which hold half of them to the right. Parts are empty where no string is of their kind."""
    free = length - (hi - lo)
    half = (free + 1) // 2
    # a string starts `left` bytes before lo, 0 <= left <= free
    most, least = min(free, lo), max(0, lo + length - len(body))
    out = []
    if free and most >= max(least, half):
        low = max(least, half)
        out.append((lo - most, lo - low + length, lo - half, hi))
    if free and min(most, half - 1) >= least:
        high = min(most, half - 1)
        out.append((lo - high, lo - least + length, lo, hi + free - half + 1))
    return out


def spans_of(doc: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """(rk, a, b) of runs of neighbouring strings."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(place[first]), pa.array(place[last] + length if len(doc) else place)], ["rk", "a", "b"])


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """(rk, a, b): spans of bytes to remove, which may overlap."""
    keyed = keyed.select("rk", "text")

    def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], U).view(np.int64)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text.steps(batches, "text"):
            row, a, b, _, anchor = segments(data, offsets, length, gram)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digests(data.tobytes(), a, b)), pa.array(part.column("rk").to_numpy()[row])], ["anchor", "seg", "rk"])

    shared = (
        keyed.mapInArrow(first_pass, "anchor long, seg long, rk long")
        .groupBy("anchor")
        .agg(F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.min("rk").alias("low"), F.count("*").alias("n"))
        .where("n > 1")
        .select("anchor", (F.col("s0") != F.col("s1")).alias("mixed"), "low")
    )
    shared = frames.cut(shared, "anchors")
    n = {r.mixed: r.n for r in shared.groupBy("mixed").agg(F.count("*").alias("n")).collect()}
    bits, some = frames.bit_filter(shared.select("anchor"), sum(n.values()))
    mixed_bits, mixed = frames.bit_filter(shared.where("mixed").select("anchor"), n.get(True, 0))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text.steps(batches, "text"):
            row, a, b, at, anchor = segments(data, offsets, length, gram)
            keep = np.flatnonzero(frames.in_filter(anchor, bits, some.value))
            if not len(keep):
                continue
            row, a, b, at, anchor = row[keep], a[keep], b[keep], at[keep], anchor[keep]
            raw = data.tobytes()
            many = frames.in_filter(anchor, mixed_bits, mixed.value).tolist()
            bodies = [raw[x:y] if m else None for m, x, y in zip(many, a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part.column("rk").to_numpy()[row]), pa.array(a - offsets[row]), pa.array(b - offsets[row]), pa.array((at - a).astype(np.int32)), pa.array(bodies, pa.binary())], ["anchor", "rk", "a", "b", "lo", "body"])

    held = frames.cut(keyed.mapInArrow(second_pass, "anchor long, rk long, a long, b long, lo int, body binary").join(shared, "anchor"), "segments")
    # all segments of the anchor are equal: in its lowest document the first stays, elsewhere none
    equal = held.where("not mixed")
    inner = equal.where("rk = low").groupBy("anchor", "rk").agg(F.min("a").alias("stay"), F.count("*").alias("k")).where("k > 1").select("anchor", "rk", "stay")
    spans = equal.where("rk <> low").select("rk", "a", "b").union(equal.join(inner, ["anchor", "rk"]).where("a <> stay").select("rk", "a", "b"))

    def sort(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(parts))
        doc, place = repeats(*text.flat(got.column("body")), got.column("rk").to_numpy(), got.column("a").to_numpy(), length)
        if len(doc):
            yield spans_of(doc, place, length)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for anchor, rk, a, lo, hi, body in zip(*(part.column(c).to_pylist() for c in ("anchor", "rk", "a", "lo", "hi", "body"))):
                for side, (x, y, low, high) in enumerate(halved(body, lo, hi, length)):
                    name = xxhash.xxh3_64_intdigest(body[low:high], anchor + side & 0xFFFFFFFFFFFFFFFF)
                    out.append((name - (1 << 63), rk, a + x, a + y, low - x, high - x, body[x:y]))
            names = ["anchor", "rk", "a", "b", "lo", "hi", "body"]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    rows, sized, total = held.where("mixed").withColumn("hi", F.col("lo") + gram), [], 0
    while True:
        rows = rows.withColumn("seg", F.xxhash64("body", F.lit(3)))
        firsts = frames.cut(
            rows.groupBy("anchor", "seg", F.md5("body").alias("md5")).agg(F.min(F.struct("rk", "a", "b")).alias("first"), F.count("*").alias("k"), F.first("body").alias("body"), F.first("lo").alias("lo"), F.first("hi").alias("hi")), "firsts"
        )
        copies = firsts.where("k > 1").select("anchor", "seg", "first")
        spans = spans.union(rows.join(copies, ["anchor", "seg"]).where("rk <> first.rk or a <> first.a").select("rk", "a", "b"))
        counts = firsts.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.length("body") + 1).alias("size")).where("k > 1")
        counts = frames.cut(counts.select("anchor", "size", (F.col("k") > cap).alias("large")), "counts")
        got = {r.large: r for r in counts.groupBy("large").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
        total += got[False]["size"] if False in got else 0
        known = firsts.drop("k").join(counts.select("anchor", "large"), "anchor")
        sized.append(known.where("not large").select("anchor", "first.rk", "first.a", "body"))
        if True not in got:
            break
        rows = frames.cut(known.where("large").select("anchor", "first.rk", "first.a", "lo", "hi", "body").mapInArrow(split, "anchor long, rk long, a long, b long, lo int, hi int, body binary"), "halves")

    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    sized = reduce(DataFrame.union, sized).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return spans.union(sized.groupBy("bucket").applyInArrow(sort, "rk long, a long, b long"))


def remove_repeats(docs: DataFrame, *extra: str, length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, extra...): kept is the bytes that are left."""
    keyed = frames.keyed(docs, *extra)
    spans = repeated_spans(keyed, length, gram, cap).groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rest = ["extra"] if extra else []
    schema = ", ".join(["doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept binary", *(f"extra {keyed.schema[c].dataType.simpleString()}" for c in rest)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text.steps(batches, "text"):
            raw, spans = data.tobytes(), part.column("spans")
            kept, removed, count = [], [], []
            for i in range(part.num_rows):
                own, got = raw[offsets[i] : offsets[i + 1]], spans[i].values
                if got is None or not len(got):
                    kept.append(own)
                    removed.append(0)
                    count.append(0)
                    continue
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, got.field("a").to_numpy(), 1)
                np.add.at(edge, got.field("b").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(own, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                count.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), *(part.column(c) for c in rest)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *rest],
            )

    out = keyed.join(spans, "rk", "left").select("doc_id", "text", "spans", *rest).mapInArrow(apply, schema)
    return frames.unpacked(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], extra)


def op6(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(frames.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The definition itself, for tests: rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: set[bytes] = set()
    out = []
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
