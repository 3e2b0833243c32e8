"""Operator 1: token ids in raw shard files, with a minimal perfect hash index.

Documents are range-partitioned by key; each partition encodes its texts in order and writes
one shard file of raw little-endian ids (16 bits where the vocabulary allows, else 32). The
index is dealt by key hash: each index file holds a minimal perfect hash of its keys (levels of
bit arrays with rank counts), and for each slot a stored 32-bit fingerprint, the shard, the
offset and the number of ids. A lookup costs a few bit probes and one slot, whatever the number
of keys, and an unknown key is refused by its fingerprint. Files get their name by a rename
once they are whole, so that a task that is run again replaces its own file.

Key: (doc_id, number of the row among those with that doc_id). A null doc_id sorts first and
keeps its rows. Null and empty texts have the end id alone. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, text

MAGIC = b"TSRIDS01"
INDEX_MAGIC = b"TSRMPH01"
#: Keys of one index file, about.
INDEX_KEYS = 500_000
#: Ids and spans that a worker remembers, at most; beyond them it begins anew.
MEMORY, SPANS = 1 << 24, 1_000_000
#: Marks that end words. A letter followed by such a run is always a split of the tokenizer's.
ENDS = ",.!?;:%#&*$|)"
SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u4")])
_encoders: dict = {}


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder URI; file:/x and plain paths are the shared mount."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_whole(folder: str, name: str, parts: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then rename: readers see no half file."""
    fs, path = place(folder)
    fs.create_dir(path, recursive=True)
    context = TaskContext.get()
    own = f"{path}/.{name}.{context.taskAttemptId() if context else os.getpid()}"
    with fs.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
    fs.move(own, f"{path}/{name}")


IS_END = np.zeros(256, bool)
IS_END[list(ENDS.encode())] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z and the capitals of Latin-1 in lower case, as the tokenizer makes them, and
    which bytes belong to letters from a to z or of Latin-1."""
    low, letter = text.LOWER[data], IS_LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        capital = lead[data[lead + 1] < 0x9F] + 1
        low[capital] += 0x20
    return low, letter


def spans(data: np.ndarray, letter: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, only letters, first span of each text): words between white space, over which the
    tokenizer's splits never reach; the marks after a word of letters are a span of their own."""
    starts, ends, first = text.words(data, offsets)
    others = np.concatenate([[0], np.cumsum(~letter)])
    core = ends.copy()
    left = np.flatnonzero(IS_END[data[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
    while len(left):
        core[left] -= 1
        left = left[core[left] > starts[left]]
        left = left[IS_END[data[core[left] - 1]]]
    plain = (others[core] == others[starts]) & (core > starts)
    two = np.flatnonzero(plain & (core < ends))
    core[~plain] = ends[~plain]
    first = first + np.searchsorted(two, first)
    starts, ends = np.insert(starts, two + 1, core[two]), np.insert(core, two + 1, ends[two])
    return starts, ends, np.insert(plain, two + 1, False), first


class Memory:
    """An open-addressing table from 64-bit keys and 64-bit checks to a span of ids, in arrays."""

    BITS = 21

    def __init__(self, kind: np.dtype):
        size = 1 << self.BITS
        self.key, self.check, self.used = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, bool)
        self.at, self.n = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.ids, self.size, self.count = np.zeros(1 << 20, kind), 0, 0

    def slots(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        out, left = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(left):
            own = at[left]
            hit = self.used[own] & (self.key[own] == key[left]) & (self.check[own] == check[left])
            out[left[hit]] = own[hit]
            left = left[self.used[own] & ~hit]
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[np.ndarray]) -> None:
        """Store distinct new keys."""
        n = np.array([len(x) for x in ids], np.int64)
        whole = int(n.sum())
        if self.size + whole > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.size], np.zeros(self.size + whole, self.ids.dtype)])
        if whole:
            self.ids[self.size : self.size + whole] = np.concatenate(ids)
        start = self.size + np.cumsum(n) - n
        at, left = (key >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(key))
        while len(left):
            free = left[~self.used[at[left]]]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            slot = at[put]
            self.used[slot], self.key[slot], self.check[slot], self.at[slot], self.n[slot] = True, key[put], check[put], start[put], n[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
        self.size += whole
        self.count += len(key)


class Encoder:
    """Ids of whole texts. A text's ids are those of its spans in turn. Distinct spans are encoded by
    the library once and remembered by a 64-bit hash of their bytes and their first eight bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # letters only never have the id of a digit, which can stand between them
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.zero = zero[0] if len(zero) == 1 else None
        self.known = Memory(self.kind)

    def each(self, spans: list[str]) -> list[np.ndarray]:
        got = []
        for a in range(0, len(spans), 4096):
            got += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(spans[a : a + 4096], add_special_tokens=False)]
        return got

    def letters(self, spans: list[str]) -> list[np.ndarray]:
        """Ids of spans of letters only, 64 of them to a call."""
        if self.zero is None:
            return self.each(spans)
        lines = [" 0 ".join(spans[a : a + 64]) + " 0" for a in range(0, len(spans), 64)]
        flat = np.concatenate(self.each(lines)) if lines else np.zeros(0, self.kind)
        stops = np.flatnonzero(flat == self.zero)
        if len(stops) != len(spans):
            return self.each(spans)
        return [flat[a:b] for a, b in zip(np.append(0, stops[:-1] + 1).tolist(), stops.tolist())]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)."""
        low, letter = lowered(data)
        starts, ends, plain, first = spans(data, letter, offsets)
        key = text.span_hashes(low, starts, ends, text.BYTE_CODE)
        check = text.words_at(low)[starts] & text.FIRST[np.minimum(ends - starts, 8)] if len(low) else key
        slot = self.known.slots(key, check)
        if (slot < 0).any():
            if self.known.count > SPANS or self.known.size > MEMORY:
                self.known = Memory(self.kind)
                slot[:] = -1
            new = np.flatnonzero(slot < 0)
            order = new[np.lexsort((check[new], key[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            new = order[other]
            raw, lowest = data.tobytes(), low.tobytes()
            for own, source, encode in ((new[plain[new]], lowest, self.letters), (new[~plain[new]], raw, self.each)):
                self.known.add(key[own], check[own], encode([source[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist())]))
            slot = self.known.slots(key, check)
        at, n = self.known.at[slot], self.known.n[slot].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(n)])
        sizes = sums[first[1:]] - sums[first[:-1]]
        total = int(n.sum())
        ids = self.known.ids[np.repeat(at - sums[:-1], n) + np.arange(total)]
        if end is not None:
            ids = np.insert(ids, np.cumsum(sizes), self.kind.type(end))
            sizes = sizes + 1
        return ids, sizes


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_hash(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    x = text.mix(ids.astype(np.int64).view(np.uint64) ^ np.where(null, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0)))
    return text.mix(x + text.mix(nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each level's bit array keeps the keys that
    are alone in their place, the others go on to the next; a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.bits = [np.unpackbits(x, bitorder="little") for x in levels]
        base, self.ranks = 0, []
        for b in self.bits:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(b, dtype=np.int64)]))
            base = int(self.ranks[-1][-1])
        self.base = base

    @staticmethod
    def at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (text.mix(keys + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < 40:
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = cls.at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, b in enumerate(self.bits):
            if not len(left):
                break
            at = self.at(keys[left], i, len(b))
            hit = b[at] == 1
            out[left[hit]] = self.ranks[i][at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.base + at[hit]
        return out


def index_bytes(keys: np.ndarray, shard: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    table = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = table.slots(keys)
    for field, x in (("mark", keys >> np.uint64(32)), ("shard", shard), ("start", start), ("n", n)):
        slots[field][at] = x
    yield INDEX_MAGIC + np.array([len(table.levels), len(table.rest), len(keys), *(len(x) for x in table.levels)], "<i8").tobytes()
    yield from (x.tobytes() for x in table.levels)
    yield table.rest.tobytes()
    yield slots.tobytes()


class IndexFile:
    """One index file, open for lookups."""

    def __init__(self, folder: str, bucket: int):
        fs, path = place(folder)
        with fs.open_input_file(f"{path}/index-{bucket:06d}") as f:
            raw = f.read()
        if raw[:8] != INDEX_MAGIC:
            raise ValueError(f"index-{bucket:06d} is no index file")
        n, rest, keys = np.frombuffer(raw, "<i8", 3, 8)
        sizes = np.frombuffer(raw, "<i8", n, 32)
        at, levels = 32 + 8 * int(n), []
        for s in sizes:
            levels.append(np.frombuffer(raw, np.uint8, s, at))
            at += int(s)
        self.table = PerfectHash(levels, np.frombuffer(raw, "<u8", rest, at))
        self.slots = np.frombuffer(raw, SLOT, keys, at + 8 * int(rest))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, slots): which keys the index holds, and the slot records of all (of unknown ones, any)."""
        at = self.table.slots(keys)
        got = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        return (at >= 0) & (got["mark"] == (keys >> np.uint64(32)).astype(np.uint32)), got


def write_tokens(docs: DataFrame, tokenizer: str, end: int | None, folder: str) -> DataFrame:
    """Write shards and index files below folder; (doc_id, nth, bucket) of each row.

    There are as many shards as docs has partitions, which follows its size. A doc_id of many rows
    is dealt over shards by the beginning of its texts.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    ordered = own.repartitionByRange(max(1, own.rdd.getNumPartitions()), order[0], F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        fs, path = place(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/.ids-{shard:06d}.{TaskContext.get().taskAttemptId()}"
        at, last, nth = 0, "none", 0
        with fs.open_output_stream(name) as out:
            out.write(MAGIC + np.array([encode.kind.itemsize], "<i8").tobytes())
            for part, data, offsets in text.steps(batches, "text"):
                ids, n = encode.encode(data, offsets, end)
                number = []
                for d in part.column("doc_id").to_pylist():
                    nth = nth + 1 if d == last else 0
                    last = d
                    number.append(nth)
                out.write(ids.tobytes())
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(number, pa.int64()), pa.array(np.full(len(n), shard, np.int64)), pa.array(starts), pa.array(n)], ["doc_id", "nth", "shard", "start", "n"])
        fs.move(name, f"{path}/ids-{shard:06d}")

    records = numbered(frames.cut(ordered.mapInArrow(run, "doc_id long, nth long, shard long, start long, n long"), "records"))
    rows = records.count()
    buckets = max(1, -(-rows // INDEX_KEYS))
    dealt = records.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(buckets)))

    def build(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(parts))
        write_whole(folder, f"index-{key[0].as_py():06d}", index_bytes(hashes_of(got), *(got.column(c).to_numpy() for c in ("shard", "start", "n"))))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([got.num_rows])], ["bucket", "n"])

    frames.cut(dealt.groupBy("bucket").applyInArrow(build, "bucket long, n long"), "index")
    return dealt.select("doc_id", "nth", "bucket")


def numbered(records: DataFrame) -> DataFrame:
    """records with nth counted over shards: a doc_id that ends one shard and begins the next goes on."""
    each = records.groupBy("shard").agg(F.min_by(F.struct("doc_id"), "start").alias("low"), F.max_by(F.struct("doc_id"), "start").alias("high"))
    by = Window.orderBy("shard")  # a row for each shard file
    split = each.select("low", F.lag("high").over(by).alias("before")).where("before is not null and low.doc_id <=> before.doc_id").select("low.doc_id").distinct()
    some = records.join(F.broadcast(split), records.doc_id.eqNullSafe(split.doc_id), "left_semi")  # fewer ids than shards
    rows = some.groupBy("doc_id", "shard").agg(F.count("*").alias("k"))
    more = rows.select("doc_id", "shard", (F.sum("k").over(Window.partitionBy("doc_id").orderBy("shard")) - F.col("k")).alias("more")).where("more > 0")
    more = more.select(F.col("doc_id").alias("other"), F.col("shard").alias("own"), "more")
    joined = records.join(F.broadcast(more), records.doc_id.eqNullSafe(more.other) & (F.col("shard") == F.col("own")), "left")
    return joined.select("doc_id", (F.col("nth") + F.coalesce("more", F.lit(0))).alias("nth"), "shard", "start", "n")


def hashes_of(got: pa.Table | pa.RecordBatch) -> np.ndarray:
    ids = got.column("doc_id")
    null = ids.is_null().to_numpy() if isinstance(ids, pa.ChunkedArray) else ids.is_null().to_numpy(zero_copy_only=False)
    return key_hash(np.asarray(ids.fill_null(0)), null, np.asarray(got.column("nth")))


def read_tokens(keys: DataFrame, folder: str) -> DataFrame:
    """Look keys (doc_id, nth, bucket) up in the index and read their ids: one row each with shard,
    start in the shard, n_tokens and the ids as little-endian unsigned 32-bit integers' crc32.
    Unknown keys give no row."""

    def find(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = IndexFile(folder, key[0].as_py())
        for part in parts:
            known, got = index.find(hashes_of(part))
            at = pa.array(np.flatnonzero(known))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("nth").take(at), *(pa.array(got[c][known].astype(np.int64)) for c in ("shard", "start", "n"))], ["doc_id", "nth", "shard", "start", "n_tokens"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        held, f, width = -1, None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                crc = []
                for shard, start, n in zip(*(part.column(c).to_pylist() for c in ("shard", "start", "n_tokens"))):
                    if shard != held:
                        if f is not None:
                            f.close()
                        held, f = shard, fs.open_input_file(f"{path}/ids-{shard:06d}")
                        head = f.read(16)
                        if head[:8] != MAGIC:
                            raise ValueError("no shard file")
                        width = int(np.frombuffer(head, "<i8", 1, 8)[0])
                    f.seek(16 + start * width)
                    crc.append(zlib.crc32(np.frombuffer(f.read(n * width), f"<u{width}").astype("<u4")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(crc, pa.int64())], [*part.schema.names, "ids_crc32"])
        if f is not None:
            f.close()

    found = keys.select("doc_id", "nth", "bucket").groupBy("bucket").applyInArrow(find, "doc_id long, nth long, shard long, start long, n_tokens long")
    # each shard is read once, from its beginning to its end
    ordered = found.repartition("shard").sortWithinPartitions("shard", "start")
    return ordered.mapInArrow(read, "doc_id long, nth long, shard long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int | None, folder: str | None = None) -> DataFrame:
    """Write, read back and return (doc_id, start, n_tokens, ids_crc32, shard) for each row of docs."""
    folder = folder or f"{frames.scratch_root(docs.sparkSession)}/tokens"
    rows = frames.cut(read_tokens(write_tokens(docs, tokenizer, end, folder), folder), "read")
    total = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard file
    base = total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
