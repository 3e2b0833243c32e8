"""Operator 3: SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding starts from characters and merges the adjacent pair whose piece scores best, leftmost
first, until no pair is left (the agenda). A candidate merge is skipped where a keyed hash of
(seed, doc_id, place of the pair in the text, its two pieces) is below the dropout rate; the
same document therefore gets the same segmentation in every run, and other seeds give others.
Rate 0 gives the library's own segmentation. Characters without a piece become byte pieces.

All words of a batch go through the agenda together: each round takes every word's best pair,
merges, and looks up the two pairs that arise. A word of more than LONG characters goes through
a heap instead, with the same decisions, so that a text without spaces takes no quadratic time.

Decoding joins the pieces' bytes and drops the leading space that encoding adds. It gives back
every text: the mark U+2581 in a text is written as bytes, since its piece stands for a space.
Null and empty texts have no pieces. Rows that repeat a doc_id are encoded alike. A null doc_id
has a key of its own. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

LONG = 80
SEED, RATE = 20240601, 0.1
SLOTS = 19
NEVER = np.int64(1 << 62)
_models: dict = {}


class Model:
    """Pieces, and the table of pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.char[32] = self.char[0x2581]
        self.char[0x2581] = -1
        pairs = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("a piece has a space after other characters")
        a, b, self_id = np.array(pairs, np.int64).T
        self.keys, self.vals = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, -1, np.int32)
        key = a << 20 | b
        at, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.vals[at[put]] = key[put], self_id[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)
        self.n = n
        raw = [bytes([j]) for j in range(256)]
        of_byte = {int(i): raw[j] for j, i in enumerate(self.byte_ids)}
        out = [of_byte[i] if i in of_byte else sp.id_to_piece(i).replace("▁", " ").encode() if sp.id_to_piece(i) in normal else b"" for i in range(n)]
        self.sizes = np.array([len(x) for x in out], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(out), np.uint8)

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = a.astype(np.int64) << 20 | b
        at = self.slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.vals[at], -1)
        left = np.flatnonzero((got != key) & (got >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)
            got = self.keys[at[left]]
            hit = got == key[left]
            out[left[hit]] = self.vals[at[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def skipped(key: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether the keyed hash drops the candidate; key: of seed, document and place."""
    h = key ^ (a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) < np.uint64(limit)


def by_heap(m: Model, ids: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """One long word: its pieces at the places where they begin, and which places begin a piece."""
    ids = ids.copy()
    n = len(ids)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), np.ones(n, bool)
    heap: list = []

    def look(i: np.ndarray, j: np.ndarray) -> None:
        p = m.merged(ids[i], ids[j])
        ok = (p >= 0) & ~skipped(keys[i], ids[i], ids[j], limit) if limit else p >= 0
        for x, y, q in zip(i[ok].tolist(), j[ok].tolist(), p[ok].tolist()):
            heapq.heappush(heap, (int(m.rank[q]), x, y, q, int(ids[x]), int(ids[y])))

    look(np.arange(n - 1), np.arange(1, n))
    while heap:
        _, i, j, q, a, b = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or nxt[i] != j or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], nxt[i] = q, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        around = [(x, y) for x, y in ((prv[i], i), (i, nxt[i])) if x >= 0 and y < n]
        if around:
            look(*np.array(around).T)
    return ids, alive


def segment(m: Model, chars: np.ndarray, doc_at: np.ndarray, doc_key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a batch and offsets of the texts into them. chars: code points, doc_at: n + 1 offsets."""
    n, limit = len(chars), int(rate * 2**32)
    ids = m.char[chars].astype(np.int32)
    alive = np.ones(n, bool)
    if n:
        begins = np.zeros(n, bool)
        begins[doc_at[:-1][np.diff(doc_at) > 0]] = True
        space = chars == 32
        begins[1:] |= space[1:] & ~space[:-1]
        known = ids >= 0
        begins |= ~known
        begins[1:] |= ~known[:-1]
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, n))
        of = np.repeat(np.arange(len(doc_at) - 1), np.diff(doc_at))
        place = (np.arange(n) - doc_at[of]).astype(np.uint64)
        keys = (doc_key[of] + place) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
        for w in np.flatnonzero(sizes > LONG):
            a, b = starts[w], starts[w] + sizes[w]
            ids[a:b], alive[a:b] = by_heap(m, ids[a:b], keys[a:b], limit)
        _rounds(m, ids, alive, keys, starts, sizes, limit)
    unknown = alive & (ids < 0)
    count = alive.astype(np.int64)
    if unknown.any():
        at = np.flatnonzero(unknown)
        raw = [chr(c).encode() for c in chars[at].tolist()]
        count[at] = [len(r) for r in raw]
    sums = np.concatenate([[0], np.cumsum(count)])
    out = np.repeat(ids[alive], count[alive])
    if unknown.any():
        for p, r in zip(sums[at].tolist(), raw):
            out[p : p + len(r)] = m.byte_ids[list(r)]
    return out, sums[doc_at]


def _rounds(m: Model, ids: np.ndarray, alive: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> None:
    """The agenda of all words at once; changes ids and alive in place."""
    busy = np.zeros(len(ids) + 1, np.int64)
    w = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    busy[starts[w]] += 1
    busy[starts[w] + sizes[w]] -= 1
    at = np.flatnonzero(np.cumsum(busy[:-1]) > 0)  # places in words that still change
    if not len(at):
        return
    first = np.zeros(len(ids), bool)
    first[starts] = True
    head = first[at]
    sym = ids[at].astype(np.int64)

    def rank(i: np.ndarray) -> np.ndarray:
        """Rank and place of the pair that begins at i, and below it the piece; NEVER if none or skipped."""
        p = m.merged(sym[i], sym[i + 1])
        ok = p >= 0
        if limit:
            ok &= ~skipped(keys[at[i]], sym[i], sym[i + 1], limit)
        return np.where(ok, m.rank[p], NEVER)

    order = np.full(len(at), NEVER)
    inner = np.flatnonzero(~head[1:])
    order[inner] = rank(inner)
    while len(at):
        h = np.flatnonzero(head)
        n = np.diff(np.append(h, len(at)))
        best = np.minimum.reduceat(order, h)
        # leftmost place of the best rank in each word
        match = np.flatnonzero((order == np.repeat(best, n)) & (order < NEVER))
        word = np.repeat(np.arange(len(h)), n)[match] if len(match) else match
        keep = np.ones(len(match), bool)
        keep[1:] = word[1:] != word[:-1]
        i = match[keep]
        if not len(i):
            return
        sym[i] = m.merged(sym[i], sym[i + 1])
        ids[at[i]] = sym[i]
        alive[at[i + 1]] = False
        stay = np.repeat(best < NEVER, n)
        stay[i + 1] = False
        new = np.cumsum(stay) - 1
        i = new[i]
        at, sym, order, head = at[stay], sym[stay], order[stay], head[stay]
        order[i] = NEVER
        right = i[(i + 1 < len(at)) & ~head[np.minimum(i + 1, len(at) - 1)]]
        order[right] = rank(right)
        left = i[~head[i]] - 1
        order[left] = rank(left)


def decode(m: Model, ids: np.ndarray) -> bytes:
    """The bytes of the pieces, joined."""
    n = m.sizes[ids]
    ends = np.cumsum(n)
    return m.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(m.at[ids] - (ends - n), n)].tobytes()


def decode_text(m: Model, ids: np.ndarray) -> str:
    return decode(m, ids)[1:].decode("utf-8", "replace")


def encode_docs(docs: DataFrame, path: str, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless): lossless says that the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part, data, offsets in text.steps(batches, "text", 1 << 20):
            n = part.num_rows
            full = np.flatnonzero(np.diff(offsets) > 0)
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            chars = np.insert(chars, lead[offsets[full]], 32)
            doc_at = lead[offsets] + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
            ident = part.column("doc_id")
            key = text.mix(np.asarray(ident.fill_null(0)).astype(np.int64).view(np.uint64) ^ text.mix(np.array([seed], np.uint64)))
            key[np.asarray(ident.is_null())] = np.uint64(seed & 0xFFFFFFFF)
            ids, at = segment(m, chars, doc_at, key, rate)
            whole = decode(m, ids)
            raw = data.tobytes()
            expected = b"".join(b" " + raw[offsets[i] : offsets[i + 1]] for i in full)
            if whole == expected:
                same = np.ones(n, bool)
            else:
                same = np.array([decode(m, ids[at[i] : at[i + 1]]) == (b" " + raw[offsets[i] : offsets[i + 1]] if offsets[i + 1] > offsets[i] else b"") for i in range(n)])
            yield pa.RecordBatch.from_arrays([ident, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(same)], ["doc_id", "n_pieces", "ids", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_docs(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
