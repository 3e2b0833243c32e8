"""Operator 9: benchmark decontamination by size-partitioned containment MinHash.

Items are partitioned by their number q of distinct word shingles, at powers of two. Each
partition has a sketch table of its own and bounds of its own: a document with fewer shingles
than t times the partition's least q is not looked up in it, and an item's sketch is its bottom
k MinHash values, k = q - ceil(t q) + 1 + SPARE. A document that holds at least t of the item's
shingles lacks at most q - ceil(t q) of them, and so holds at least 1 + SPARE values of the
sketch (all that there are, if fewer): no match is missed, however long the document is, while
one or two shared shingles make no candidate. Banded signatures of both sides would miss most
short items in long documents, where their Jaccard similarity is below one in a hundred.
Documents are scanned once; candidates are verified by exact shingle containment.

Items go to the executors in blocks of at most BLOCK_BYTES of text, one scan for each block, so
that what is broadcast is bounded and any number of items can be searched.

Defined results: a text or item with fewer than five words has its whole word sequence as its
one shingle; one without words, or null, matches nothing. Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

BLOCK_BYTES = 32 << 20
FILTER_BITS = 20


#: Sketch values beyond the one that a match cannot lack.
SPARE = 2


class Partition:
    """The sketch table of the items whose number of shingles is in one range."""

    def __init__(self, items: np.ndarray, index: Sketches, share: int):
        q = index.n[items]
        lacks = q - -(-share * q // 100)
        size = np.minimum(q, lacks + 1 + SPARE)
        self.least = int(-(-share * q.min() // 100))
        self.want = np.zeros(len(index.n), np.int64)
        self.want[items] = size - lacks
        at = np.repeat(index.bounds[items], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(index.hashes[at], kind="stable")
        self.keys, self.items = index.hashes[at][order], np.repeat(items, size)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """(row, item) pairs whose row holds enough of the item's sketch."""
        near = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        a, b = np.searchsorted(self.keys, hashes[near]), np.searchsorted(self.keys, hashes[near], "right")
        hit = np.flatnonzero(b > a)
        n = (b - a)[hit]
        at = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, at = np.unique(np.stack([np.repeat(rows[near][hit], n), at]), axis=1)  # a shingle that repeats counts once
        pairs, held = np.unique(np.stack([row, self.items[at]]), axis=1, return_counts=True)
        return pairs[:, held >= self.want[pairs[1]]]


class Sketches:
    """The shingle sets of a block of items, ascending, which is their MinHash order, and their partitions."""

    def __init__(self, ids: list, texts: list[str | None], size: int, share: int):
        data, offsets = text.flat(pa.array(texts, pa.string()))
        self.hashes, self.bounds = text.shingle_sets(data, offsets, size)
        self.ids, self.n = ids, np.diff(self.bounds)
        band = np.floor(np.log2(np.maximum(1, self.n))).astype(np.int64)
        self.partitions = [Partition(np.flatnonzero((band == i) & (self.n > 0)), self, share) for i in np.unique(band[self.n > 0])]

    def candidates(self, rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs to verify; sizes: shingles of each row, repeats included."""
        out = [np.zeros((2, 0), np.int64)]
        for p in self.partitions:
            able = sizes >= p.least
            inside = slice(None) if able.all() else able[rows]
            out.append(p.candidates(rows[inside], hashes[inside]))
        return np.concatenate(out, axis=1)


def contained(docs: DataFrame, items: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents that hold at least share % of an item's shingles."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))

    def search(block: DataFrame) -> DataFrame:
        got = block.collect()  # at most about BLOCK_BYTES
        held = spark.sparkContext.broadcast(Sketches([r.item_id for r in got], [r.text for r in got], size, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for part, data, offsets in text.steps(batches, "text"):
                rows, hashes = text.shingle_rows(data, offsets, size)
                pairs = index.candidates(rows, hashes, np.bincount(rows, minlength=part.num_rows))
                if not pairs.shape[1]:
                    continue
                order = np.argsort(rows, kind="stable")
                start = np.searchsorted(rows[order], np.arange(len(offsets)))
                doc, item, shared = [], [], []
                for r in np.unique(pairs[0]):
                    own = np.unique(hashes[order[start[r] : start[r + 1]]])
                    for i in pairs[1][pairs[0] == r]:
                        want = index.hashes[index.bounds[i] : index.bounds[i + 1]]
                        at = np.searchsorted(own, want)
                        k = int((own[np.minimum(at, len(own) - 1)] == want).sum())
                        if 100 * k >= share * len(want):
                            doc.append(r)
                            item.append(i)
                            shared.append(k)
                if doc:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(index.n[item]), pa.array(shared, pa.int64())], ["doc_id", "item_id", "n_item", "n_shared"])

        return docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")

    if blocks == 1:
        return search(items)
    return reduce(DataFrame.union, (search(items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i)) for i in range(blocks)))


def op9(spark, sf_dir: str) -> DataFrame:
    return contained(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (SELECT 0 AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM t),
s AS (SELECT k, id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
  ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: l[i] || ' ' || l[i+1] || ' ' || l[i+2] || ' ' || l[i+3] || ' ' || l[i+4])) END AS g FROM w),
d AS (SELECT id, unnest(g) AS x FROM s WHERE k = 0),
i AS (SELECT id, len(g) AS n, unnest(g) AS x FROM s WHERE k = 1)
SELECT d.id AS doc_id, i.id AS item_id, CAST(i.n AS BIGINT) AS n_item, count(*) AS n_shared FROM i JOIN d ON i.x = d.x
GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n
"""
