"""Operator 8: near-duplicate embeddings by a forest of random-projection trees.

1. Equal vectors are one class with a weight; only classes are indexed and compared.
2. Trees split the unit sphere again and again by random hyperplanes; a vector close to a split
   (SPILL standard deviations of a random projection, or more) goes to both sides. Every class
   is routed through every tree. The number of levels follows the number of classes, so that
   leaves keep about LEAF classes, and the number of trees follows from the levels, so that the
   expected share of missed links at the cosine threshold itself stays below MISS (closer pairs
   are missed far less often). That holds for splits of density DENSITY, so the density at each
   split is measured in a bounded sample (SAMPLE vectors, more with more leaves, MOST at most): where it is higher, as in a group of
   near copies, the spill of that node is widened to part as few pairs. A node where no split
   leaves at most SHRINK of it on each side is a leaf, whatever its size: the pairs of a large
   group of near copies are links, and are compared and counted. Trees are added, up to TREES,
   until the near pairs within PAIRS sampled vectors are held but for a share of MISS. Nodes with
   fewer than MEASURED sampled vectors are too small to measure and take SPILL as it is.
3. Leaves below one node travel as one group (about GROUP_BYTES of vectors), so that a class is
   sent once for all of them, in its own precision; classes of one batch that go to the same group
   go as one row. Each leaf is compared by matrix products in
   single precision, less a bound of their error, and the pairs that pass by the cosine in double
   precision. A group with a leaf of more than 2 * CAP classes, or that is too large, is sent leaf by
   leaf instead, and a leaf of more than CAP classes is dealt into tiles. A pair that an earlier
   tree's leaf (or an earlier leaf) already holds is not counted again: each class carries the
   names of its leaves, so no pairs are written out. Only pairs that are links are looked up, or
   by a matrix product in leaves with more than DENSE links a class. Leaves give each class its
   number of links and a spanning set of links, which are united into components.

Recall against all pairs is measured in tests; links are only those with cosine >= 0.9.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component. Vectors of different lengths do not link. Rows with the
same vec_id and vector count as copies. A null vec_id stays null and counts as greater than
every other. Tables without vectors give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import frames, text

SPILL, LEAF, SAMPLE, CAP = 0.24, 400, 32_768, 3000
#: Directions that nodes draw from, and sampled vectors that a node needs at least to be measured.
POOL, MEASURED = 4096, 16
#: Vectors in the sample at most, which bounds the forest that is broadcast.
MOST = 1 << 17
MISS = 0.002
COSINE = 0.9
DENSITY, SHRINK, TREES, PAIRS = 0.4, 0.8, 40, 2048
#: Bytes of vectors in double precision that travel as one group; levels that are cut into groups at least.
GROUP_BYTES, FIRST_LEVELS = 10 << 20, 6
#: Bytes of vectors and leaves that are dealt to groups at a time.
DEALT_BYTES = 64 << 20
#: Links a class up to which a leaf's pairs are looked up one by one, and pairs looked up at a time.
DENSE, LOOKED_UP = 16, 1 << 16
#: A leaf's name is its forest, tree and node + 1 (whose leading one bit tells the level).
TREE_BITS, FOREST_BITS = 40, 48


def parted(spill: float, sd: float) -> float:
    """The mean length by which a normal difference of deviation sd exceeds a spill on both sides."""
    z = 2 * spill / sd
    return 2 * sd * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * 0.5 * math.erfc(z / math.sqrt(2)))


def trees_for(levels: int, cosine: float, spill: float, miss: float) -> int:
    """How many trees hold a pair at the threshold in a common leaf but for a share of `miss`.

    In units of a random projection's standard deviation, the pair's projections differ by a
    normal variable of deviation sqrt(2 - 2 cosine); a split of density DENSITY parts them where
    it falls between them and farther than spill from both.
    """
    sd = max(1e-9, (2 - 2 * cosine) ** 0.5)
    stay = max(1e-3, 1 - DENSITY * parted(spill, sd)) ** levels
    return 2 if stay >= 1 - miss else max(2, math.ceil(math.log(miss) / math.log(1 - stay)))


class Forest:
    """Trees as arrays: node i has the children 2 i + 1 and 2 i + 2; a leaf's spill is infinite.

    Each node has a direction of its own, drawn from a pool of random ones by a hash of tree and
    node. Cuts and spills are kept for the upper levels, as far as the sample reaches; nodes below
    are cut in the middle of the sphere. What a forest holds is therefore bounded.
    """

    def __init__(self, sample: np.ndarray, rows: int, leaf: int, cosine: float, spill: float, miss: float, seed: int):
        rng = np.random.default_rng(seed)
        size = sample.shape[1] if sample.size else 1
        self.levels = int(np.ceil(np.log2(max(1, rows / leaf))))
        self.kept = min(self.levels, int(np.log2(max(1, len(sample) / MEASURED * 2))))
        self.unit = size**-0.5
        self.sd = max(1e-9, (2 - 2 * cosine) ** 0.5)
        # spills, and the densities at which they part as many pairs as `spill` at DENSITY
        self.steps = spill + np.arange(0, 64) / 16 * self.sd
        self.bears = np.array([DENSITY * parted(spill, self.sd) / max(1e-300, parted(w, self.sd)) for w in self.steps])
        pool = rng.standard_normal((POOL, size))
        self.pool = pool / np.linalg.norm(pool, axis=1, keepdims=True) / self.unit
        self.seed, self.cuts, self.spills = seed, [], []
        some = sample[:PAIRS]
        missed = np.triu(some @ some.T >= cosine, 1) if len(some) else np.zeros((0, 0), bool)
        allowed, least = miss * missed.sum(), trees_for(self.levels, cosine, spill, miss)
        while len(self.cuts) < least or missed.sum() > allowed and len(self.cuts) < TREES:
            self.grow(sample, leaf * len(sample) / max(1, rows))
            row, node = self.leaves(len(self.cuts) - 1, some)
            _, node = np.unique(node, return_inverse=True)
            held = np.zeros((len(some), 1 + node.max(initial=0)), np.float32)
            held[row, node] = 1
            missed &= held @ held.T == 0

    def sides(self, tree: int, unit: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The projection of each row on its node's direction, in standard deviations."""
        if not len(row):
            return np.zeros(0)
        low, high = int(node.min()), int(node.max())
        if high - low < 64:  # few nodes: one product
            return (unit @ self.directions(tree, np.arange(low, high + 1)).T)[row, node - low]
        order = np.argsort(node, kind="stable")
        first, start = np.unique(node[order], return_index=True)
        if len(row) < 4 * len(first):  # few rows a node
            return np.einsum("ij,ij->i", unit[row], self.directions(tree, node))
        rows, ends, out = row[order], [*start[1:].tolist(), len(row)], np.empty(len(row))
        for a, b, way in zip(start.tolist(), ends, self.directions(tree, first)):
            out[a:b] = unit[rows[a:b]] @ way
        side = np.empty(len(row))
        side[order] = out
        return side

    def directions(self, tree: int, node: np.ndarray) -> np.ndarray:
        """The direction of each node."""
        drawn = text.mix(node.astype(np.uint64) + np.uint64((tree << 44) + (self.seed << 52))) % np.uint64(POOL)
        return self.pool[drawn.astype(np.int64)]

    def grow(self, sample: np.ndarray, least: float) -> None:
        """One more tree; nodes of up to `least` sampled vectors are leaves."""
        cuts, spills = np.zeros((1 << self.kept) - 1), np.full((1 << self.kept) - 1, np.inf)
        self.cuts.append(cuts)
        self.spills.append(spills)
        row, node = np.arange(len(sample)), np.zeros(len(sample), np.int64)
        for level in range(self.kept):
            order = np.argsort(node, kind="stable")
            row, node = row[order], node[order]
            first, start = np.unique(node, return_index=True)
            side = self.sides(len(self.cuts) - 1, sample, row, node)
            for i, own in zip(first.tolist(), np.split(side, start[1:])):
                if len(own) > least:
                    cuts[i], spills[i] = self.split(np.sort(own))
            # places that the sample does not reach
            empty = np.setdiff1d(np.arange((1 << level) - 1, (2 << level) - 1), first)
            spills[empty] = self.steps[0]
            row, node = self.step(side, row, node, cuts[node], spills[node])[:2]

    def split(self, own: np.ndarray) -> tuple[float, float]:
        """(cut, spill) of a node from its sorted projections; the spill is infinite without a good cut."""
        n = len(own)
        if n < MEASURED:
            return float(np.median(own)) if n >= 8 else 0.0, self.steps[0]
        place = (np.linspace(0.25, 0.75, 17) if n >= 64 else np.array([0.5])) * (n - 1)
        below = place.astype(np.int64)
        at = own[below] + (own[np.minimum(below + 1, n - 1)] - own[below]) * (place - below)  # quantiles
        within = np.searchsorted(own, at + self.sd / 2, "right") - np.searchsorted(own, at - self.sd / 2, "left")
        k = np.searchsorted(self.bears, within / (n * self.sd))
        wide = self.steps[np.minimum(k, len(self.steps) - 1)]
        share = np.maximum(np.searchsorted(own, at + wide, "right"), n - np.searchsorted(own, at - wide, "left")) / n
        best = int(share.argmin())
        return float(at[best]), float(wide[best]) if share[best] <= SHRINK else np.inf

    @staticmethod
    def step(side: np.ndarray, row: np.ndarray, node: np.ndarray, cut: np.ndarray | float, spill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, node) one level down, and those that are in a leaf."""
        end = np.isinf(spill)
        d = side - cut
        both = np.abs(d) <= spill
        right = ((d > 0) | both) & ~end
        left = ((d <= 0) | both) & ~end
        return np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]), row[end], node[end]

    def leaves(self, t: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each vector in tree t; a row near a cut has more than one."""
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        out = []
        for level in range(self.levels):
            held = level < self.kept
            cut, spill = (self.cuts[t][node], self.spills[t][node]) if held else (0.0, np.full(len(node), self.steps[0]))
            row, node, *ended = self.step(self.sides(t, unit, row, node), row, node, cut, spill)
            out.append(ended)
        rows, nodes = zip(*out, (row, node))
        return np.concatenate(rows), np.concatenate(nodes)


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Rows of a binary column of numbers, all of one length."""
    return flat(column, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def flat(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of a binary column, one row after the other."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(raw):
        return np.zeros(0, kind)
    at = np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_binary(raw.type) else np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)


def binary(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose row i has the numbers up to ends[i]; the inverse of flat()."""
    at = np.concatenate([[0], ends]).astype(np.int32) * np.int32(numbers.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(numbers))])


def units(rows: np.ndarray) -> np.ndarray:
    """Rows as vectors of length 1, in double precision."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def level_of(node: np.ndarray) -> np.ndarray:
    """The level of nodes that are numbered from 1."""
    return np.frexp(node.astype(np.float64))[1].astype(np.int64) - 1


def within(codes: np.ndarray, key: int) -> np.ndarray:
    """Which of the leaves are the node `key` or below it."""
    at = codes & ((1 << TREE_BITS) - 1)
    own = key & ((1 << TREE_BITS) - 1)
    down = level_of(at) - (own.bit_length() - 1)
    return (codes >> TREE_BITS == key >> TREE_BITS) & (down >= 0) & (at >> np.maximum(down, 0) == own)


def leaf_links(unit: np.ndarray, codes: list[np.ndarray], own: int, weight: np.ndarray, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row that this leaf is the first to hold, and links that span its components.

    codes: each row's leaves, ascending; a pair belongs to the least leaf that both are in.
    """
    n = len(unit)
    earlier = [c[c < own] for c in codes]
    names, flat, times = np.unique(np.concatenate(earlier) if n else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = times > 1
    incidence = np.zeros((n, shared.sum()), np.float32)
    kept = shared[flat]
    incidence[np.repeat(np.arange(n), [len(c) for c in earlier])[kept], (np.cumsum(shared) - 1)[flat[kept]]] = 1
    counts, tree, root = np.zeros(n, np.int64), [], np.arange(n)

    for a in range(0, n, 512):
        near = unit[a : a + 512] @ unit.T >= cosine
        near &= incidence[a : a + 512] @ incidence.T == 0
        near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = False
        if side is not None:
            near &= side[a : a + 512, None] != side[None, :]
        counts[a : a + near.shape[0]] = near @ weight
        for i in np.flatnonzero(near.any(1)).tolist():
            to = np.flatnonzero(near[i])
            if (root[to] == root[a + i]).all():
                continue
            others, first = np.unique(root[to], return_index=True)
            tree += [(a + i, int(to[j])) for x, j in zip(others, first) if x != root[a + i]]
            root[np.isin(root, others)] = root[a + i]
    return counts, tree


def near_pairs(single: np.ndarray, side: np.ndarray | None, bound: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs i < j whose product is at least bound; None if they are more than `most`."""
    out, n = [], 0
    for a in range(0, len(single), 512):
        near = single[a : a + 512] @ single[a:].T >= bound
        own = np.arange(near.shape[0])
        near[own, own] = False
        some = np.flatnonzero(near.any(1))
        i, j = np.divmod(np.flatnonzero(near[some]), near.shape[1])
        i = some[i]
        keep = i < j if side is None else (i < j) & (side[a + i] != side[a + j])
        out.append((a + i[keep], a + j[keep]))
        n += len(out[-1][0])
        if n > most:
            return None
    return tuple(np.concatenate(x) for x in zip(*out))


def held_before(i: np.ndarray, j: np.ndarray, own: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a leaf less than `own`; row r has the ascending leaves codes[at[r]:at[r + 1]]."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), LOOKED_UP):
        x, y, leaf = i[a : a + LOOKED_UP], j[a : a + LOOKED_UP], own[a : a + LOOKED_UP]
        rows, place = np.unique(y, return_inverse=True)
        flat = spans(at[rows], at[rows + 1] - at[rows])
        names, rank = np.unique(codes[flat], return_inverse=True)
        held = np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows]) * len(names) + rank  # ascending
        n = at[x + 1] - at[x]
        asked, pair = codes[spans(at[x], n)], np.repeat(np.arange(len(x)), n)
        early = asked < leaf[pair]
        asked, pair = asked[early], pair[early]
        rank = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        want = place[pair] * len(names) + rank
        found = (names[rank] == asked) & (held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want)
        out[a + pair[found]] = True
    return out


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ..., start + n - 1 of each span, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def group_links(key: int, unit: np.ndarray, at: np.ndarray, codes: np.ndarray, weight: np.ndarray, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """leaf_links() over all leaves at or below the node `key`; row r has the leaves codes[at[r]:at[r + 1]]."""
    n, single = len(unit), unit.astype(np.float32)
    bound = np.float32(cosine - (unit.shape[1] + 8) * 2.0**-23)  # beyond the error of single precision
    mine = np.flatnonzero(within(codes, key))
    row = np.searchsorted(at, mine, "right") - 1
    order = np.argsort(codes[mine], kind="stable")
    leaves, start = np.unique(codes[mine][order], return_index=True)
    counts, tree, pairs = np.zeros(n, np.int64), [], []
    for leaf, rows in zip(leaves.tolist(), np.split(row[order], start[1:])):
        own = None if side is None else side[rows]
        got = near_pairs(single[rows], own, bound, DENSE * len(rows))
        if got is None:
            close = np.concatenate([(single[rows[a : a + 512]] @ single[rows].T >= bound).sum(1) for a in range(0, len(rows), 512)]) > 1
            rows = rows[close]
            own = None if side is None else side[rows]
            links, some = leaf_links(unit[rows], [codes[at[r] : at[r + 1]] for r in rows.tolist()], leaf, weight[rows], own, cosine)
            counts[rows] += links
            tree += [(int(rows[a]), int(rows[b])) for a, b in some]
        else:
            pairs.append((rows[got[0]], rows[got[1]], np.full(len(got[0]), leaf)))
    if pairs:
        i, j, leaf = (np.concatenate(x) for x in zip(*pairs))
        near = np.concatenate([np.einsum("ij,ij->i", unit[i[a : a + LOOKED_UP]], unit[j[a : a + LOOKED_UP]]) >= cosine for a in range(0, len(i), LOOKED_UP)] or [np.zeros(0, bool)])
        i, j, leaf = i[near], j[near], leaf[near]
        new = ~held_before(i, j, leaf, at, codes)
        i, j = i[new], j[new]
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        tree += spanning(i.tolist(), j.tolist())
    return counts, tree


def spanning(i: list[int], j: list[int]) -> list[tuple[int, int]]:
    """Those of the links (i, j) that join parts which links before them do not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a, b in zip(i, j):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, spill: float = SPILL, leaf: int = LEAF, miss: float = MISS, sample: int = SAMPLE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    # numbers of single precision are kept in it
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            v = part.column("v")
            at = v.offsets.to_numpy().astype(np.int64)
            x = v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind(0)  # adding zero makes -0.0 and 0.0 one value
            sums = [np.concatenate([[0], np.cumsum(y)]) for y in (~np.isfinite(x), x != 0)]
            bad, filled = (y[at[1:]] - y[at[:-1]] for y in sums)
            ok = v.is_valid().to_numpy(zero_copy_only=False) & (bad == 0) & (filled > 0)
            raw, size = memoryview(np.ascontiguousarray(x)).cast("B"), np.dtype(kind).itemsize
            own = [raw[a * size : b * size] if k else None for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist())]
            h = [None if o is None else hashlib.sha256(o).digest() for o in own]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(h, pa.binary()), pa.array([None if o is None else bytes(o) for o in own], pa.binary())], ["vec_id", "h", "v"])

    rows = frames.cut(rows.mapInArrow(packed, "vec_id long, h binary, v binary"), "vectors")
    classes = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("v").alias("v"))
    sid = F.conv(F.substring(F.hex("h"), 1, 15), 16, 10).cast("long").alias("sid")
    dim = (F.octet_length("v") / F.lit(np.dtype(kind).itemsize)).cast("long").alias("dim")
    points = frames.cut(classes.select(sid, "h", "low", "weight", dim, "v"), "points")
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    forests = {}
    for k, (dim, n) in enumerate(sorted(sizes.items())):
        some = min(max(sample, 64 * n // leaf), max(sample, MOST))
        got = points.where(F.col("dim") == dim).where(F.pmod(F.col("sid"), F.lit(max(1, -(-n // some)))) == 0).select("v").limit(2 * some).toArrow()
        # with a spill of 0.24 a level has about 1.19 times the rows of the one above, on twice the nodes
        depth = max(FIRST_LEVELS, math.ceil(math.log(max(1, 8 * dim * n / GROUP_BYTES)) / math.log(2 / 1.19)))
        forests[dim] = (k, depth, Forest(units(matrix(got.column("v"), kind)), n, leaf, cosine, spill, miss, seed))
    held = spark.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = part.take(pa.array(np.flatnonzero(dims == dim)))
                k, depth, forest = held.value[int(dim)]
                x = units(matrix(own.column("v"), kind))
                row, node, tree = (np.concatenate(y) for y in zip(*((r, node + 1, np.full(len(r), t)) for t in range(len(forest.cuts)) for r, node in [forest.leaves(t, x)])))
                base = (np.int64(k) << FOREST_BITS) + (tree.astype(np.int64) << TREE_BITS)
                name, of = base + node, base + (node >> np.maximum(0, level_of(node) - depth))
                order = np.lexsort((name, row))
                row, tree, name, of = row[order], tree[order], name[order], of[order]
                at = pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32())
                # each group of a row once, with the number of the row's leaves up to the group's tree
                by = np.lexsort((of, row))
                by = by[np.concatenate([[True], (row[by][1:] != row[by][:-1]) | (of[by][1:] != of[by][:-1])])[: len(by)]]
                place = row * (1 << 8) + tree
                upto = np.searchsorted(place, place[by], "right") - at.to_numpy()[row[by]]
                groups = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[by], np.arange(len(x) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(of[by]), pa.array(upto.astype(np.int32))], ["leaf", "upto"]))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("sid", "weight", "dim", "v")), pa.ListArray.from_arrays(at, pa.array(name)), pa.ListArray.from_arrays(at, pa.array(of)), groups], ["sid", "weight", "dim", "v", "leaves", "of", "groups"])

    kinds = "sid long, weight long, dim long, v binary, leaves array<long>, of array<long>, groups array<struct<leaf: long, upto: int>>"
    routed = frames.cut(points.select("sid", "weight", "dim", "v").mapInArrow(route, kinds), "routed")
    sizes = routed.select("dim", F.explode(F.arrays_zip("leaves", "of")).alias("x")).groupBy("x.of", "x.leaves").agg(F.count("*").alias("n"), F.max("dim").alias("dim"))
    large = frames.cut(sizes.groupBy("of").agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("dim") * 8).alias("bytes")).where((F.col("n") > 2 * cap) | (F.col("bytes") > 4 * GROUP_BYTES)).select("of"), "large_groups")
    n = large.count()
    # more than can be sent to all tasks: every group is sent leaf by leaf
    whole = n <= frames.BROADCAST_ROWS
    parted = spark.sparkContext.broadcast(np.sort([r.of for r in large.collect()]).astype(np.int64) if whole else None)

    def packed_rows(part: pa.RecordBatch, at: np.ndarray, leaf: np.ndarray, upto: np.ndarray, tile_i: np.ndarray, tile_j: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Row r goes to the groups at[r] to at[r + 1] with the first `upto` of its leaves; a row for each group and batch."""
        sid, weight, leaves = (part.column(c) for c in ("sid", "weight", "leaves"))
        sid, weight, v = sid.to_numpy(), weight.to_numpy(), matrix(part.column("v"), kind)
        first, codes = leaves.offsets.to_numpy().astype(np.int64), leaves.flatten().to_numpy()
        first = first - first[0]
        row = np.repeat(np.arange(len(sid)), np.diff(at))
        size = np.cumsum(upto.astype(np.int64) * 8 + v.shape[1] * v.itemsize + 24)
        for few in np.split(np.arange(len(row)), np.flatnonzero(np.diff(size // DEALT_BYTES)) + 1):
            few = few[np.lexsort((tile_j[few], tile_i[few], leaf[few]))]
            r, key = row[few], np.stack([leaf[few], tile_i[few], tile_j[few]])
            ends = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, len(few)) if len(few) else np.zeros(0, int)
            n = upto[few].astype(np.int64)
            key = [pa.array(k) for k in key[:, ends - 1].astype(np.int64)]
            code_ends = np.cumsum(n)[ends - 1]
            yield pa.RecordBatch.from_arrays([*key, binary(sid[r], ends), binary(weight[r], ends), binary(v[r].ravel(), ends * v.shape[1]), binary(n.astype(np.int32), ends), binary(codes[spans(first[r], n)], code_ends), binary(side[few].astype(np.int8), ends)], ["leaf", "tile_i", "tile_j", "sid", "weight", "v", "n", "leaves", "side"])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = part.take(pa.array(np.flatnonzero(dims == dim)))
                groups = own.column("groups")
                leaf, upto = (groups.flatten().field(c).to_numpy() for c in ("leaf", "upto"))
                keep = ~np.isin(leaf, parted.value)
                at = np.concatenate([[0], np.cumsum(keep)])[groups.offsets.to_numpy() - groups.offsets[0].as_py()]
                none = np.zeros(keep.sum(), np.int64)
                yield from packed_rows(own, at, leaf[keep], upto[keep], none, none, none)

    def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = part.take(pa.array(np.flatnonzero(dims == dim)))
                leaf, *tile = (own.column(c).to_numpy() for c in ("leaf", "tile_i", "tile_j", "side"))
                upto = np.diff(own.column("leaves").offsets.to_numpy())
                yield from packed_rows(own, np.arange(len(own) + 1), leaf, upto, *tile)

    kinds = "leaf long, tile_i long, tile_j long, sid binary, weight binary, v binary, n binary, leaves binary, side binary"
    dealt = [routed.select("sid", "weight", "dim", "v", "leaves", "groups").mapInArrow(by_group, kinds)] if whole else []
    if n:
        one = routed.select("sid", "weight", "dim", "v", "leaves", F.posexplode(F.arrays_zip("leaves", "of")).alias("at", "x"))
        one = one.join(F.broadcast(large), F.col("x.of") == F.col("of"), "left_semi") if whole else one
        one = one.select("sid", "weight", "dim", "v", F.expr("slice(leaves, 1, at + 1)").alias("leaves"), F.col("x.leaves").alias("leaf"))
        dealt.append(frames.tiles(one, "leaf", "sid", cap).select("sid", "weight", "dim", "v", "leaves", "leaf", "tile_i", "tile_j", "side").mapInArrow(by_tile, kinds))
    dealt = dealt[0] if len(dealt) == 1 else dealt[0].unionByName(dealt[1])

    def compare(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(parts))
        sid, weight, n, codes, side = (flat(got.column(c), k) for c, k in (("sid", np.int64), ("weight", np.int64), ("n", np.int32), ("leaves", np.int64), ("side", np.int8)))
        unit = units(flat(got.column("v"), kind).reshape(len(sid), -1))
        counts, tree = group_links(key[0].as_py(), unit, np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), codes, weight, side if key[1].as_py() != key[2].as_py() else None, cosine)
        at = np.flatnonzero(counts)
        a, b = np.array(tree, np.int64).reshape(-1, 2).T
        none = pa.nulls
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sid[at], sid[a]])), pa.concat_arrays([none(len(at), pa.int64()), pa.array(sid[b])]), pa.concat_arrays([pa.array(counts[at]), none(len(a), pa.int64())])], ["a", "b", "n"])

    found = frames.cut(dealt.groupBy("leaf", "tile_i", "tile_j").applyInArrow(compare, "a long, b long, n long"), "found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("others"))
    roots = frames.components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "sid"})
    named = points.select("sid", "h", "low", "weight").join(roots, "sid", "left").join(counts, "sid", "left")
    named = frames.cut(named.withColumn("root", F.coalesce("root", "sid")), "named")
    least = frames.cut(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "least")
    final = frames.spread_join(named, least, ["root"], ["sid"]).select("h", F.col("weight").alias("n"), F.coalesce("others", F.lit(0)).alias("others"), "component_id")
    # a vector may be that of any share of the rows
    linked = frames.spread_join(rows.where("h is not null").select("vec_id", "h"), frames.cut(final, "final"), ["h"], ["vec_id"])
    out = linked.select("vec_id", (F.col("others") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_vectors(frames.table(spark, sf_dir, "embeddings"))
