"""Spark helpers shared by the operators: scratch tables, checked broadcasts, components, tiles."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folders of local sessions without spark.checkpoint.dir, by application.
_local: dict[str, str] = {}
_collected = 0.0


def scratch_folder(spark: SparkSession) -> str:
    """The one folder of this application below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local tests) it is a temporary folder that goes when Python ends.
    """
    name = f"tessera-{spark.sparkContext.applicationId}"
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if name not in _local:
            _local[name] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _local[name], ignore_errors=True)
        root = f"file://{_local[name]}"
    return f"{root.rstrip('/')}/{name}"


def scratch_root(spark: SparkSession) -> str:
    """A new folder in that of this application."""
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Remove all that the operators wrote for this application; call it when their results are used."""
    remove(spark, scratch_folder(spark))


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which the shuffle files of ended steps go."""
    global _collected
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _collected = time.monotonic()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step as Parquet in the shared folder and read it back: lineage ends there.

    Shuffle files of steps before it go as soon as the driver collects its garbage, which is
    asked for here, at most every two seconds: on a driver with a large heap they would else stay
    for the whole job.
    """
    spark = df.sparkSession
    if time.monotonic() - _collected > 2:
        sweep(spark)
    path = f"{scratch_root(spark)}/{name}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def discard(*steps: DataFrame) -> None:
    """Remove what cut() wrote for steps that nothing reads any more."""
    for df in steps:
        remove(df.sparkSession, df.scratch)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a counted side up to BROADCAST_ROWS; beyond it Spark shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: A key with more rows than this, and more than one in HOT_KEYS of all, is dealt over many tasks.
HOT_ROWS, HOT_KEYS = 1024, 20_000


def spread_join(rows: DataFrame, sums: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """rows joined with sums, which has a row for each key with the number `n` of its rows.

    Rows of a hot key get a salt from their columns `ident`, and the key's row in sums is repeated
    for each salt. Which keys are hot is broadcast: they are fewer than HOT_KEYS, since each has
    more than one in HOT_KEYS of all rows.
    """
    total = sums.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    salts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hot = sums.where(F.col("n") > limit).select(*keys, salts.alias("_k"))
    if not hot.limit(1).count():
        return rows.join(sums, keys)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*ident), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    return dealt.join(sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [*keys, "_salt"]).drop("_salt")


#: Edges that one task of components() takes, and that one task connects by itself.
EDGES, FEW_EDGES = 200_000, 16_384


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges of all batches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for part in batches:
        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: rows (node, root), root the least node reached.

    Alternating large-star and small-star steps until every component is a star. Every step is
    an aggregate with map-side combine and a join in which the edges of a hub are dealt over many
    tasks. Up to FEW_EDGES edges are no work for many and are connected by one task, with the same
    result. Nodes without an edge to another node are not returned.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = e.count()
    if n <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(united, "node long, root long")
    tasks = max(4, -(-n // EDGES))

    def joined(rows: DataFrame, low: DataFrame) -> DataFrame:
        return spread_join(rows, cut(low, "low"), ["a"], ["b"])

    for _ in range(rounds):
        roles = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if not roles.coalesce(tasks).limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = cut(joined(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, low).select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        ).select("x.*").where("a <> b").distinct()
        before, e = e, cut(small.coalesce(tasks), "stars")
        discard(before, large)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def tiles(df: DataFrame, key: str, ident: str, cap: int) -> DataFrame:
    """Split the groups of `key` for pairwise work: adds tile_i, tile_j and side.

    A group of up to `cap` rows is the one tile (0, 0). A larger one is dealt by hash into
    k = ceil(rows / cap) chunks, and each pair of chunks is a tile, so that every pair of rows
    meets in exactly one tile and no task holds more than about 2 * cap rows of a group.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(cap)).cast("int").alias("_k"))
    large = cut(sizes.where("_k > 1"), "large")
    n = large.count()
    if not n:
        return df.withColumns({"tile_i": F.lit(0), "tile_j": F.lit(0), "side": F.lit(0)})
    out = df.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, key, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    out = out.withColumn("_c", F.pmod(F.xxhash64(ident, F.lit(7)), F.col("_k")).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return out.withColumns({"tile_i": F.least("_c", "_x"), "tile_j": F.greatest("_c", "_x"), "side": (F.col("_c") > F.col("_x")).cast("int")}).drop("_k", "_c", "_x")


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """(rk, doc_id, text, extra): rk is a unique long that orders rows as doc_id does; extra, where
    columns are named, is a struct of them, so that their names clash with none of an operator's.

    rk is doc_id itself where every doc_id occurs once. A table with null or repeated ids is
    sorted by (doc_id, text), nulls first, and numbered in that order.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*extra).alias("extra")] if extra else []))
    if not own.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return own.select(F.col("doc_id").alias("rk"), "*")
    ranked = own.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return cut(ranked.select(F.monotonically_increasing_id().alias("rk"), "*"), "keyed")


def unpacked(df: DataFrame, columns: list[str], extra: tuple[str, ...] | list[str]) -> DataFrame:
    """The columns named, and those of the struct `extra` that keyed() made."""
    return df.select(*columns, *[F.col("extra").getField(c).alias(c) for c in extra])


#: Bits of the largest filter that bit_filter makes (32 MB).
FILTER_BITS = 28


def bit_filter(keys: DataFrame, n: int) -> tuple[int, Broadcast]:
    """(bits, broadcast bytes): a bit for each 64-bit hash in the one column of keys, of which there are n.

    A test says no only for hashes that are not there, so that a filter saves rows and changes no
    result. It has about 16 bits a key and never more than FILTER_BITS bits: beyond that it lets
    more rows through. It is put together in 256 blocks, by the hashes' top byte.
    """
    spark = keys.sparkSession
    bits = min(FILTER_BITS, max(16, int(16 * max(1, n)).bit_length()))
    low, name = bits - 8, keys.columns[0]

    def build(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(1 << low, bool)
        for part in parts:
            h = part.column(name).to_numpy().view(np.uint64)
            block[((h << np.uint64(8)) >> np.uint64(64 - low)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(block, bitorder="little").tobytes()])], ["block", "bits"])

    rows = keys.select(name, F.expr(f"shiftrightunsigned({name}, 56)").alias("block")).groupBy("block").applyInArrow(build, "block long, bits binary").collect()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        at = r.block << (low - 3)
        whole[at : at + (1 << (low - 3))] = np.frombuffer(r.bits, np.uint8)
    return bits, spark.sparkContext.broadcast(whole.tobytes())


def in_filter(hashes: np.ndarray, bits: int, raw: bytes) -> np.ndarray:
    """Which of the uint64 hashes the filter may hold."""
    at = hashes >> np.uint64(64 - bits)
    return (np.frombuffer(raw, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
