"""How the supplied relational tables stand in for evidence ledgers, in Spark and in SQL."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_us
from ..session import table


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One speech segment for each turn: 60 ms a character, then a gap of 0, 0.5 or 1 s."""
    w = Window.partitionBy("conv_id").orderBy("speech_id")
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("speech_id"), "text", (F.length("text") * 60_000).cast("long").alias("_dur"), (F.col("turn") % 3 * 500_000).alias("_gap"))
    own = own.withColumn("start_us", F.coalesce(F.sum(F.col("_dur") + F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.withColumn("end_us", F.col("start_us") + F.col("_dur")).drop("_dur", "_gap")


def speech_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).groupBy("conv_id").agg(F.lit(0).cast("long").alias("range_start_us"), F.max("end_us").alias("range_end_us"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("_n"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    return events.select((F.col("user_id") % F.col("_n")).alias("conv_id"), F.col("event_id").alias("frame_id"), (epoch_us(F.col("ts")) % 200_000_000).alias("t_us"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("sample_index"), epoch_us(F.col("ts")).alias("t_us"), (F.col("value") / 500.0).alias("change_score"), F.col("event_type").alias("label"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images of embeddings by label, in vec_id order, two a second."""
    w = Window.partitionBy("label").orderBy("vec_id")
    gray = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.rint((x.cast("double") + 1) * 127.5).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.row_number().over(w) - 1).cast("long").alias("sample_index"), gray.alias("gray"), "embedding")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("_l"))
    return own.select("doc_id", F.size("_l").alias("_n"), F.posexplode("_l").alias("line", "text")).select("doc_id", "line", "text", (F.col("line") / F.col("_n")).alias("y"), F.least(F.lit(1.0), F.length("text") / 80.0).alias("width"), (F.length("text") % 20 / 20.0).alias("confidence"))


def _bars(img: np.ndarray, n: int, ink: int) -> np.ndarray:
    for i in range(n):
        img[6 + 7 * i : 10 + 7 * i, 8 : 8 + 80 - 6 * i] = ink
    return img


@lru_cache(4096)
def screen_bytes(kind: str, page: int, items: int, seen: int) -> bytes:
    return screen(kind, page, items, seen).tobytes()


def screen(kind: str, page: int, items: int, seen: int) -> np.ndarray:
    """A gray picture of 60 x 100: a slide that builds, a worksheet that scrolls or a board that fills and is wiped."""
    if kind == "slide":
        return _bars(np.full((60, 100), 235 if page else 40, np.uint8), min(items, 6) + 1, 60 if page else 200)
    if kind == "board":
        return _bars(np.full((60, 100), 20, np.uint8), min(items, 7), 230)
    img = np.full((60, 100), 250, np.uint8)
    img[::10] = 120
    cells = np.random.default_rng(seen).integers(1, 10, (4, 10))
    for y in range(4):
        for x in range(10):
            img[18 + 10 * y : 24 + 10 * y, 10 * x + 1 : 10 * x + 1 + cells[y, x]] = 30
    return img


def screens(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Analysis frames at one a second of videos of four conversations each: a turn is shown for six
    seconds and adds an item, a conversation is a page; the last turn of a video is look-ahead."""
    w = Window.partitionBy("video_id").orderBy("conv_id", "turn", "role")
    turns = table(spark, sf_dir, "conversations").withColumn("video_id", F.format_string("video-%06d", F.expr("conv_id div 4")))
    turns = turns.withColumns({"seen": F.row_number().over(w) - 1, "items": F.row_number().over(Window.partitionBy("video_id", "conv_id").orderBy("turn", "role")) - 1, "last": F.count("*").over(Window.partitionBy("video_id")) - 1})
    own = turns.select("video_id", F.col("conv_id").cast("int").bitwiseAND(1).alias("page"), "items", "seen", (F.col("seen") == F.col("last")).alias("lookahead"))

    def run(parts):
        for part in parts:
            out = []
            for v, page, items, seen, ahead in part.itertuples(index=False):
                raw = screen_bytes(kind, *((0, 0, seen) if kind == "sheet" else (page, min(items, 7), 0)))
                out += [(v, 6 * seen + j, float(6 * seen + j), 60, 100, raw, ahead) for j in range(6)]
            yield pd.DataFrame(out, columns=["video_id", "frame_index", "t", "h", "w", "gray", "lookahead"])

    return own.mapInPandas(run, "video_id string, frame_index long, t double, h int, w int, gray binary, lookahead boolean")


#: The same adapters as common table expressions for DuckDB.
SQL = {
    "speech": "speech AS (SELECT conv_id, turn AS speech_id, text, CAST(start_us AS BIGINT) AS start_us, CAST(start_us + length(text) * 60000 AS BIGINT) AS end_us FROM (SELECT *, coalesce(sum(length(text) * 60000 + turn % 3 * 500000) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_us FROM conversations))",
    "ranges": "ranges AS (SELECT conv_id, 0 AS range_start_us, max(end_us) AS range_end_us FROM speech GROUP BY 1)",
    "frames": "frames AS (SELECT user_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_id, event_id AS frame_id, epoch_us(ts) % 200000000 AS t_us FROM events)",
    "signal": "signal AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index, epoch_us(ts) AS t_us, value / 500.0 AS change_score, event_type AS label FROM events)",
    "pixels": "pixels AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_index, list_transform(embedding, lambda x: CAST(least(255, greatest(0, round_even((CAST(x AS DOUBLE) + 1) * 127.5, 0))) AS INTEGER)) AS gray, embedding FROM embeddings)",
    "lines": "lines AS (SELECT doc_id, line, text, line / n AS y, least(1.0, length(text) / 80.0) AS width, length(text) % 20 / 20.0 AS confidence FROM (SELECT doc_id, len(l) AS n, unnest(l) AS text, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in names.split()) + " " + body
