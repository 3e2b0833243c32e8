"""Media sources: path rules, fingerprints, metadata, WAV headers and frame grids."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of video files.
SUFFIXES = (".mp4", ".mov", ".mkv", ".m4v", ".webm")


def video_path_ok(path: Column) -> Column:
    """A finished video file by its name; case does not matter."""
    low = F.lower(path)
    return ~low.endswith(".part") & F.regexp_extract(low, r"(\.[^./]+)$", 1).isin(*SUFFIXES)


def fourcc(code: Column) -> Column:
    """The four characters of a codec number, lowest byte first."""
    return F.concat(*[F.char(F.shiftright(code, 8 * i).bitwiseAND(255)) for i in range(4)])


def metadata(df: DataFrame) -> DataFrame:
    """fps, frame_count, width, height and codec number, checked, with nominal duration and codec name."""
    ok = (F.col("fps") > 0) & (F.col("frame_count") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    checked = df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a video has no frames, size or rate")).cast("boolean")))
    return checked.withColumns({"duration_seconds": F.col("frame_count") / F.col("fps"), "codec": fourcc(F.col("codec"))})


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of files below a path. The content of one file is one value of up to 2 GB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """One row: file count, bytes, and the digest over path, size and hash of all files in path order."""
    own = files.withColumn("name", F.regexp_replace("path", f"^.*?{root}/?", ""))
    lines = F.array_sort(F.collect_list(F.concat("name", F.lit("\0"), F.col("size_bytes").cast("string"), F.lit("\0"), "sha256", F.lit("\n"))))
    return own.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sha2(F.array_join(lines, ""), 256).alias("sha256"))


def clamp_range(start: Column, length: Column, duration: Column) -> Column:
    """struct(start, end) of a requested range within a source; a start outside aborts."""
    ok = (start >= 0) & (start < duration)
    return F.when(ok, F.struct(start.alias("start"), F.least(duration, start + length).alias("end"))).otherwise(F.raise_error(F.lit("the range starts outside the source")).cast("struct<start:double,end:double>"))


def wav_header(raw: bytes) -> tuple[int, int, int, float]:
    """Channels, rate, bits and seconds of a PCM file; raises ValueError for anything else."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, kind, size = 12, None, None
    while at + 8 <= len(raw) and size is None:
        name, n = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
        elif name == b"data":
            size = min(n, len(raw) - at - 8)
        at += 8 + n + n % 2
    if kind is None or not size or kind[0] != 1:
        raise ValueError("no PCM data")
    return kind[1], kind[2], kind[5], size / (kind[1] * kind[2] * kind[5] / 8)


def audio_checks(files: DataFrame, slack: float = 1.0) -> DataFrame:
    """files(path, content, requested_seconds) as (path, seconds, ok, error): mono, 16 kHz, 16 bits, about as long as asked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, raw, want in zip(part["path"], part["content"], part["requested_seconds"]):
                try:
                    channels, rate, bits, seconds = wav_header(bytes(raw))
                    bad = None if (channels, rate, bits) == (1, 16000, 16) else "not mono 16 kHz 16 bit"
                    bad = bad or (None if abs(seconds - want) <= slack else "not as long as asked")
                    out.append((path, seconds, bad is None, bad))
                except ValueError as e:
                    out.append((path, None, False, str(e)))
            yield pd.DataFrame(out, columns=["path", "seconds", "ok", "error"])

    return files.select("path", "content", "requested_seconds").mapInPandas(run, "path string, seconds double, ok boolean, error string")


def coarse_grid(metadata: DataFrame, interval: float, most: int, start: float = 0.0, length: float | None = None) -> DataFrame:
    """(video_id, position, t): probes every `interval` seconds of the range, with a last one near the
    end where the grid leaves a gap there. A source that would have more than `most` aborts."""
    if interval <= 0 or most < 1:
        raise ValueError("an interval is positive, and so is the number of frames")
    span = clamp_range(F.lit(start), F.lit(float("inf") if length is None else length), F.col("frame_count") / F.col("fps"))
    own = metadata.select("video_id", "fps", span.alias("r")).select("video_id", "fps", "r.start", "r.end")
    n = F.least(F.greatest(F.ceil((F.col("end") - 1e-6 - F.col("start")) / interval), F.lit(0)), F.lit(most)).cast("int")
    grid = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("start") + k * interval)).otherwise(F.array().cast("array<double>"))
    short = (n == 0) | (F.get(grid, n - 1) < F.col("end") - min(0.25 * interval, 2.0))
    whole = F.concat(grid, F.when(short, F.array(F.greatest(F.col("start"), F.col("end") - 1.0 / F.col("fps")))).otherwise(F.array().cast("array<double>")))
    own = own.withColumn("g", whole).where(F.when(F.size("g") > most, F.raise_error(F.lit("more frames than allowed; take a longer interval")).cast("boolean")).otherwise(True))
    return own.select("video_id", F.posexplode("g").alias("position", "t"))
