"""Still images: a PNG reader and writer, frame folders as a source, letterboxes and contact sheets.

Frames are rows (video_id, frame_index, t, h, w, channels, pixels); pixels are rows of RGB or gray
bytes. There is no JPEG encoder here, so thumbnails are PNG files as well.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as px

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
FRAME = "video_id string, frame_index long, h int, w int, channels int, pixels binary"


def png(image: np.ndarray) -> bytes:
    """A gray (h, w) or RGB (h, w, 3) image of bytes as a PNG file."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or (image.ndim == 3 and image.shape[2] != 3) or not image.size:
        raise ValueError("an image is bytes of shape (h, w) or (h, w, 3)")
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + image[0].size), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """The gray or RGB pixels of a PNG file of 8 bits a channel, not interlaced; alpha is dropped."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, head, body = 8, None, b""
    while at + 8 <= len(raw):
        n, name = struct.unpack(">I4s", raw[at : at + 8])
        part = raw[at + 8 : at + 8 + n]
        if len(part) < n or raw[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(name + part)):
            raise ValueError("a damaged PNG file")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("a PNG file of a kind that is not read here")
    w, h, _, kind = head[:4]
    k = CHANNELS[kind]
    try:
        lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * k)
    except (zlib.error, ValueError) as e:
        raise ValueError("a damaged PNG file") from e
    out = np.zeros((h, w, k), np.uint8)
    above = np.zeros((w, k), np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(lines[y, 0]), lines[y, 1:].reshape(w, k), above)
    return out[..., 0] if k < 3 else out[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("a damaged PNG file")
    out, left, corner = np.zeros_like(line), np.zeros(line.shape[1], np.int16), np.zeros(line.shape[1], np.int16)
    for x in range(len(line)):
        up = above[x].astype(np.int16)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[x] = (line[x] + guess) & 255
        left, corner = out[x].astype(np.int16), up
    return out


def image_of(h: int, w: int, channels: int, pixels: bytes) -> np.ndarray:
    flat = np.frombuffer(pixels, np.uint8)
    return flat.reshape(h, w) if channels == 1 else flat.reshape(h, w, channels)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames below path/VIDEO/NUMBER.png as rows; a file that cannot be decoded aborts the scan."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path))


def decoded(files: DataFrame) -> DataFrame:
    """Frames of files(path, content), a table or a stream."""
    files = files.select("path", "content")
    name = F.regexp_extract("path", r"([^/]+)/0*(\d+)\.png$", 1), F.regexp_extract("path", r"([^/]+)/0*(\d+)\.png$", 2).cast("long")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for v, i, raw in zip(part["video_id"], part["frame_index"], part["content"]):
                img = read_png(bytes(raw))
                out.append((v, i, img.shape[0], img.shape[1], 1 if img.ndim == 2 else 3, img.tobytes()))
            yield pd.DataFrame(out, columns=["video_id", "frame_index", "h", "w", "channels", "pixels"])

    return files.select(name[0].alias("video_id"), name[1].alias("frame_index"), "content").where("video_id <> '' and frame_index is not null").mapInPandas(run, FRAME)


def scan(frames: DataFrame, metadata: DataFrame, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Frames from the one at round(start * fps) up to `end` seconds, with their nominal times.

    metadata(video_id, fps, frame_count). A frame that the range should have and has not aborts.
    """
    until = F.lit(end).cast("double") if end is not None else F.col("frame_count") / F.col("fps")
    # the bounded grid of frames that there should be
    want = metadata.withColumn("_last", F.least(F.floor((until + 1e-9) * F.col("fps")), F.col("frame_count") - 1).cast("long")).withColumn("_first", F.rint(F.lit(start) * F.col("fps")).cast("long")).where("_last >= _first")
    grid = want.select("video_id", "fps", F.explode(F.sequence("_first", "_last")).alias("frame_index"))
    got = grid.join(frames, ["video_id", "frame_index"], "left")
    whole = got.where(F.when(F.col("pixels").isNull(), F.raise_error(F.lit("a frame cannot be read")).cast("boolean")).otherwise(True))
    return whole.withColumn("t", F.col("frame_index") / F.col("fps")).select("video_id", "frame_index", "t", "h", "w", "channels", "pixels")


def clock(times: Sequence[float], fps: float, rate: float, start: float) -> list[int]:
    """Which of a source's frame times a running clock takes: a frame that is no more than half a
    source frame early, whereupon the clock moves on by 1 / rate, and beyond the frame's time.

    Grid points are numbers, so that no steps add up: a frame reaches the points up to its time and
    half a frame, and has passed those up to its time.
    """
    out, due = [], 0
    for i, t in enumerate(times):
        if np.floor((t + 0.5 / fps - start) * rate + 1e-9) >= due:
            out.append(i)
            due = max(due + 1, int(np.floor((t - start) * rate + 1e-9)) + 1)
    return out


def sampled(frames: DataFrame, metadata: DataFrame, rate: float, start: float = 0.0) -> DataFrame:
    """frames(video_id, frame_index, t, ...) that the clock takes. Only times are gathered by source."""
    times = frames.join(metadata.select("video_id", "fps"), "video_id").select("video_id", "frame_index", "t", "fps")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        return part.iloc[clock(part["t"].tolist(), float(part["fps"].iloc[0]), rate, start)][["video_id", "frame_index"]] if len(part) else part[["video_id", "frame_index"]]

    return frames.join(times.groupBy("video_id").applyInPandas(run, "video_id string, frame_index long"), ["video_id", "frame_index"])


def frames_at(probes: DataFrame, frames: DataFrame, metadata: DataFrame) -> DataFrame:
    """probes(video_id, t, ...) with the frame at round(t * fps), where t is kept within the source."""
    own = probes.join(metadata.select("video_id", "fps", "frame_count"), "video_id")
    at = F.greatest(F.lit(0.0), F.least(F.col("t"), (F.col("frame_count") - 1) / F.col("fps")))
    own = own.withColumn("frame_index", F.rint(at * F.col("fps")).cast("long")).drop("fps", "frame_count")
    return own.join(frames.select("video_id", "frame_index", "h", "w", "channels", "pixels"), ["video_id", "frame_index"])


def content_cuts(samples: DataFrame, keys: Sequence[str], threshold: float = 27.0 / 255, least_us: int = 1_000_000) -> DataFrame:
    """Scene starts by content: the first sample, and samples whose mean pixel change is above the
    threshold, at least `least_us` after the start before them. samples(keys, sample_index, t_us, pixel_delta)."""
    from ..operators import sequences

    first = F.row_number().over(Window.partitionBy(*keys).orderBy("t_us", "sample_index")) == 1
    marks = samples.where(F.col("t_us").isNotNull()).withColumn("_first", first).where(F.col("_first") | (F.col("pixel_delta") > threshold))
    return sequences.greedy_gap(marks, keys, "t_us", least_us, "sample_index").withColumnRenamed("t_us", "cut_us")


def to_gray(frames: DataFrame, width: int) -> DataFrame:
    """frames with h, w and gray in place of their pixels, no wider than `width`."""
    rest = [c for c in frames.columns if c not in ("h", "w", "channels", "pixels")]
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            small = [px.resize_gray(image_of(*x), width) for x in zip(part["h"], part["w"], part["channels"], part["pixels"])]
            yield part[rest].assign(h=[s.shape[0] for s in small], w=[s.shape[1] for s in small], gray=[s.tobytes() for s in small])

    return frames.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "h int, w int, gray binary"]))


def write_images(frames: DataFrame, folder: str, prefix: str) -> DataFrame:
    """Write each frame as folder/PREFIX_MILLISECONDS.png (t in seconds); rows (keys..., image_path, image_sha256).

    Executors write into a folder that driver and executors share. A file gets its name once it is whole.
    """
    import hashlib

    rest = [c for c in frames.columns if c not in ("h", "w", "channels", "pixels")]
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        for part in parts:
            paths, hashes = [], []
            for t, v, *x in zip(part["t"], part["video_id"], part["h"], part["w"], part["channels"], part["pixels"]):
                body = png(image_of(*x))
                name = f"{v}/{prefix}_{round(t * 1000):012d}.png"
                os.makedirs(f"{folder}/{v}", exist_ok=True)
                hidden = f"{folder}/{v}/.{prefix}_{round(t * 1000):012d}.{os.getpid()}"
                with open(hidden, "wb") as f:
                    f.write(body)
                os.replace(hidden, f"{folder}/{name}")
                paths.append(name)
                hashes.append(hashlib.sha256(body).hexdigest())
            yield part[rest].assign(image_path=paths, image_sha256=hashes)

    return frames.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "image_path string, image_sha256 string"]))


# ---- sheets ------------------------------------------------------------------------------

#: A font of 3 x 5 cells for times and labels, a row of three bits each.
GLYPHS = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", ":": "02020", ".": "00002", "-": "00700"}


def label(text: str, scale: int = 2) -> np.ndarray:
    """The digits and marks of a text as a white-on-black image."""
    cells = []
    for c in text:
        rows = [int(x) for x in GLYPHS.get(c, "00000")]
        cells.append(np.array([[r >> k & 1 for k in (2, 1, 0)] + [0] for r in rows], np.uint8))
    whole = np.concatenate(cells, 1) if cells else np.zeros((5, 1), np.uint8)
    return np.kron(whole * 255, np.ones((scale, scale), np.uint8))


def letterbox(image: np.ndarray, width: int = 360, height: int = 203) -> np.ndarray:
    """The image scaled to fit and centred on black."""
    rgb = np.repeat(image[..., None], 3, 2) if image.ndim == 2 else image
    ratio = min(width / rgb.shape[1], height / rgb.shape[0])
    w, h = max(1, round(rgb.shape[1] * ratio)), max(1, round(rgb.shape[0] * ratio))
    rows, cols = (np.arange(n) * m // n for n, m in ((h, rgb.shape[0]), (w, rgb.shape[1])))
    out = np.zeros((height, width, 3), np.uint8)
    y, x = (height - h) // 2, (width - w) // 2
    out[y : y + h, x : x + w] = rgb[np.ix_(rows, cols)]
    return out


def contact_sheet(tiles: Sequence[tuple[str, np.ndarray]], columns: int = 4, width: int = 360, height: int = 203, band: int = 42) -> np.ndarray:
    """Letterboxed images in rows of four, each above a band with its label."""
    if not tiles:
        raise ValueError("a contact sheet needs an image")
    lines = -(-len(tiles) // columns)
    sheet = np.zeros((lines * (height + band), columns * width, 3), np.uint8)
    for k, (text, image) in enumerate(tiles):
        y, x = k // columns * (height + band), k % columns * width
        sheet[y : y + height, x : x + width] = letterbox(image, width, height)
        name = label(text)[: band - 12, : width - 16]
        sheet[y + height + 12 : y + height + 12 + name.shape[0], x + 8 : x + 8 + name.shape[1]] = name[..., None]
    return sheet
