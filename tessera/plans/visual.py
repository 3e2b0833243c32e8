"""The visual stage: from analysis frames to selected evidence frames, with its ledgers.

Frames are rows (video_id, frame_index, t, h, w, gray). Signals are made once and read by every
strategy; selectors that need pixels get them by segment, all others work on scalars. What a run
found are tables; each of them is written below the run's folder, with one manifest.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions import textual
from ..operators import annotations, joins, routing, selectors
from ..operators.require import Violation, require_none
from ..sources import images, ledgers, media

KEYS = ["video_id"]
STRATEGIES = ("uniform", "content", "adaptive", "settled", "hybrid", "boundary_terminal", "table_viewport", "table_focus", "presentation_states", "routed")
#: Strategies whose states are distinct by themselves and are not de-duplicated.
DISTINCT = {"boundary_terminal", "table_viewport", "table_focus", "presentation_states", "routed"}
#: Seconds of look-ahead by strategy.
LOOKAHEAD = {"boundary_terminal": 15.0, "table_viewport": 8.0, "table_focus": 8.0, "presentation_states": 6.0, "routed": 15.0}
LAYOUT = ("mean_luma", "dark_ratio", "bright_ratio", "edge_density", "horizontal_line_ratio", "vertical_line_ratio")
SIGNALS = "phash long, sharpness double, pixel_delta double, edge_delta double, phash_delta int, ssim_previous double, change_score double, " + ", ".join(f"{c} double" for c in LAYOUT)


@dataclass
class Parameters:
    """What a run was asked for; checked before any job starts."""

    start: float = 0.0
    duration: float = 720.0
    strategies: Sequence[str] = ("uniform", "content", "adaptive", "settled", "hybrid")
    rate: float = 2.0
    width: int = 320
    interval: float = 10.0
    most: int = 80
    content: float = 27.0
    adaptive: float = 3.0
    allow_long: bool = False
    lookahead: dict[str, float] = field(default_factory=lambda: dict(LOOKAHEAD))

    def __post_init__(self) -> None:
        unknown = sorted(set(self.strategies) - set(STRATEGIES))
        slow = {"routed", "presentation_states"} & set(self.strategies) and self.rate < 1
        for bad, message in (
            (unknown or not self.strategies, f"unknown strategies: {', '.join(unknown) or 'none'}"),
            (not 0 <= self.start < float("inf") or not 0 < self.duration < float("inf"), "a range starts at 0 or later and is not empty"),
            (self.duration > 720 and not self.allow_long, "ranges above 720 seconds must be allowed explicitly"),
            (not 0 < self.rate <= 4 or slow, "the analysis rate is above 0 and at most 4; slides need 1 at least"),
            (not 160 <= self.width <= 1280, "the analysis width is 160 to 1280"),
            (self.interval <= 0 or self.most < 1, "the interval and the number of frames are positive"),
            (self.content <= 0 or self.adaptive <= 0, "thresholds are positive"),
            (any(not 0 < v <= 60 for v in self.lookahead.values()), "look-aheads are above 0 and at most 60 seconds"),
        ):
            if bad:
                raise ValueError(message)

    @property
    def ahead(self) -> float:
        """Seconds beyond the range that the strategies have to see."""
        return max((self.lookahead[s] for s in self.strategies if s in self.lookahead), default=0.0)


def build_samples(frames: DataFrame) -> DataFrame:
    """Frames in order with hash, sharpness, layout and how each differs from the one before it.

    The first of a source differs from nothing: all differences 0, similarity 1.
    """
    w = Window.partitionBy(*KEYS).orderBy("t", "frame_index")
    own = frames.select(*KEYS, "frame_index", "t", "h", "w", "gray").withColumns({"sample_index": (F.row_number().over(w) - 1).cast("long"), "_before": F.lag("gray").over(w), "_size": F.lag(F.struct("h", "w")).over(w)})
    own = own.select(*KEYS, "sample_index", "frame_index", "t", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "h", "w", "gray", "_before", F.col("_size.h").alias("_h"), F.col("_size.w").alias("_w"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for h, w, gray, before, bh, bw in zip(part["h"], part["w"], part["gray"], part["_before"], part["_h"], part["_w"]):
                img = np.frombuffer(gray, np.uint8).reshape(h, w)
                d = {"pixel_delta": 0.0, "edge_delta": 0.0, "phash_delta": 0, "ssim": 1.0, "score": 0.0} if before is None else px.comparison(np.frombuffer(before, np.uint8).reshape(int(bh), int(bw)), img)
                bits = px.perceptual_hash(img)
                rows.append((bits - (1 << 64) if bits >> 63 else bits, px.sharpness(img), d["pixel_delta"], d["edge_delta"], d["phash_delta"], d["ssim"], d["score"], *(px.layout(img)[c] for c in LAYOUT)))
            names = [x.split()[0] for x in SIGNALS.split(", ")]
            yield pd.concat([part.drop(columns=["_before", "_h", "_w"]).reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    rest = [c for c in own.columns if not c.startswith("_")]
    return own.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", " + SIGNALS)


def _clips(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """All samples of each source as one clip; those after the range are its look-ahead."""
    return samples.join(ranges, KEYS).select(*KEYS, "sample_index", "t", "h", "w", "gray", (F.col("t") > F.col("range_end") + 1e-9).alias("lookahead"))


def candidates(samples: DataFrame, cuts: DataFrame, ranges: DataFrame, p: Parameters) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Raw candidates of each strategy, and the segments of the route plan if one was needed.

    samples as build_samples() makes them, look-ahead included; cuts(video_id, cut_us, reason);
    ranges(video_id, range_start, range_end) in seconds.
    """
    wanted = set(p.strategies) | ({"uniform", "content", "adaptive", "settled"} if "hybrid" in p.strategies else set())
    inside = samples.join(ranges, KEYS).where(F.col("t") <= F.col("range_end") + 1e-9).drop("range_start", "range_end")
    scalars = inside.drop("gray", "h", "w")
    columns = [*KEYS, "sample_index", "t_us", "score", "reasons"]
    out: dict[str, DataFrame] = {}
    if "uniform" in wanted:
        out["uniform"] = selectors.uniform(scalars, KEYS, round(p.interval * 1e6))
    if "content" in wanted:
        out["content"] = selectors.content(scalars, cuts.where("reason = 'scenedetect_content'"), KEYS)
    if "adaptive" in wanted:  # cuts by the adaptive detector, and peaks of the samples themselves
        scenes = selectors.content(scalars, cuts.where("reason = 'scenedetect_adaptive'"), KEYS, reason="scenedetect_adaptive")
        peaks = selectors.adaptive(scalars, KEYS, radius=max(1, round(3 * p.rate)), k=max(1, round(p.rate)), ratio=p.adaptive)
        out["adaptive"] = scenes.select(*columns).unionByName(peaks.select(*columns))
    clips = None
    for name in selectors.STRATEGIES:
        if name in wanted:
            clips = _clips(samples, ranges) if clips is None else clips
            found = selectors.select_clips(clips, KEYS, name, p.rate)
            out[name] = found.select(*KEYS, "sample_index", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "score", "reasons")
    segments = None
    if "routed" in wanted:
        segments = plan(scalars, p.rate)
        ahead = {k: (s, round(p.lookahead[s] * 1e6)) for k, (s, _) in routing.SELECTORS.items()}
        sliced = joins.dispatch(segments, samples.drop(*LAYOUT), KEYS, ahead)
        out["routed"] = selectors.routed(sliced, KEYS, p.rate)
    if "hybrid" in wanted:
        for s in ("uniform", "content", "adaptive", "settled"):
            out[s] = out[s].persist()  # a few rows a source, read by themselves and by hybrid
        out["hybrid"] = selectors.hybrid([out[s] for s in ("uniform", "content", "adaptive", "settled")], KEYS)
    return {s: out[s] for s in p.strategies}, segments


def plan(scalars: DataFrame, rate: float) -> DataFrame:
    """The route plan of samples with layout features, one row for each segment; broken invariants raise."""
    decided = routing.smooth(routing.classify(scalars), KEYS, ["sample_index"], rate)
    segments = routing.content_segments(decided, KEYS, "sample_index", "t_us")
    require_none(routing.plan_violations(decided, segments, KEYS, "sample_index").where("violations > 0"), "the route plan breaks an invariant")
    return segments


def metrics(ledger: DataFrame, ranges: DataFrame) -> DataFrame:
    """(video_id, strategy, raw_candidates, selected_frames, candidate_frames_per_minute, duplicate_drop_ratio, capped_frames)."""
    n = lambda s: F.count_if(F.col("status") == s)
    own = ledger.groupBy(*KEYS, "strategy").agg(F.count("*").alias("raw_candidates"), n("selected").alias("selected_frames"), n("duplicate").alias("_d"), n("capped").alias("capped_frames")).join(ranges, KEYS)
    return own.select(
        *KEYS, "strategy", "raw_candidates", "selected_frames",
        (F.col("selected_frames") / F.greatest((F.col("range_end") - F.col("range_start")) / 60, F.lit(1e-9))).alias("candidate_frames_per_minute"),
        (F.col("_d") / F.col("raw_candidates")).alias("duplicate_drop_ratio"), "capped_frames",
    )


def counts_by_segment(ledger: DataFrame, segments: DataFrame) -> DataFrame:
    """segments with how many selected frames each has, 0 included."""
    n = ledger.where("strategy = 'routed' and status = 'selected'").groupBy(*KEYS, "segment_id").agg(F.count("*").alias("candidates"))
    return segments.join(n, [*KEYS, "segment_id"], "left").fillna(0, ["candidates"])


def needed_images(ledger: DataFrame) -> DataFrame:
    """(video_id, sample_index, purpose): samples that need a thumbnail, and those that need an evidence frame, each once."""
    thumbs = ledger.select(*KEYS, "sample_index", F.lit("thumbnail").alias("purpose"))
    return thumbs.union(ledger.where("status = 'selected'").select(*KEYS, "sample_index", F.lit("evidence").alias("purpose"))).distinct()


def run_visual(samples: DataFrame, cuts: DataFrame, ranges: DataFrame, p: Parameters) -> dict[str, DataFrame]:
    """The stage's tables: ledger (raw candidates with their status), metrics, images, and segments of a routed run.

    A routed run with more frames than allowed fails, so that no segment's evidence is dropped in silence.
    """
    raw, segments = candidates(samples, cuts, ranges, p)
    if "routed" in raw:
        many = raw["routed"].groupBy(*KEYS).count().where(F.col("count") > p.most)
        require_none(many, "routed selection has more frames than allowed; allow more")
    parts = []
    for name, found in raw.items():
        done = selectors.finalize(found, samples, KEYS, p.most, unique=name not in DISTINCT)
        parts.append(done.withColumn("strategy", F.lit(name)))
    ledger = parts[0]
    for x in parts[1:]:
        ledger = ledger.unionByName(x)
    out = {"ledger": ledger, "metrics": metrics(ledger, ranges), "images": needed_images(ledger)}
    if segments is not None:
        out["segments"] = counts_by_segment(ledger, segments)
    return out


def environment() -> dict[str, str]:
    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": np.__version__}


# ---- drivers over a source's frames ------------------------------------------------------

@dataclass
class Source:
    """Frames of videos as rows, with their metadata (video_id, fps, frame_count, width, height, fingerprint)."""

    frames: DataFrame
    metadata: DataFrame

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str) -> Source:
        """A folder with sources.json, a list of metadata, and a folder of numbered PNG files for each video."""
        docs = json.loads(Path(path, "sources.json").read_text(encoding="utf-8"))
        kinds = "video_id string, fps double, frame_count long, width int, height int, fingerprint string"
        meta = spark.createDataFrame([tuple(d[k.split()[0]] for k in kinds.split(", ")) for d in docs], kinds)
        ok = media.metadata(meta.withColumn("codec", F.lit(0)))
        return cls(images.read_frames(spark, path), ok.select(*meta.columns))


def range_of(source: Source, start: float, duration: float | None) -> DataFrame:
    length = F.lit(float("inf") if duration is None else duration)
    span = media.clamp_range(F.lit(float(start)), length, F.col("frame_count") / F.col("fps"))
    return source.metadata.select("video_id", span.alias("r")).select("video_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


def analysis_samples(source: Source, p: Parameters) -> DataFrame:
    """Signals of the range and its look-ahead at the analysis rate."""
    whole = images.scan(source.frames, source.metadata, p.start, p.start + p.duration + p.ahead)
    return build_samples(images.to_gray(images.sampled(whole, source.metadata, p.rate, p.start), p.width))


def scene_cuts(samples: DataFrame, p: Parameters) -> DataFrame:
    """Cuts of this engine's own content detector; detectors of third parties are not part of it."""
    cuts = images.content_cuts(samples, KEYS, p.content / 255)
    return cuts.select(*KEYS, "cut_us", F.lit("scenedetect_content").alias("reason"))


def benchmark(spark: SparkSession, source: Source, folder: str, p: Parameters, cut: Callable[[DataFrame, str], DataFrame], notes: dict | None = None) -> dict:
    """Run the stage and publish its tables, images and manifest below folder, which must not exist.

    cut(df, name) writes a step and reads it back; signals are read by every strategy.
    """
    if Path(folder).exists():
        raise Violation(f"{folder} exists")
    samples = cut(analysis_samples(source, p), "samples")
    ranges = range_of(source, p.start, p.duration)
    tables = {k: cut(v, k) for k, v in run_visual(samples, scene_cuts(samples, p), ranges, p).items()}
    tables["signals"] = samples.drop("gray", "h", "w")
    evidence = tables["images"].where("purpose = 'evidence'").join(samples.select(*KEYS, "sample_index", "frame_index", "t"), [*KEYS, "sample_index"])
    whole = evidence.join(source.frames, [*KEYS, "frame_index"]).join(source.metadata.select("video_id", "width", "height"), KEYS)
    sized = whole.where(F.when((F.col("w") != F.col("width")) | (F.col("h") != F.col("height")), F.raise_error(F.lit("an evidence frame has not the size of its source")).cast("boolean")).otherwise(True))
    tables["evidence"] = cut(images.write_images(sized.select(*KEYS, "sample_index", "t", "h", "w", "channels", "pixels"), f"{folder}/frames", "frame"), "evidence")
    small = tables["images"].where("purpose = 'thumbnail'").join(samples.select(*KEYS, "sample_index", "t", "h", "w", F.lit(1).alias("channels"), F.col("gray").alias("pixels")), [*KEYS, "sample_index"]).drop("purpose")
    tables["thumbnails"] = cut(images.write_images(small, f"{folder}/thumbs", "thumb"), "thumbnails")
    for name, df in tables.items():
        if name != "images":
            textual.public(df).write.mode("errorifexists").parquet(f"{folder}/{name}")
    spans = {r.video_id: {"start_seconds": r.range_start, "end_seconds": r.range_end, "duration_seconds": r.range_end - r.range_start} for r in ranges.collect()}  # a row a source
    manifest = {
        "kind": "candidate_frame_benchmark", "schema_version": 1, "sources": [r.asDict() for r in source.metadata.collect()], "ranges": spans,
        "parameters": {"strategies": list(p.strategies), "analysis_fps": p.rate, "analysis_width": p.width, "uniform_interval": p.interval, "maximum_frames": p.most, "lookahead_seconds": p.ahead},
        "environment": environment(), "timestamp_accuracy": "nominal frame rate", **(notes or {}),
    }
    ledgers.replace(Path(folder, "manifest.json"), manifest)
    return manifest


def coarse_scan(source: Source, folder: str, interval: float = 60.0, most: int = 120, start: float = 0.0, duration: float | None = None) -> dict:
    """A sparse timeline of each source: images, a contact sheet and a manifest."""
    if Path(folder).exists():
        raise Violation(f"{folder} exists")
    probes = media.coarse_grid(source.metadata, interval, most, start, duration)
    found = images.frames_at(probes, source.frames, source.metadata)
    rows = images.write_images(found.select("video_id", "position", "t", "h", "w", "channels", "pixels"), f"{folder}/frames", "scan").orderBy("video_id", "position").collect()  # at most `most` a source
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.video_id, []).append(r)
    for v, own in by.items():
        tiles = [(_clock(r.t), images.read_png(Path(folder, "frames", r.image_path).read_bytes())) for r in own]
        Path(folder, f"contact-sheet-{v}.png").write_bytes(images.png(images.contact_sheet(tiles)))
    manifest = {"kind": "coarse_scan", "sources": [r.asDict() for r in source.metadata.collect()], "interval_seconds": interval, "frame_count": len(rows), "frames": [{"video_id": r.video_id, "timestamp": r.t, "image_path": f"frames/{r.image_path}", "score": 0.1, "reasons": ["coarse_scan"]} for r in rows], "environment": environment()}
    ledgers.replace(Path(folder, "scan.json"), manifest)
    return manifest


def curate(source: Source, folder: str, video: str, doc: dict) -> dict:
    """Export the points of a human review as source-size evidence frames with their scores."""
    if Path(folder).exists():
        raise Violation(f"{folder} exists")
    meta = source.metadata.where(F.col("video_id") == video).first()
    if meta is None:
        raise Violation(f"no source {video}")
    segment = doc.get("segment") or {}
    duration = meta.frame_count / meta.fps
    start = annotations.parse_seconds(segment.get("start", -1)) if segment else 0.0
    end = min(duration, start + annotations.parse_seconds(segment.get("duration", 0))) if segment else 0.0
    points = annotations.curated_points(doc, start, end)
    annotations.validate(doc, video, start, end - start, meta.fingerprint)
    score = annotations.evaluate_selection(doc, [t for t, _ in points])
    spark = source.metadata.sparkSession
    probes = spark.createDataFrame([(video, i, t, kind) for i, (t, kind) in enumerate(points)], "video_id string, sample_index long, t double, kind string")
    found = images.frames_at(probes, source.frames, source.metadata)
    bad = F.raise_error(F.lit("an evidence frame has not the size of its source")).cast("boolean")
    sized = found.where(F.when((F.col("w") != meta.width) | (F.col("h") != meta.height), bad).otherwise(True))
    rows = images.write_images(sized.select("video_id", "sample_index", "t", "kind", "h", "w", "channels", "pixels"), f"{folder}/frames", "frame").orderBy("sample_index").collect()
    body = json.dumps(doc, sort_keys=True, default=str).encode()
    manifest = {
        "kind": "human_curated_frame_export", "source": meta.asDict(), "range": {"start_seconds": start, "end_seconds": end, "duration_seconds": end - start},
        "annotation_sha256": hashlib.sha256(body).hexdigest(), "review_coverage": (doc.get("review") or {}).get("coverage", "positive_only"), "ground_truth_status": score["ground_truth"],
        "source_segment_recall_assessable": bool((score["selection_quality"] or {}).get("source_segment_recall_assessable")),
        "selected": [{"sample_index": r.sample_index, "timestamp": r.t, "score": 1.0, "reasons": ["human_reviewed", r.kind], "image_path": f"frames/{r.image_path}", "image_sha256": r.image_sha256} for r in rows],
        "metrics": score,
    }
    ledgers.replace(Path(folder, "manifest.json"), manifest)
    return manifest


def evaluate_run(spark: SparkSession, folder: str, video: str, doc: dict, sha256: dict[str, str] | None = None) -> dict:
    """Score a published run against annotations without reading a frame."""
    manifest = json.loads(Path(folder, "manifest.json").read_text(encoding="utf-8"))
    if manifest.get("kind") != "candidate_frame_benchmark":
        raise Violation("the folder holds no benchmark run")
    source = next((s for s in manifest["sources"] if s["video_id"] == video), None)
    if source is None:
        raise Violation(f"the run has no source {video}")
    span = manifest["ranges"][video]
    annotations.validate(doc, video, span["start_seconds"], span["duration_seconds"], source["fingerprint"])
    ledger = spark.read.parquet(f"{folder}/ledger").where(F.col("video_id") == video)
    counts = {r.strategy: r for r in ledger.groupBy("strategy").agg(F.count("*").alias("raw"), F.count_if(F.col("status") == "duplicate").alias("dropped"), F.count_if(F.col("status") == "capped").alias("capped")).collect()}
    out = {}
    for name in manifest["parameters"]["strategies"]:
        times = [r.t_us / 1e6 for r in ledger.where((F.col("strategy") == name) & (F.col("status") == "selected")).select("t_us").orderBy("t_us").collect()]  # at most the cap
        c = counts.get(name)
        out[name] = {"selected_frames": len(times), "raw_candidates": c.raw if c else 0, "duplicate_dropped_count": c.dropped if c else 0, "capped_count": c.capped if c else 0, "annotations": annotations.evaluate_selection(doc, times, name, (sha256 or {}).get(name))}
    return {"kind": "candidate_frame_evaluation", "source_fingerprint": source["fingerprint"], "range": span, "annotation_status": doc.get("review_status", "unspecified"), "strategies": out}


def _clock(t: float) -> str:
    ms = round(t * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
