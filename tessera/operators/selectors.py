"""Frame selectors. Time-only ones are DataFrame operators; those that compare pixels with a moving
anchor (see automata) run over one segment's frames in a group, a short, bounded clip.

Candidate columns: sample_index, t_us (or t in seconds), score, reasons, segment_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from . import automata, joins, sequences

CANDIDATE = "sample_index long, t double, score double, reasons array<string>"
STRATEGIES = automata.STRATEGIES


# ---- DataFrame selectors -----------------------------------------------------------------

def uniform(samples: DataFrame, keys: Sequence[str], interval_us: int) -> DataFrame:
    """The nearest sample to each grid point; the last sample too if the grid ends a quarter interval short."""
    ends = samples.groupBy(*keys).agg(F.min("t_us").alias("_a"), F.max("t_us").alias("_b"))
    grid = F.sequence("_a", "_b", F.lit(interval_us))
    tail = F.when(F.element_at(grid, -1) < F.col("_b") - interval_us // 4, F.array(F.col("_b"))).otherwise(F.array().cast("array<bigint>"))
    probes = ends.select(*keys, F.explode(F.concat(grid, tail)).alias("_probe"))
    got = joins.nearest(probes, samples.select(*keys, "t_us", "sample_index"), keys, "_probe", "t_us", ["sample_index"])
    return got.select(*keys, "sample_index", "t_us", F.lit(0.10).alias("score"), F.array(F.lit("density_floor")).alias("reasons")).distinct()


def content(samples: DataFrame, cuts: DataFrame, keys: Sequence[str], settle_us: int = 600_000, reason: str = "scenedetect_content") -> DataFrame:
    """A little after each scene cut (the first cut itself), the nearest sample; score at least 0.30."""
    w = Window.partitionBy(*keys).orderBy("cut_us")
    probes = cuts.select(*keys, (F.col("cut_us") + F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.lit(settle_us))).alias("_probe"))
    got = joins.nearest(probes, samples.select(*keys, "t_us", "sample_index", "change_score"), keys, "_probe", "t_us", ["sample_index", "change_score"])
    return got.select(*keys, "sample_index", "t_us", F.greatest(F.lit(0.30), F.col("change_score")).alias("score"), F.array(F.lit(reason)).alias("reasons"))


def adaptive(samples: DataFrame, keys: Sequence[str], radius: int, k: int, least_us: int = 2_000_000, change: float = 0.018, ratio: float = 3.0, quiet: float = 0.008) -> DataFrame:
    """Local peaks of change well above their surroundings, at least `least_us` apart, where the picture has settled."""
    own = sequences.adaptive_ratio(samples, keys, ["sample_index"], "change_score", radius)
    own = sequences.first_stable(own, keys, ["sample_index"], "change_score", "sample_index", k, quiet)
    settled = samples.select(*keys, F.col("sample_index").alias("settled_index"), F.col("t_us").alias("settled_us"))
    peaks = own.where((F.col("sample_index") > 0) & (F.col("change_score") >= change) & (F.col("ratio") >= ratio) & F.col("local_peak")).join(settled, [*keys, "settled_index"])
    kept = sequences.greedy_gap(peaks, keys, "t_us", least_us, "settled_index", "ratio", settled="settled_us")
    return kept.select(*keys, F.col("settled_index").alias("sample_index"), F.col("settled_us").alias("t_us"), F.col("ratio").alias("score"), F.array(F.lit("adaptive_change_settled")).alias("reasons"))


def merge(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each sample: the highest score, all reasons in order, its segment (two segments abort)."""
    segment = F.when(F.size(F.collect_set("segment_id")) > 1, F.raise_error(F.lit("one sample in two segments"))).otherwise(F.min("segment_id")) if "segment_id" in candidates.columns else F.lit(None).cast("string")
    reasons = F.flatten(F.collect_list("reasons"))
    return candidates.groupBy(*keys, "sample_index").agg(F.min("t_us").alias("t_us"), F.max("score").alias("score"), F.when(F.count("*") == 1, reasons).otherwise(F.array_sort(F.array_distinct(reasons))).alias("reasons"), segment.alias("segment_id"))


#: Ranks of reasons; any other has rank 1.
RANKS = {"settled_after_change": 4, "segment_end_after_change": 4, "scenedetect_content": 3, "scenedetect_adaptive": 3, "adaptive_change_settled": 2}


def priority(ranks: dict[str, int] = RANKS) -> Column:
    """struct(rank, score, t_us): the greatest wins."""
    rank = F.coalesce(F.array_max(F.transform("reasons", lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), r), F.lit(1)))), F.lit(1))
    return F.struct(rank.alias("rank"), F.col("score").alias("score"), F.col("t_us").alias("t_us"))


def cap(candidates: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """candidates with kept: the best of each of `most` equal time spans, then the best of the rest."""
    w = Window.partitionBy(*keys)
    own = candidates.withColumns({"_p": priority(), "_a": F.min("t_us").over(w), "_b": F.max("t_us").over(w), "_n": F.count("*").over(w)})
    bucket = F.least(F.lit(most - 1), F.floor((F.col("t_us") - F.col("_a")) * most / F.greatest(F.lit(1), F.col("_b") - F.col("_a")))).cast("int")
    own = own.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(F.col("_p").desc(), "sample_index")) == 1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_first").desc(), F.col("_p").desc(), "sample_index"))
    return own.withColumn("kept", (F.col("_n") <= most) | (place <= most)).drop("_p", "_a", "_b", "_n", "_first")


def hybrid(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All candidates of several selectors (uniform, content, adaptive, settled), merged by sample."""
    columns = [*keys, "sample_index", "t_us", "score", "reasons"]
    return merge(reduce(DataFrame.unionByName, (p.select(*columns) for p in parts)), keys)


# ---- clips -------------------------------------------------------------------------------

def select_clips(frames: DataFrame, keys: Sequence[str], strategy: str | Column, fps: float) -> DataFrame:
    """Run a clip selector for each group of frames(keys, sample_index, t, h, w, gray, lookahead).

    `strategy` is a name, or a column that holds one for each group (routed selection). A group is
    one segment with its look-ahead; look-ahead frames confirm or veto, and are never emitted.
    """
    own = frames.withColumn("_strategy", F.lit(strategy) if isinstance(strategy, str) else strategy)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_index", kind="stable").reset_index(drop=True)
        images = [np.frombuffer(g, np.uint8).reshape(h, w) for g, h, w in zip(part["gray"], part["h"], part["w"])]
        inside = np.flatnonzero(~part["lookahead"].to_numpy(bool))
        if not len(inside):
            part = part.iloc[:0]
            return pd.DataFrame({**{k: part[k] for k in keys}, "sample_index": pd.Series(dtype="int64"), "t": pd.Series(dtype="float64"), "score": pd.Series(dtype="float64"), "reasons": pd.Series(dtype=object)})
        name = part["_strategy"].iloc[0]
        last = int(inside[-1])
        # settled has no use for look-ahead: its clip ends with the segment
        size = last + 1 if name == "settled" else len(images)
        got = STRATEGIES[name](automata.Clip(part["t"].tolist()[:size], images[:size], fps, last))
        if any(i > last for i, _, _ in got):
            raise RuntimeError("a selector emitted a look-ahead frame")
        out = pd.DataFrame({"sample_index": [int(part["sample_index"][i]) for i, _, _ in got], "t": [float(part["t"][i]) for i, _, _ in got], "score": [float(s) for _, s, _ in got], "reasons": pd.Series([r for _, _, r in got], dtype=object)})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[[*keys, "sample_index", "t", "score", "reasons"]]

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return own.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), CANDIDATE]))


def routed(frames: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """Candidates of each routed segment by the selector of its kind, with the route's reasons.

    frames(keys, segment_id, kind, selector, sample_index, t, h, w, gray, lookahead) as dispatch()
    deals them. Indices stay those of the source; a frame of the look-ahead is never emitted.
    """
    own = select_clips(frames, [*keys, "segment_id", "kind", "selector"], F.col("selector"), fps)
    tags = F.array(F.concat(F.lit("route:segment="), "segment_id"), F.concat(F.lit("route:kind="), "kind"), F.concat(F.lit("route:selector="), "selector"))
    return own.select(*keys, "sample_index", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "score", F.array_sort(F.array_distinct(F.concat("reasons", tags))).alias("reasons"), "segment_id")


def fold_duplicates(rows: list[dict], differences, window: int = 6) -> tuple[list[dict], list[dict]]:
    """Fold candidates in time order against the last `window` kept ones, oldest first.

    differences(old, new) is the measured (hash distance, ssim, block change) of a duplicate, or
    None. The first match wins: the row of greater (rank, score, t) takes the place, reasons are
    merged, and the other one is dropped with what was measured.
    """
    priority = lambda r: (r["rank"], r["score"], r["t_us"])
    kept: list[dict] = []
    dropped: list[dict] = []
    for row in rows:
        hits = ((at, differences(kept[at], row)) for at in range(max(0, len(kept) - window), len(kept)))
        at, measured = next((h for h in hits if h[1] is not None), (len(kept), None))
        if measured is None:
            kept.append(row)
            continue
        worse, better = sorted((kept[at], row), key=priority) if priority(row) != priority(kept[at]) else (row, kept[at])
        kept[at] = better | {"reasons": sorted({*kept[at]["reasons"], *row["reasons"]})}
        dropped.append({**worse, "duplicate_of_us": better["t_us"], "measured": measured})
    return sorted(kept, key=lambda r: (r["t_us"], r["sample_index"])), dropped


def measured(a: np.ndarray, b: np.ndarray, bits: int = 4, ssim: float = 0.996, block: float = 0.012) -> tuple[int, float, float] | None:
    """(hash distance, ssim, block change) of near-duplicate frames, else None; the cheapest test comes first."""
    apart = (px.perceptual_hash(a) ^ px.perceptual_hash(b)).bit_count()
    if apart > bits or (like := px.frame_ssim(a, b)) < ssim or (change := px.block_change(a, b)) > block:
        return None
    return apart, like, change


def deduplicate(candidates: DataFrame, frames: DataFrame, keys: Sequence[str], window: int = 6, bits: int = 4, ssim: float = 0.996, block: float = 0.012) -> DataFrame:
    """Merged candidates with status kept or duplicate, and of duplicates of what and by which measures.

    frames(keys, sample_index, h, w, gray). A group is one source's candidates and their frames.
    """
    own = candidates.withColumn("rank", priority()["rank"]).join(frames.select(*keys, "sample_index", "h", "w", "gray"), [*keys, "sample_index"])
    columns = [*keys, "sample_index", "t_us", "score", "reasons", "segment_id"]
    own = own.select(*columns, "rank", "h", "w", "gray")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["t_us", "sample_index"], kind="stable").to_dict("records")
        first: dict[tuple, int] = {}  # equal pictures are compared once
        for r in rows:
            r["image"], r["reasons"] = first.setdefault((r.pop("h"), r.pop("w"), r.pop("gray")), len(first)), list(r["reasons"])
        images = [np.frombuffer(g, np.uint8).reshape(h, w) for h, w, g in first]
        near = lru_cache(4096)(lambda a, b: measured(images[a], images[b], bits, ssim, block))
        kept, dropped = fold_duplicates(rows, lambda a, b: near(a["image"], b["image"]), window)
        out = [(*(r[c] for c in columns), "kept", None, None, None, None) for r in kept]
        out += [(*(r[c] for c in columns), "duplicate", r["duplicate_of_us"], *r["measured"]) for r in dropped]
        return pd.DataFrame(out, columns=[*columns, "status", "duplicate_of_us", "phash_distance", "ssim", "block_change"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "status string, duplicate_of_us long, phash_distance int, ssim double, block_change double"]))


def finalize(candidates: DataFrame, frames: DataFrame, keys: Sequence[str], most: int, unique: bool = True) -> DataFrame:
    """Merged candidates with status selected, duplicate or capped: merge, de-duplicate, cap in time."""
    raw = merge(candidates, keys)
    extra = ["duplicate_of_us", "phash_distance", "ssim", "block_change"]
    if unique:
        marked = deduplicate(raw, frames, keys)
    else:
        marked = raw.withColumns({"status": F.lit("kept"), **{c: F.lit(None).cast("long" if c == "duplicate_of_us" else "int" if c == "phash_distance" else "double") for c in extra}})
    columns = [*keys, "sample_index", "t_us", "score", "reasons", "segment_id", "status", *extra]
    # duplicates are a group of their own, so that one pass caps what is left
    capped = cap(marked, [*keys, "status"], most)
    return capped.withColumn("status", F.when(F.col("status") == "duplicate", "duplicate").when(F.col("kept"), "selected").otherwise("capped")).select(*columns)
