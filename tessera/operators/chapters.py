"""Chapters: titles from text lines, boundary features, boundary choice, assignment and coverage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, textual
from . import joins, sequences

#: Weights of novelty, discourse, pause and visual title change.
WEIGHTS = {"novelty": 0.44, "discourse": 0.25, "pause": 0.11, "visual": 0.20}
COLLAPSE_US, LOOKBACK_US, LOOKAHEAD_US, TITLE_WINDOW_US = 18_000_000, 210_000_000, 5_000_000, 14_000_000


def cosine(df: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """df with the feature cosine of two normalised texts, computed within the row."""
    return df.withColumn(out, textual.feature_cosine(left, right))


def title_lines(lines: DataFrame, keys: Sequence[str], exclusions: Sequence[str] = lexicon.TITLE_EXCLUSIONS) -> DataFrame:
    """The best title line of each frame: lines(keys, text, y, width, confidence)."""
    own = lines.withColumns({"text": F.trim("text"), "confidence": F.coalesce("confidence", F.lit(0.0))}).withColumn("norm", textual.normalise(F.col("text")))
    ok = F.length("norm").between(4, 80) & (F.col("y") <= 0.36) & (F.col("width") >= 0.10) & (F.col("confidence") >= 0.25) & ~F.isnan("y") & ~F.isnan("width") & ~F.isnan("confidence")
    for x in exclusions:
        ok &= ~F.contains("norm", F.lit(x))
    rank = 0.20 * F.col("confidence") + 0.55 * F.greatest(F.lit(0.0), 1.0 - F.col("y")) + 0.25 * F.least(F.lit(1.0), F.col("width"))
    best = own.where(ok).withColumn("rank", rank).groupBy(*keys).agg(F.min(F.struct((-F.col("rank")).alias("r"), "y", (-F.col("width")).alias("w"), (-F.length("norm")).alias("n"), "text", "confidence")).alias("x"))
    return best.select(*keys, F.col("x.text").alias("title"), F.round("x.confidence", 6).alias("confidence"))


def changed_titles(titles: DataFrame, keys: Sequence[str], order: Sequence[str], same: float = 0.72) -> DataFrame:
    """Titles that differ from the last kept one of their source; a sequential fold over one source's titles."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable")
        keep, last = [], None
        for norm in part["_norm"]:
            bag = textual.feature_counts(norm)
            keep.append(last is None or textual.bag_cosine(last, bag) < same)
            if keep[-1]:
                last = bag
        return part[keep].drop(columns="_norm")

    return titles.withColumn("_norm", textual.normalise(F.col("title"))).groupBy(*keys).applyInPandas(run, titles.schema)


def boundary_features(speech: DataFrame, keys: Sequence[str], window_us: int = 45_000_000, patterns: Sequence[tuple[str, float, str]] = lexicon.CUES) -> DataFrame:
    """For each speech event but a source's first: novelty, discourse, pause and the cues found.

    speech(keys, speech_id, start_us, end_us, text), ordered by start within keys.
    """
    w = Window.partitionBy(*keys).orderBy("start_us", "speech_id")
    cue = textual.cues(textual.normalise(F.concat_ws(" ", "text", "_next")), patterns)
    own = speech.withColumns({"_before": F.lag("end_us").over(w), "_next": F.lead("text").over(w), "norm": textual.normalise(F.coalesce("text", F.lit("")))})
    pause = F.when(F.col("_before").isNotNull(), F.greatest(F.lit(0), F.col("start_us") - F.col("_before")))
    own = own.withColumn("_cue", F.when(F.col("_before").isNotNull(), cue))
    own = own.select(*keys, "speech_id", "start_us", "end_us", "norm", F.round("_cue.score", 6).alias("discourse"), F.when(pause.isNotNull(), F.round(F.least(F.lit(1.0), pause / 1_500_000.0), 6)).alias("pause"), pause.alias("pause_us"), F.col("_cue.names").alias("cues"))
    kept = [*keys, "speech_id", "start_us", "discourse", "pause", "pause_us", "cues"]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start_us", "speech_id"], kind="stable")
        start, end, norm = part["start_us"].to_numpy(), part["end_us"].to_numpy(), part["norm"].to_numpy()
        rows = np.flatnonzero(part["home"].to_numpy() & part["pause_us"].notna().to_numpy())
        text = lambda ws, we: "".join(norm[(end > ws) & (start < we)])
        bags = ((textual.feature_counts(text(t - window_us, t)), textual.feature_counts(text(t, t + window_us))) for t in start[rows])
        out = part.iloc[rows][kept].copy()
        out["novelty"] = [round(1.0 - textual.bag_cosine(a, b), 6) for a, b in bags]
        return out

    sliced = joins.time_slices(own, "start_us", "end_us", window_us, 20 * window_us)
    out = sliced.groupBy(*keys, "slice").applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "novelty double"]))
    return out.withColumn("cues", F.coalesce("cues", F.array().cast("array<string>")))


def scored(features: DataFrame, visual: str | None = None) -> DataFrame:
    """features with visual_title_change and the weighted score, rounded to six places."""
    own = features.withColumn("visual_title_change", F.col(visual) if visual else F.lit(0.0))
    return own.withColumn("score", F.round(WEIGHTS["novelty"] * F.col("novelty") + WEIGHTS["discourse"] * F.col("discourse") + WEIGHTS["pause"] * F.col("pause") + WEIGHTS["visual"] * F.col("visual_title_change"), 6))


def attach_titles(features: DataFrame, titles: DataFrame, speech: DataFrame, keys: Sequence[str], ranges: DataFrame, least_us: int, terms: Sequence[str] = lexicon.TERMS) -> DataFrame:
    """features with visual_title_change and best_similarity, from titles mapped one after the other.

    Pair scores (title, candidate) come from a windowed join; the sequential choice, where each
    mapped title moves the next one's earliest candidate, runs over one source's few pairs.
    """
    t = titles.join(ranges, list(keys)).where(F.col("t_us") >= F.col("range_start_us") + least_us)
    t = t.withColumns({"_title": F.element_at(F.split("title", "[：:]", 2), -1), "_s": F.greatest(F.col("t_us") - LOOKBACK_US, F.col("range_start_us") + least_us), "_e": F.least(F.col("t_us") + LOOKAHEAD_US, F.col("range_end_us") - least_us)}).where("_e >= _s")
    cand = features.select(*keys, "speech_id", F.col("start_us").alias("at"), F.col("start_us").alias("at2"), "discourse")
    pairs = joins.overlapping(t, cand, keys, "_s", "_e", "at", "at2", closed=True)
    ident = [*keys, "title_id", "speech_id"]
    windows = pairs.select(*ident, F.col("at").alias("ws"), F.least(F.col("range_end_us"), F.col("at") + TITLE_WINDOW_US).alias("we"))
    right = joins.window_text(windows, speech.withColumnsRenamed({"speech_id": "_sid"}), keys, ["title_id", "speech_id"], ["start_us", "_sid"])
    both = pairs.join(right.select(*ident, "window_text"), ident).withColumns({"_l": textual.normalise_match(F.col("_title")), "_r": textual.normalise_match(F.col("window_text"))})
    shared = F.lit(0)
    for term in terms:
        shared = shared + (F.contains("_title", F.lit(term)) & F.contains("_r", textual.normalise_match(F.lit(term)))).cast("int")
    rows = cosine(both.withColumn("_shared", shared), "_l", "_r").select(*ident, "t_us", "at", "discourse", "similarity", F.col("_shared").alias("shared"), F.col("confidence"), "range_start_us")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out, earliest = [], None
        for _, own in part.sort_values(["t_us", "title_id"]).groupby(["t_us", "title_id"], sort=True):
            first = own["range_start_us"].iloc[0]
            ok = own[own["at"] >= (first if earliest is None else earliest) + least_us]
            best = None
            for r in ok.itertuples():
                timing = max(0.0, 1.0 - abs(r.t_us - r.at) / LOOKBACK_US)
                rank = 0.72 * r.similarity + min(0.16, 0.08 * r.shared) + 0.22 * r.discourse + 0.06 * timing
                key = (rank, r.similarity, r.discourse, -r.at)
                if best is None or key > best[0]:
                    best = (key, r)
            if best is None or best[0][1] < 0.045 or best[0][0] < 0.28:
                continue
            r = best[1]
            part_of = min(1.0, max(0.0, 0.55 * min(1.0, best[0][0] / 0.60) + 0.45 * r.confidence))
            out.append([*(getattr(r, k) for k in keys), r.speech_id, round(part_of, 6), round(best[0][1], 6)])
            earliest = r.at
        return pd.DataFrame(out, columns=[*keys, "speech_id", "visual_title_change", "best_similarity"])

    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    mapped = rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"speech_id {kinds['speech_id']}", "visual_title_change double, best_similarity double"]))
    best = mapped.groupBy(*keys, "speech_id").agg(F.max("visual_title_change").alias("visual_title_change"), F.max("best_similarity").alias("best_similarity"))
    return features.join(best, [*keys, "speech_id"], "left").fillna(0.0, ["visual_title_change", "best_similarity"])


def choose(rows: list[dict], start: float, end: float, least: float, target: float, most: float) -> list[tuple[float, bool]]:
    """Boundaries (time, forced) of one source from its candidates in time order.

    Natural ones are collapsed and spaced; then the leftmost gap above `most` is split at the best
    candidate near the target length, again and again.
    """
    natural = [
        r for r in rows
        if start + least <= r["t"] <= end - least
        and (r["discourse"] >= 0.90 or (r["visual"] >= 0.55 and r["similarity"] >= 0.12) or (r["novelty"] >= 0.97 and r["pause"] >= 0.45))
    ]
    merged: list[tuple[float, float]] = []
    for r in natural:
        if not merged or r["t"] - merged[-1][0] >= COLLAPSE_US / 1e6:
            merged.append((r["t"], r["score"]))
        elif r["score"] > merged[-1][1]:
            merged[-1] = (r["t"], r["score"])
    marks = {t: False for t, _ in sequences.spaced(merged, start, end, least)}
    while True:
        edges = [start, *sorted(marks), end]
        gap = next(((a, b) for a, b in zip(edges, edges[1:]) if b - a > most + 1e-6), None)
        if gap is None:
            return sorted(marks.items())
        a, b = gap
        ideal = min(a + target, b - least)
        fits = [(r["score"] - abs(r["t"] - ideal) / most, -abs(r["t"] - ideal), -r["t"]) for r in rows if a + least <= r["t"] <= b - least]
        if not fits:
            raise ValueError("no speech boundary can satisfy the longest chapter")
        marks[-max(fits)[2]] = True


def boundaries(candidates: DataFrame, ranges: DataFrame, keys: Sequence[str], least: float = 30.0, target: float = 180.0, most: float = 480.0) -> DataFrame:
    """(keys, start_us, forced) of the chosen boundaries. One group is one source's candidates, scalars only."""
    own = candidates.join(ranges, list(keys))
    for c in ("visual_title_change", "best_similarity"):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(0.0))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start_us", "speech_id"], kind="stable")
        rows = [{"t": r.start_us / 1e6, "discourse": r.discourse, "visual": r.visual_title_change, "similarity": r.best_similarity, "novelty": r.novelty, "pause": r.pause, "score": r.score} for r in part.itertuples()]
        got = choose(rows, part["range_start_us"].iloc[0] / 1e6, part["range_end_us"].iloc[0] / 1e6, least, target, most)
        out = pd.DataFrame({"start_us": [round(t * 1e6) for t, _ in got], "forced": [f for _, f in got]})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return own.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "start_us long, forced boolean"]))


def chapters(marks: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contiguous chapters: the first begins with the range, each other one at its boundary."""
    first = ranges.select(*keys, F.col("range_start_us").alias("start_us"), F.lit(False).alias("forced"))
    w = Window.partitionBy(*keys).orderBy("start_us")
    own = first.unionByName(marks.select(*keys, "start_us", "forced")).join(ranges.select(*keys, "range_end_us"), list(keys))
    return own.withColumns({"chapter": F.row_number().over(w), "end_us": F.coalesce(F.lead("start_us").over(w), F.col("range_end_us"))}).withColumns({"chapter_id": F.format_string("chapter-%03d", "chapter"), "last": F.col("end_us") == F.col("range_end_us")}).drop("range_end_us")


def assign(events: DataFrame, chapters: DataFrame, keys: Sequence[str], t: str = "t_us", tolerance_us: int = 1) -> DataFrame:
    """events with chapter_id: start <= t < end, and the last chapter holds its end as well."""
    own = chapters.select(*keys, "chapter_id", F.col("start_us").alias("_s"), (F.col("end_us") + F.when(F.col("last"), F.lit(tolerance_us + 1)).otherwise(F.lit(0))).alias("_e"))
    return joins.points_in_segments(events, own, keys, t=t, start="_s", end="_e").drop("_s", "_e")


def chapter_texts(speech: DataFrame, chapters: DataFrame, keys: Sequence[str], terms: Sequence[str] = lexicon.TERMS, penalties: Sequence[str] = lexicon.TITLE_PENALTIES, patterns: Sequence[tuple[str, float, str]] = lexicon.CUES) -> DataFrame:
    """chapters with raw_text, speech ids, title (with its event) and keywords."""
    held = assign(speech, chapters, keys, t="start_us").join(chapters.select(*keys, "chapter_id", F.col("start_us").alias("chapter_start")), [*keys, "chapter_id"])
    w = Window.partitionBy(*keys, "chapter_id").orderBy("start_us", "speech_id")
    own = held.withColumns({"n": F.row_number().over(w) - 1, "norm": textual.normalise(F.trim("text"))})
    near = (F.col("start_us") < F.col("chapter_start") + 32_000_000) | (F.col("n") == 0)
    count = F.lit(0)
    for x in terms:
        count = count + F.contains("text", F.lit(x)).cast("int")
    minus = F.lit(0)
    for x in penalties:
        minus = minus + F.contains("norm", F.lit(x.lower())).cast("int")
    score = 0.8 * count + 0.35 * textual.cues(F.col("norm"), patterns)["score"] + 0.3 * (1.0 - F.least(F.lit(1.0), F.abs(F.length("norm") - 13) / 28.0)) - 0.45 * minus - 0.008 * F.col("n")
    title = own.where(near & (F.length("norm") > 0)).withColumn("_score", score).groupBy(*keys, "chapter_id").agg(F.min(F.struct((-F.round("_score", 9)).alias("s"), "n", "text", "speech_id")).alias("x"))
    texts = own.groupBy(*keys, "chapter_id").agg(F.array_sort(F.collect_list(F.struct("start_us", "speech_id", "text"))).alias("x")).select(*keys, "chapter_id", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("raw_text"), F.transform("x", lambda x: x["speech_id"]).alias("speech_ids"))
    out = chapters.join(texts, [*keys, "chapter_id"], "left").join(title.select(*keys, "chapter_id", F.col("x.text").alias("title"), F.col("x.speech_id").alias("title_speech_id")), [*keys, "chapter_id"], "left")
    return out.withColumns({"title": F.coalesce("title", F.lit("（无语音文本）")), "keywords": textual.keywords(F.coalesce("raw_text", F.lit("")), terms)})
