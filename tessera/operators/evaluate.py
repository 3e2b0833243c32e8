"""Evaluation: one-to-one matching, duplicate windows, selection quality, transcript anchors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins


#: Characters by which a span finds the speech that may hold it.
GRAM = 8


def match_points(points: list[tuple[float, float, float]], candidates: list[float]) -> list[tuple[int, int]]:
    """Pairs (point, candidate) of an order-preserving one-to-one match.

    points: (time, acceptable start, acceptable end), by time; candidates by time. As many matches
    as possible, then the least total error, then the lexicographically least pairs. Counts and
    errors of all suffixes are tabulated from the back; walking from the front then takes, among
    the best, the earliest point with the earliest candidate.
    """
    n, m = len(points), len(candidates)
    count, error = np.zeros((n + 1, m + 1), np.int64), np.zeros((n + 1, m + 1))

    def ahead(c1: int, e1: float, c2: int, e2: float) -> bool:
        return c1 > c2 or (c1 == c2 and e1 < e2 - 1e-12)

    for i in range(n - 1, -1, -1):
        t, a, b = points[i]
        for j in range(m - 1, -1, -1):
            c, e = count[i + 1, j], error[i + 1, j]
            if ahead(count[i, j + 1], error[i, j + 1], c, e):
                c, e = count[i, j + 1], error[i, j + 1]
            if a <= candidates[j] <= b:
                c2, e2 = count[i + 1, j + 1] + 1, error[i + 1, j + 1] + abs(candidates[j] - t)
                if not ahead(c, e, c2, e2):
                    c, e = c2, e2
            count[i, j], error[i, j] = c, e
    pairs, i, j = [], 0, 0
    while i < n and count[i, j]:
        t, a, b = points[i]
        for k in range(j, m):
            if a <= candidates[k] <= b and count[i + 1, k + 1] + 1 == count[i, j] and abs(error[i + 1, k + 1] + abs(candidates[k] - t) - error[i, j]) <= 1e-9:
                pairs.append((i, k))
                j = k + 1
                break
        i += 1
    return pairs


def match(points: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points(keys, point_id, t, low, high) with the matched candidate's time and the error.

    One group holds the labels and candidates of one source; both are reviewed, short lists.
    """

    def run(key: tuple, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame(columns=[*keys, "point_id", "t", "matched_t", "error"])
        p = p.sort_values(["t", "point_id"], kind="stable").reset_index(drop=True)
        times = sorted(c["t"].tolist()) if len(c) else []
        got = dict(match_points(list(zip(p["t"], p["low"], p["high"])), times))
        p["matched_t"] = [times[got[i]] if i in got else np.nan for i in range(len(p))]
        p["error"] = (p["matched_t"] - p["t"]).abs()
        return p[[*keys, "point_id", "t", "matched_t", "error"]]

    schema = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), f"point_id {points.schema['point_id'].dataType.simpleString()}", "t double, matched_t double, error double"])
    # both sides may come of one table: columns of the same name would be taken for one another
    other = candidates.select(*[F.col(c).alias(c) for c in [*keys, "t"]])
    out = points.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("matched_t", "error")})


def selection_quality(matched: DataFrame, candidates: DataFrame, keys: Sequence[str], exhaustive: bool = True) -> DataFrame:
    """Precision, recall, F1 and the median error by source; recall and F1 only of an exhaustive review."""
    m = matched.groupBy(*keys).agg(F.count("*").alias("points"), F.count("matched_t").alias("matches"), F.expr("percentile(error, 0.5)").alias("median_error"))
    out = m.join(candidates.groupBy(*keys).agg(F.count("*").alias("candidates")), list(keys), "full_outer").fillna(0, ["points", "matches", "candidates"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.withColumns({"precision": ratio("matches", "candidates"), "recall": ratio("matches", "points") if exhaustive else F.lit(None).cast("double")})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def duplicate_windows(windows: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """windows(keys, window_id, start_us, end_us, most) with how many selected rows lie within (closed) and whether that is allowed."""
    points = selected.select(*keys, F.col("t_us").alias("_t"), (F.col("t_us")).alias("_e"))
    inside = joins.overlapping(windows, points, keys, "start_us", "end_us", "_t", "_e", closed=True)
    n = inside.groupBy(*keys, "window_id").agg(F.count("*").alias("selected"))
    return windows.join(n, [*keys, "window_id"], "left").fillna(0, ["selected"]).withColumn("ok", F.col("selected") <= F.col("most"))


def ground_truth_status(review_status: str = "review_status", coverage: str = "coverage") -> F.Column:
    return F.when((F.col(review_status) == "reviewed") & (F.col(coverage) == "exhaustive"), "reviewed_exhaustive").when(F.col(review_status) == "reviewed", "reviewed_partial").otherwise("unreviewed")


def holders(spans: list[str], texts: list[str]) -> Counter:
    """How many of the texts hold each span. A text is read once: its runs of GRAM characters (of all
    lengths of shorter spans as well) are looked up among the spans' first characters."""
    heads: dict[int, dict[str, list[str]]] = {}
    for s in dict.fromkeys(spans):
        heads.setdefault(min(GRAM, len(s)), {}).setdefault(s[:GRAM], []).append(s)
    out: Counter = Counter()
    for t, n in Counter(texts).items():
        found = set()
        for size, own in heads.items():
            for at in range(len(t) - size + 1):
                for s in own.get(t[at : at + size], ()):
                    if t.startswith(s, at):
                        found.add(s)
        for s in found:
            out[s] += n
    return out


def span_hits(anchors: DataFrame, speech: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, anchor_id, all_hits): how much of a source's speech holds each expected span. A group is one source's texts."""
    kinds = ", ".join(f"`{c}` {anchors.schema[c].dataType.simpleString()}" for c in [*keys, "anchor_id"])

    def run(spans: pa.Table, texts: pa.Table) -> pa.Table:
        own = spans.column("expected_span").to_pylist()
        n = holders([s for s in own if s is not None], [t for t in texts.column("text").to_pylist() if t is not None])
        return spans.select([*keys, "anchor_id"]).append_column("all_hits", pa.array([n[s] for s in own], pa.int64()))

    # both sides may come of one table: columns of the same name would be taken for one another
    other = speech.select(*[F.col(c).alias(c) for c in [*keys, "text"]])
    found = anchors.select(*keys, "anchor_id", "expected_span").groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(run, f"{kinds}, all_hits long")
    return found.groupBy(*keys, "anchor_id").agg(F.sum("all_hits").alias("all_hits"))


def anchor_scores(anchors: DataFrame, speech: DataFrame, keys: Sequence[str], tolerance_us: int = 750_000) -> DataFrame:
    """anchors(keys, anchor_id, start_us, end_us, baseline_span, expected_span) with what the output says nearby.

    expected_exact if the expected span stands in speech that touches the widened window (closed),
    baseline_error_persists if the baseline's does, else other_output; off_anchor counts segments
    elsewhere that hold the expected span.
    """
    own = anchors.withColumns({"_s": F.col("start_us") - tolerance_us, "_e": F.col("end_us") + tolerance_us})
    near = joins.overlapping(own, speech.select(*keys, "speech_id", F.col("start_us").alias("ss"), F.col("end_us").alias("se"), "text"), keys, "_s", "_e", "ss", "se", closed=True)
    expected = F.contains("text", "expected_span")
    hits = near.groupBy(*keys, "anchor_id").agg(F.max(expected).alias("expected"), F.max(F.contains("text", "baseline_span")).alias("baseline"), F.count("*").alias("near"), F.count_if(expected).alias("near_hits"))
    # the complement of the window join, counted by subtraction: no pairs of unlike rows are built
    out = anchors
    for d in (hits, span_hits(own, speech, keys)):
        out = out.join(d, [*keys, "anchor_id"], "left")
    out = out.fillna(0, ["near", "all_hits", "near_hits"]).fillna(False, ["expected", "baseline"])
    outcome = F.when(F.col("expected"), "expected_exact").when(F.col("baseline"), "baseline_error_persists").otherwise("other_output")
    return out.withColumns({"outcome": outcome, "off_anchor": F.col("all_hits") - F.col("near_hits")}).drop("expected", "baseline", "all_hits", "near_hits")


def anchor_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("anchors"), F.count_if(F.col("outcome") == "expected_exact").alias("hits"), F.avg((F.col("outcome") == "expected_exact").cast("double")).alias("hit_rate"), F.sum("off_anchor").alias("off_anchor"))
