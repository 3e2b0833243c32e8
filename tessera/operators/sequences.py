"""Order-dependent operators: native where a window expresses them, an ordered fold where one is
needed, and Arrow groups by source for the fixpoints. A group is one source's sequence of scalars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """df with run_id (1, 2, ... within keys): a new one wherever the label changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("run_id", F.sum(changed.cast("long")).over(w))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, *aggs: Column) -> DataFrame:
    """One row for each run of equal labels: (keys, run_id, label, length, aggs...)."""
    return label_runs(df, keys, order, label).groupBy(*keys, "run_id", label).agg(F.count("*").alias("length"), *aggs)


def short_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, least: int, unknown: str = "unknown") -> DataFrame:
    """Runs of known labels with fewer than `least` rows become unknown; one pass, nothing joins anew."""
    marked = label_runs(df, keys, order, label)
    n = F.count("*").over(Window.partitionBy(*keys, "run_id"))
    return marked.withColumn(label, F.when((F.col(label) != unknown) & (n < least), unknown).otherwise(F.col(label))).drop("run_id")


def bridge_labels(labels: list[str], most: int) -> list[str]:
    """Runs of up to `most` rows between equal neighbours take their label: leftmost first, runs built anew."""
    out: list[list] = []
    for x in labels:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    i = 1
    while i < len(out) - 1:
        if out[i][1] <= most and out[i - 1][0] == out[i + 1][0]:
            out[i - 1 : i + 2] = [[out[i - 1][0], out[i - 1][1] + out[i][1] + out[i + 1][1]]]
            i = max(1, i - 1)
        else:
            i += 1
    return [x for x, n in out for _ in range(n)]


def bridge(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, most: int, out: str = "bridged") -> DataFrame:
    """df with the bridged label; order-dependent, so one group of scalars for each source."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable")
        part[out] = bridge_labels(part[label].tolist(), most)
        return part

    schema = df.withColumn(out, F.col(label)).schema
    return df.groupBy(*keys).applyInPandas(run, schema)


def gap_clusters(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], gap: int) -> DataFrame:
    """cluster_id: a row joins the one before it if it comes at most `gap` after it (inclusive)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True))
    return df.withColumn("cluster_id", F.sum(new.cast("long")).over(w))


def adaptive_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, radius: int, floor: float = 0.002) -> DataFrame:
    """Score over the median of its neighbours (itself and the first sample left out), and local peaks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    own = df.withColumn("_s", F.when(~first, F.col(score)))
    around = F.concat(F.collect_list("_s").over(w.rowsBetween(-radius, -1)), F.collect_list("_s").over(w.rowsBetween(1, radius)))
    sorted_ = F.array_sort(around)
    n = F.size(around)
    middle = F.when(n == 0, F.lit(0.0)).otherwise((F.get(sorted_, ((n - 1) / 2).cast("int")) + F.get(sorted_, (n / 2).cast("int"))) / 2)
    peak = (F.col(score) >= F.coalesce(F.lag(score).over(w), F.col(score))) & (F.col(score) >= F.coalesce(F.lead(score).over(w), F.col(score)))
    out = own.withColumns({"baseline": middle, "local_peak": peak})
    return out.withColumn("ratio", F.when(first, F.lit(0.0)).otherwise(F.col(score) / F.greatest(F.lit(floor), F.col("baseline")))).drop("_s")


def first_stable(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, index: str, k: int, quiet: float) -> DataFrame:
    """settled_index: the last row of the first k quiet rows that follow, or the row itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    calm = F.sum((F.col(score) <= quiet).cast("int")).over(w.rowsBetween(-(k - 1), 0)) == k
    # the run has to begin after the row: its end is at least k rows on
    ends = df.withColumn("_end", F.when(calm, F.col(index)))
    return ends.withColumn("settled_index", F.coalesce(F.min("_end").over(w.rowsBetween(k, Window.unboundedFollowing)), F.col(index))).drop("_end")


def _folded(df: DataFrame, keys: Sequence[str], columns: list[str], keep: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """The rows of each source that a sequential rule keeps, one group of scalars in order for each source."""
    own = df.select(*keys, *columns)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(columns, kind="stable")
        return part.iloc[keep(part)]

    return own.groupBy(*keys).applyInPandas(run, own.schema)


def greedy_gap(df: DataFrame, keys: Sequence[str], t: str, least: int, *payload: str, settled: str | None = None) -> DataFrame:
    """Rows that a greedy pass keeps, each at least `least` after the (settled) time of the last kept one."""
    last = settled or t

    def keep(part: pd.DataFrame) -> np.ndarray:
        out, free = [], None
        for i, (at, until) in enumerate(zip(part[t].tolist(), part[last].tolist())):
            if free is None or at >= free:
                out.append(i)
                free = until + least
        return np.array(out, np.int64)

    return _folded(df, keys, list(dict.fromkeys([t, last, *payload])), keep)


def collapse(df: DataFrame, keys: Sequence[str], t: str, score: str, within: int) -> DataFrame:
    """Rows closer than `within` to the current representative are one; a strictly higher score takes its place."""

    def keep(part: pd.DataFrame) -> np.ndarray:
        times, scores = part[t].tolist(), part[score].tolist()
        out: list[int] = []
        for i, at in enumerate(times):
            if not out or at - times[out[-1]] >= within:
                out.append(i)
            elif scores[i] > scores[out[-1]]:
                out[-1] = i
        return np.array(out, np.int64)

    return _folded(df, keys, [t, score], keep)


def spaced(rows: list[tuple[float, float]], start: float, end: float, least: float) -> list[tuple[float, float]]:
    """(time, score) rows at least `least` apart and from both ends; a higher score displaces its neighbour."""
    out: list[tuple[float, float]] = []
    for t, s in rows:
        if out and t - out[-1][0] < least:
            if s > out[-1][1]:
                out[-1] = (t, s)
        elif t - (out[-1][0] if out else start) >= least:
            out.append((t, s))
    while out and end - out[-1][0] < least:
        out.pop()
    return out


def identical_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, least: int = 3) -> DataFrame:
    """Runs of at least `least` equal, non-empty texts: (keys, run_id, text, length)."""
    return runs(df, keys, order, text).where((F.col("length") >= least) & (F.length(text) > 0))


def chronology(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """One row: how many rows end before they start, start before the one before, or overlap it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.select(F.col(end) < F.col(start), F.lag(start).over(w) > F.col(start), F.lag(end).over(w) > F.col(start)).toDF("a", "b", "c")
    return x.agg(*[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")), F.lit(0)).alias(n) for c, n in (("a", "inverted"), ("b", "disordered"), ("c", "overlapping"))])


def contiguous(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, tolerance: int = 1) -> DataFrame:
    """Rows that do not begin where the one before them ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_before", F.lag(end).over(w)).where(F.abs(F.col("_before") - F.col(start)) > tolerance).drop("_before")
