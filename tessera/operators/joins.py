"""Temporal joins. Every interval rule that the ledgers use has a join of its own.

Interval sides are dealt into time buckets, so that a join is an equi-join on (keys, bucket) with
the exact rule as residual: no nested loop over a whole source, and a hot source is many buckets.
A point is in one bucket; an interval is in each bucket that it touches. Two intervals can share
several; their pair is taken in the first common one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_US = 30_000_000


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def points_in_segments(points: DataFrame, segments: DataFrame, keys: Sequence[str], t: str = "t_us", start: str = "start_us", end: str = "end_us", how: str = "inner", width: int = BUCKET_US) -> DataFrame:
    """Rows of points with the segments that hold them, start <= t < end; empty segments hold nothing.

    `how` is inner or left. Segment columns must not clash with those of points, keys aside.
    """
    p = points.withColumn("_bucket", _bucket(F.col(t), width))
    s = segments.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end) - 1, width))))
    joined = p.alias("p").join(s.alias("s"), [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_bucket"]] + [F.col(f"p.{t}") >= F.col(f"s.{start}"), F.col(f"p.{t}") < F.col(f"s.{end}")], how)
    return joined.select("p.*", *[F.col(f"s.{c}") for c in segments.columns if c not in keys]).drop("_bucket")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], ls: str, le: str, rs: str, re: str, closed: bool = False, width: int = BUCKET_US) -> DataFrame:
    """Pairs whose intervals overlap: re > ls and rs < le, or with >= and <= if closed."""
    lo, hi = _bucket(F.col(ls), width), _bucket(F.col(le), width)
    a = left.withColumns({"_first": lo, "_bucket": F.explode(F.sequence(lo, hi))})
    lo, hi = _bucket(F.col(rs), width), _bucket(F.col(re), width)
    b = right.withColumns({"_first": lo, "_bucket": F.explode(F.sequence(lo, hi))})
    touch = (F.col(f"b.{re}") >= F.col(f"a.{ls}")) & (F.col(f"b.{rs}") <= F.col(f"a.{le}")) if closed else (F.col(f"b.{re}") > F.col(f"a.{ls}")) & (F.col(f"b.{rs}") < F.col(f"a.{le}"))
    once = F.col("a._bucket") == F.greatest(F.col("a._first"), F.col("b._first"))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_bucket"]]
    return a.alias("a").join(b.alias("b"), [*on, once, touch]).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c not in keys])


def time_slices(df: DataFrame, start: str, end: str, margin: int, width: int) -> DataFrame:
    """df with slice and home: each row in every slice of `width` that it or the margin around it touches.

    Work in a window of up to `margin` around a row finds all rows of that window in the row's home
    slice. A long or hot source is many slices, so that no group grows with it.
    """
    own = df.withColumns({"home": _bucket(F.col(start), width), "slice": F.explode(F.sequence(_bucket(F.col(start) - margin, width), _bucket(F.col(end) + margin, width)))})
    return own.withColumn("home", F.col("home") == F.col("slice"))


def as_of(probes: DataFrame, samples: DataFrame, keys: Sequence[str], probe: str, at: str, values: Sequence[str], direction: str = "backward") -> DataFrame:
    """probes with the values of the last sample at or before (or first at or after) each probe.

    One sort of both sides together by key and time; no join, no shuffle besides the key's.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    cols = probes.columns
    held = F.struct(F.col(at).alias(at), *[F.col(v).alias(v) for v in values])
    a = samples.select(*keys, F.col(at).alias("_t"), held.alias("_held"), F.lit(None).cast(probes.select(F.struct(*cols)).schema[0].dataType).alias("_probe"))
    b = probes.select(*keys, F.col(probe).alias("_t"), F.lit(None).cast(a.schema["_held"].dataType).alias("_held"), F.struct(*cols).alias("_probe"))
    back = direction == "backward"
    # at the same time samples come first where they count as at or before
    order = Window.partitionBy(*keys).orderBy(F.col("_t").asc() if back else F.col("_t").desc(), F.col("_probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_last", F.last("_held", ignorenulls=True).over(order)).where("_probe is not null")
    return found.select("_probe.*", *[F.col(f"_last.{c}").alias(c if c not in cols else f"{c}_found") for c in [at, *values]])


def nearest(probes: DataFrame, samples: DataFrame, keys: Sequence[str], probe: str, at: str, values: Sequence[str]) -> DataFrame:
    """probes with the nearest sample in time; the earlier one on a tie, the end one outside the range."""
    back = as_of(probes, samples, keys, probe, at, values, "backward").withColumnsRenamed({c: f"_b_{c}" for c in [at, *values]})
    both = as_of(back, samples, keys, probe, at, values, "forward")
    earlier = F.col(at).isNull() | (F.col(f"_b_{at}").isNotNull() & (F.col(probe) - F.col(f"_b_{at}") <= F.col(at) - F.col(probe)))
    return both.select(*probes.columns, *[F.when(earlier, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in [at, *values]])


def align_points(frames: DataFrame, speech: DataFrame, keys: Sequence[str], ranges: DataFrame) -> DataFrame:
    """Frames with status and matching speech events (a row for each link).

    ranges(keys, range_start_us, range_end_us) is the half-open span that speech was taken from: a
    frame outside is outside_asr_range, one inside without a segment inside_asr_range_no_segment.
    """
    linked = points_in_segments(frames, speech, keys, how="left")
    out = linked.join(ranges, list(keys), "left")
    inside = (F.col("t_us") >= F.col("range_start_us")) & (F.col("t_us") < F.col("range_end_us"))
    status = F.when(~F.coalesce(inside, F.lit(False)), "outside_asr_range").when(F.col("start_us").isNull(), "inside_asr_range_no_segment").otherwise("segment_at_timestamp")
    return out.withColumn("status", status).drop("range_start_us", "range_end_us")


def nearby_speech(frames: DataFrame, speech: DataFrame, keys: Sequence[str], ranges: DataFrame, before_us: int = 20_000_000, after_us: int = 20_000_000) -> DataFrame:
    """Speech that overlaps [t - before, t + after], clipped to the range: relation and gap."""
    windows = frames.join(ranges, list(keys)).withColumns({"ws": F.greatest(F.col("t_us") - before_us, F.col("range_start_us")), "we": F.least(F.col("t_us") + after_us, F.col("range_end_us"))}).where("we > ws").drop("range_start_us", "range_end_us")
    pairs = overlapping(windows, speech, keys, "ws", "we", "start_us", "end_us")
    relation = F.when(F.col("end_us") <= F.col("t_us"), "before").when(F.col("start_us") > F.col("t_us"), "after").otherwise("overlaps")
    gap = F.when(F.col("end_us") <= F.col("t_us"), F.col("t_us") - F.col("end_us")).when(F.col("start_us") > F.col("t_us"), F.col("start_us") - F.col("t_us")).otherwise(F.lit(0))
    return pairs.withColumns({"relation": relation, "gap_us": gap}).drop("ws", "we")


def window_text(windows: DataFrame, speech: DataFrame, keys: Sequence[str], ident: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The texts of speech that strictly overlaps [ws, we), joined by blanks in time order; '' if none."""
    pairs = overlapping(windows, speech, keys, "ws", "we", "start_us", "end_us")
    texts = pairs.groupBy(*keys, *ident).agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("_t"))
    out = windows.join(texts, [*keys, *ident], "left")
    return out.withColumn("window_text", F.coalesce(F.array_join(F.transform("_t", lambda x: x["text"]), " "), F.lit(""))).drop("_t")


def dispatch(segments: DataFrame, samples: DataFrame, keys: Sequence[str], selectors: dict[str, tuple[str, int]]) -> DataFrame:
    """Samples of each segment and its look-ahead, with the selector of the segment's kind.

    selectors: kind -> (selector, look-ahead in microseconds); other kinds get no rows.
    """
    look = F.create_map(*[x for k, (_, us) in selectors.items() for x in (F.lit(k), F.lit(us))])
    name = F.create_map(*[x for k, (s, _) in selectors.items() for x in (F.lit(k), F.lit(s))])
    own = segments.where(F.col("kind").isin(list(selectors))).withColumns({"selector": name[F.col("kind")], "until_us": F.col("end_us") + look[F.col("kind")] + 1})
    return points_in_segments(samples, own.withColumnsRenamed({"start_us": "segment_start_us", "end_us": "segment_end_us"}), keys, t="t_us", start="segment_start_us", end="until_us").withColumn("lookahead", F.col("t_us") > F.col("segment_end_us"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], pattern: str, out: str = "event_id") -> DataFrame:
    """df with ids that count from 1 within each source, as in visual-0001."""
    return df.withColumn(out, F.format_string(pattern, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))))


def timeline(frames: DataFrame, speech: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, k, kind, event_id, t_us) of frames and speech; visual (k 0) goes before speech (k 1) at one time."""
    a = numbered(frames, keys, ["t_us", "sample_index"], "visual-%04d").select(*keys, F.lit(0).alias("k"), F.lit("visual").alias("kind"), "event_id", "t_us")
    b = numbered(speech, keys, ["start_us", "speech_id"], "speech-%04d").select(*keys, F.lit(1).alias("k"), F.lit("speech").alias("kind"), "event_id", F.col("start_us").alias("t_us"))
    return a.unionByName(b)


def source_kind(frames: DataFrame, strategy: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frames(keys, segment_id) with route_kind from the strategy's segments, else the manifest's, else unknown.

    strategy and manifest(keys, segment_id, kind) hold a row for each segment.
    """
    on = [*keys, "segment_id"]
    both = strategy.select(*on, F.col("kind").alias("_a")).join(manifest.select(*on, F.col("kind").alias("_b")), on, "full_outer").select(*on, F.coalesce("_a", "_b").alias("route_kind"))
    return frames.join(both, on, "left").withColumn("route_kind", F.coalesce("route_kind", F.lit("unknown")))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, missing_right, missing_left or repeated, for coverage checks."""
    a, b = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))
    both = a.join(b, key, "full_outer").fillna(0, ["l", "r"])
    return both.select(key, F.when((F.col("l") > 1) | (F.col("r") > 1), "repeated").when(F.col("r") == 0, "missing_right").when(F.col("l") == 0, "missing_left").otherwise("matched").alias("status"))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: how many of the expected keys are missing, unexpected or repeated, as multisets."""
    a, b = expected.groupBy(key).agg(F.count("*").alias("l")), actual.groupBy(key).agg(F.count("*").alias("r"))
    both = a.join(b, key, "full_outer").fillna(0, ["l", "r"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(total(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("missing"), total(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("unexpected"), total(F.greatest(F.col("r") - 1, F.lit(0))).alias("duplicates"))
