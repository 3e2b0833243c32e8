"""Speech ledgers: normalising raw transcripts and the transcript quality gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textual
from . import sequences

TAIL_SLACK = 1.0
MAX_RATIO = 2.4
#: Odd multipliers of the hashes of grams.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def normalise(df: DataFrame, offset: str = "range_start", audio: str = "audio_seconds", slack: float = TAIL_SLACK) -> DataFrame:
    """Relative to absolute times; an end up to `slack` beyond the audio is clamped and disclosed.

    Columns: start, end, text, words array<struct<word, start, end, probability>>. An end farther
    out, a negative start or an end before its start aborts.
    """
    bad = F.col("start").isNull() | F.col("end").isNull() | F.isnan("start") | F.isnan("end") | (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col(audio) + slack)
    checked = df.where(F.when(bad, F.raise_error(F.lit("a speech segment is out of its audio range")).cast("boolean")).otherwise(True))
    word = lambda w: F.struct(
        w["word"].alias("word"),
        F.least(w["start"], F.col(audio)).alias("relative_start_seconds"),
        F.least(w["end"], F.col(audio)).alias("relative_end_seconds"),
        (F.col(offset) + F.least(w["start"], F.col(audio))).alias("absolute_start_seconds"),
        (F.col(offset) + F.least(w["end"], F.col(audio))).alias("absolute_end_seconds"),
        F.nanvl(w["probability"], F.lit(None).cast("double")).alias("probability"),
    )
    clamps = (F.col("end") > F.col(audio)).cast("int") + F.coalesce(F.size(F.filter("words", lambda w: w["end"] > F.col(audio))), F.lit(0))
    start, end = F.least(F.col("start"), F.col(audio)), F.least(F.col("end"), F.col(audio))
    return checked.withColumns({
        "clamp_count": clamps,
        "relative_start_seconds": start,
        "relative_end_seconds": end,
        "absolute_start_seconds": F.col(offset) + start,
        "absolute_end_seconds": F.col(offset) + end,
        "text": F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.trim(F.array_join(F.transform("words", lambda w: w["word"]), ""))),
        "words": F.transform("words", word),
    }).drop("start", "end")


def first_repeat(text: str, size: int) -> tuple[int, int] | None:
    """(first, again): the least place whose gram first stands at least `size` before it, or None.

    Grams are told apart by 64-bit hashes. Equal hashes of unlike grams can only bring a place
    forward, so that a place whose grams are equal is the right one; else grams are compared.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars) - size + 1
    if len(chars) < 2 * size:
        return None
    # a polynomial of each run of `size` characters, by doubling
    have, done, out = chars.astype(np.uint64) * MIX ^ chars, 0, np.zeros(n, np.uint64)
    for bit in range(size.bit_length()):
        power = np.uint64(pow(BASE, 1 << bit, 1 << 64))
        if size >> bit & 1:
            out = out * power + have[done : done + n]
            done += 1 << bit
        have = have[: -(1 << bit)] * power + have[1 << bit :]
    if (np.diff(np.sort(out)) != 0).all():
        return None
    order = np.argsort(out, kind="stable")
    new = np.append(True, np.diff(out[order]) != 0)
    first = np.empty(n, np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    far = np.flatnonzero(np.arange(n) - first >= size)
    if not len(far):
        return None
    again = int(far[0])
    place = int(first[again])
    if text[place : place + size] == text[again : again + size]:
        return place, again
    seen: dict[str, int] = {}
    return next(((p, i) for i in range(n) if i - (p := seen.setdefault(text[i : i + size], i)) >= size), None)


def repeated_grams(df: DataFrame, ident: Sequence[str], text: str = "text", size: int = 32) -> DataFrame:
    """(ident, first, again, gram): the first place where a gram stands at least `size` after its first stand.

    A row is judged where it is, and only what was found leaves its task. Rows that share an
    ident are judged together, gram by gram.
    """
    own = df.select(*ident, textual.without_space(F.col(text)).alias("_t")).where(F.length("_t") >= 2 * size)
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column("_t")
            got = [(i, *x, t[x[0] : x[0] + size]) for i, t in enumerate(texts.to_pylist()) if (x := first_repeat(t, size))]
            at, first, again, grams = zip(*got) if got else ((), (), (), ())
            columns = [*(part.column(c).take(pa.array(at, pa.int64())) for c in ident), pa.array(first, pa.int32()), pa.array(again, pa.int32()), pa.array(grams, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*ident, "first", "again", "gram"])

    shared = df.groupBy(*ident).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if not shared.limit(1).count():
        return own.mapInArrow(run, f"{kinds}, first int, again int, gram string")
    keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ident]
    single = own.alias("o").join(shared.alias("s"), keys, "left_anti").mapInArrow(run, f"{kinds}, first int, again int, gram string")
    several = own.alias("o").join(shared.alias("s"), keys, "left_semi")
    grams = several.select(*ident, F.posexplode(textual.grams(F.col("_t"), size)).alias("place", "gram"))
    first = grams.groupBy(*ident, "gram").agg(F.min("place").alias("first"), F.array_sort(F.collect_list("place")).alias("all"))
    again = first.select(*ident, "gram", "first", F.get(F.filter("all", lambda p: p - F.col("first") >= size), F.lit(0)).alias("again")).where("again is not null")
    return single.union(again.groupBy(*ident).agg(F.min(F.struct("again", "first", "gram")).alias("x")).select(*ident, "x.first", "x.again", "x.gram"))


def quality_gate(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text", ratio: str | None = None, max_ratio: float = MAX_RATIO, run: int = 3) -> DataFrame:
    """One row for each source: the four checks' counts, the failed ones' names and whether it passes."""
    flat = textual.collapse(F.col(text))
    # runs need to know only whether texts are equal: digests are sorted in their place
    own = df.select(*keys, *order, F.when(F.length(flat) > 0, F.sha2(flat, 256)).alias("_t"))
    base = df.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.coalesce(F.sum(textual.replacement_marks(F.col(text))), F.lit(0)).cast("long").alias("replacement_marks"),
        (F.coalesce(F.count_if(F.col(ratio) > max_ratio), F.lit(0)) if ratio else F.lit(0)).cast("long").alias("high_ratios"),
    )
    same = sequences.identical_runs(own, keys, order, "_t", run).groupBy(*keys).agg(F.count("*").alias("identical_runs"))
    grams = repeated_grams(df, [*keys, *order], text).groupBy(*keys).agg(F.count("*").alias("repeated_grams"))
    out = base.join(same, list(keys), "left").join(grams, list(keys), "left").fillna(0, ["identical_runs", "repeated_grams"])
    names = ("high_ratios", "identical_runs", "replacement_marks", "repeated_grams")
    failures = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in names]))
    return out.withColumns({"failures": failures, "passed": F.size(failures) == 0})


def worst_ratios(df: DataFrame, keys: Sequence[str], ident: str = "speech_id", ratio: str = "compression_ratio", limit: float = MAX_RATIO) -> DataFrame:
    """(keys, max_ratio, offenders): the greatest ratio of each source, and the events above the limit in order."""
    high = F.array_sort(F.collect_list(F.when(F.col(ratio) > limit, F.struct(F.col(ident).alias("id"), F.col(ratio).alias("ratio")))))
    return df.groupBy(*keys).agg(F.max(ratio).alias("max_ratio"), high.alias("offenders"))


def totals(df: DataFrame, keys: Sequence[str], elapsed: str | None = None, duration: str | None = None) -> DataFrame:
    """Segments, words and characters by source, and elapsed over duration."""
    aggs = [F.count("*").alias("segments"), F.sum(F.coalesce(F.size("words"), F.lit(0))).alias("words"), F.sum(F.length("text")).alias("characters")]
    if elapsed and duration:
        aggs.append((F.max(elapsed) / F.max(duration)).alias("real_time_factor"))
    return df.groupBy(*keys).agg(*aggs)
