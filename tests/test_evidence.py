"""Operators on small fixtures, and the boundary behaviour of each interval rule."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.functions import textual
from tessera.functions import time as clock
from tessera.operators import chapters, evaluate, joins, require, routing, sequences, speech


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_timecodes(spark):
    got = spark.createDataFrame([("90",), ("01:30",), ("1:00:00.5",), ("-3",), ("x",), ("",)], "t string").select(clock.parse_timecode(F.col("t"))).collect()
    assert [r[0] for r in got] == [90.0, 90.0, 3600.5, None, None, None]
    assert spark.range(1).select(clock.timecode(F.lit(3_661_000_500))).first()[0] == "01:01:01.000"
    assert clock.parse_seconds("01:30") == 90
    for bad in (True, None, "nan", "1:2:3:4", -1):
        with pytest.raises(ValueError):
            clock.parse_seconds(bad)


def test_point_in_segment_is_half_open(spark):
    points = spark.createDataFrame([("v", t) for t in (0, 10, 19, 20, 25)], "k string, t_us long")
    segments = spark.createDataFrame([("v", 1, 10, 20), ("v", 2, 25, 25)], "k string, sid int, start_us long, end_us long")
    assert rows(joins.points_in_segments(points, segments, ["k"], width=7).select("t_us", "sid")) == [(10, 1), (19, 1)]


def test_overlap_rules(spark):
    a = spark.createDataFrame([("v", 10, 20)], "k string, a long, b long")
    b = spark.createDataFrame([("v", 1, 0, 10), ("v", 2, 0, 11), ("v", 3, 19, 99), ("v", 4, 20, 99)], "k string, i int, s long, e long")
    assert [r.i for r in joins.overlapping(a, b, ["k"], "a", "b", "s", "e", width=6).orderBy("i").collect()] == [2, 3]
    assert [r.i for r in joins.overlapping(a, b, ["k"], "a", "b", "s", "e", closed=True, width=6).orderBy("i").collect()] == [1, 2, 3, 4]


def test_nearest_takes_the_earlier_on_a_tie(spark):
    p = spark.createDataFrame([("v", t) for t in (0, 15, 16, 99)], "k string, p long")
    s = spark.createDataFrame([("v", 10, 1), ("v", 20, 2)], "k string, t long, x int")
    assert rows(joins.nearest(p, s, ["k"], "p", "t", ["x"]).select("p", "x")) == [(0, 1), (15, 1), (16, 2), (99, 2)]


def test_bridging_and_short_runs(spark):
    a = ["p"] * 8 + ["t"] * 2 + ["p"] * 8
    assert sequences.bridge_labels(a, 3) == ["p"] * 18
    assert sequences.bridge_labels(["a", "b", "a", "b", "a"], 1) == ["a"] * 5
    df = spark.createDataFrame([("v", i, k) for i, k in enumerate(["t"] * 6)], "k string, i int, kind string")
    assert {r.kind for r in sequences.short_known(df, ["k"], ["i"], "kind", 8).collect()} == {"unknown"}


def test_greedy_gap_and_collapse(spark):
    df = spark.createDataFrame([("v", t, s) for t, s in ((0, 1.0), (5, 9.0), (10, 2.0), (30, 1.0))], "k string, t long, s double")
    assert [r.t for r in sequences.greedy_gap(df, ["k"], "t", 10, "s").collect()] == [0, 10, 30]
    assert rows(sequences.collapse(df, ["k"], "t", "s", 10).select("t", "s")) == [(5, 9.0), (30, 1.0)]
    assert sequences.spaced([(10, 1), (40, 1), (45, 2), (95, 1)], 0, 100, 30) == [(45, 2)]


def test_matching_is_one_to_one():
    assert evaluate.match_points([(10, 7, 13), (12, 9, 15)], [11]) == [(0, 0)]
    assert evaluate.match_points([(10, 9, 11), (30, 29, 31)], [10, 12, 30]) == [(0, 0), (1, 2)]
    assert evaluate.match_points([(62, 62, 65)], [65.5]) == []


def test_spans_are_counted_without_pairs_of_texts(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abé"), n)) for n in rng.integers(0, 30, 200)] + ["abababababab"] * 3
    spans = ["", "a", "abab", "abababab", "ababababa", *(t[2:14] for t in texts)]
    assert evaluate.holders(spans, texts) == {s: n for s in spans if (n := sum(s in t for t in texts))}
    own = spark.createDataFrame([("v", i, t) for i, t in enumerate([*texts, None])], "k string, anchor_id int, text string")
    got = evaluate.span_hits(own.withColumnRenamed("text", "expected_span"), own, ["k"])
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == [("v", i, sum(t in x for x in texts)) for i, t in enumerate(texts)] + [("v", len(texts), 0)]


def test_match_and_quality(spark):
    p = spark.createDataFrame([("v", 1, 10.0, 9.0, 11.0), ("v", 2, 30.0, 29.0, 31.0)], "k string, point_id int, t double, low double, high double")
    c = spark.createDataFrame([("v", 10.0), ("v", 12.0), ("v", 30.0)], "k string, t double")
    q = evaluate.selection_quality(evaluate.match(p, c, ["k"]), c, ["k"]).first()
    assert (round(q.precision, 6), q.recall, round(q.f1, 6)) == (0.666667, 1.0, 0.8)


def test_quality_gate(spark):
    gram = "abcdefghijklmnopqrstuvwxyz012345"
    df = spark.createDataFrame([("a", i, "same  text") for i in range(3)] + [("b", 0, "x" + gram + gram), ("c", 0, "bad �"), ("d", 0, "fine")], "s string, i int, text string")
    got = {r.s: (list(r.failures), r.passed) for r in speech.quality_gate(df, ["s"], ["i"]).collect()}
    assert got == {"a": (["identical_runs"], False), "b": (["repeated_grams"], False), "c": (["replacement_marks"], False), "d": ([], True)}


def plain_repeat(t: str, size: int):
    seen = {}
    for i in range(len(t) - size + 1) if len(t) >= 2 * size else ():
        if i - seen.setdefault(t[i : i + size], i) >= size:
            return seen[t[i : i + size]], i
    return None


def test_repeats_are_found_where_the_text_is(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé\U0001f600"), n)) for n in rng.integers(0, 90, 300)] + ["a" * 200, "ab" * 70, "xyz" + "q" * 64]
    for size in (4, 7, 32):
        assert [speech.first_repeat(t, size) for t in texts] == [plain_repeat(t, size) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    own = speech.repeated_grams(df, ["i"], size=7)
    # no gram is shuffled: nothing but what was found leaves a task
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert rows(own.select("i", "first", "again")) == [(i, *x) for i, t in enumerate(texts) if (x := plain_repeat(t, 7))]


def test_rows_of_one_ident_are_judged_together(spark):
    a = "abcdefghijklmnop"
    df = spark.createDataFrame([(1, "01234567" + "89ABCDEF" + a), (1, "QRSTUVWX" + "01234567" + "YZ!?#+-*"), (2, a), (None, a + a), (None, "x")], "i long, text string")
    assert sorted(map(tuple, speech.repeated_grams(df, ["i"], size=8).collect()), key=str) == [(1, 0, 8, "01234567"), (None, 0, 16, "abcdefgh")]


def test_tail_clamp(spark):
    words = "array(named_struct('word', 'a', 'start', 9.0D, 'end', 10.02D, 'probability', double('NaN')))"
    df = spark.sql(f"select 8.0D start, 10.02D end, '' text, {words} words, 100.0D range_start, 10.0D audio_seconds")
    r = speech.normalise(df).first()
    assert (r.relative_end_seconds, r.absolute_end_seconds, r.clamp_count, r.text, r.words[0].probability) == (10.0, 110.0, 2, "a", None)
    with pytest.raises(Exception, match="audio range"):
        speech.normalise(df.withColumn("end", F.lit(11.5))).collect()


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(textual.normalise(F.lit("A b-C 包线!"))).first()[0] == "abc包线"
    assert one.select(textual.normalise_match(F.lit("抱线 运线"))).first()[0] == "包线孕线"
    cue = one.select(textual.cues(F.lit("进入正题"))).first()[0]
    assert cue.score == 1.0 and cue.names == ["direct_topic_entry"]
    assert one.select(textual.keywords(F.lit("趋势 趋势 K线 and and Alpha"), limit=4)).first()[0] == ["趋势", "K线", "and", "Alpha"]
    assert one.select(textual.collapse(F.lit("a　 b c"))).first()[0] == "a b c"


def test_boundaries_are_forced_within_the_maximum():
    flat = [{"t": float(t), "discourse": 0.0, "visual": 0.0, "similarity": 0.0, "novelty": 0.5, "pause": 0.0, "score": 0.2} for t in range(40, 600, 40)]
    got = chapters.choose(flat, 0.0, 600.0, 30.0, 120.0, 160.0)
    edges = [0.0, *(t for t, _ in got), 600.0]
    assert all(b - a <= 160 for a, b in zip(edges, edges[1:])) and all(f for _, f in got)
    with pytest.raises(ValueError):
        chapters.choose([], 0.0, 600.0, 30.0, 120.0, 160.0)


def test_white_embedded_slide_is_a_presentation(spark):
    df = spark.createDataFrame([(232.46, 0.0005, 0.738, 0.0672, 0.0092, 0.0055)], "mean_luma double, dark_ratio double, bright_ratio double, edge_density double, horizontal_line_ratio double, vertical_line_ratio double")
    r = routing.classify(df).first()
    assert r.raw_kind == "presentation" and r.reasons[0] == "presentation:white_embedded_visual"


def test_coverage_and_require(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",), ("z",)], "k string")
    assert tuple(joins.coverage(a, b, "k").first()) == (2, 2, 1)
    with pytest.raises(Exception, match="no z"):
        require.require(b, "k <> 'z'", "no z").collect()
    with pytest.raises(require.Violation):
        require.same_rows(a, b, "differ")


def slide(page: int, items: int) -> np.ndarray:
    img = np.full((120, 200), 235 if page == 1 else 40, np.uint8)
    for i in range(items):
        y = 15 + 14 * i
        img[y : y + 8, 20 : 20 + 110 - 9 * i] = 60 if page == 1 else 200
    return img


def test_pixel_kernels():
    a, b = slide(1, 3), slide(1, 4)
    assert px.comparison(a, a)["score"] == 0 and px.frame_ssim(a, a) == pytest.approx(1)
    g = px.slide_geometry(a, b)
    assert g["edge_gain"] > 0 and g["retained"] >= 0.96 and g["component_count"] >= 1
    assert px.components(np.array([[1, 0, 1], [0, 1, 0]], bool)) == [(3, 3, 2)]
    assert px.perceptual_hash(a) == px.perceptual_hash(a.copy())
    with pytest.raises(ValueError):
        px.frame_delta(a, a[:-1])


