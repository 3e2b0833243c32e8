"""Images, frame folders, annotations, helper processes and documents."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import textual
from tessera.functions import time as clock
from tessera.operators import annotations, backends, joins, require
from tessera.operators.require import Violation
from tessera.plans import reports, stages
from tessera.sources import images, ledgers, media


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 99))
def test_png_round_trip(h, w, rgb, seed):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if rgb else (h, w)).astype(np.uint8)
    assert (images.read_png(images.png(img)) == img).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    import struct
    import zlib

    rng = np.random.default_rng(kind)
    img = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    lines, above = b"", np.zeros((4, 3), int)
    for row in img.astype(int):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    raw = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.read_png(raw) == img).all()
    with pytest.raises(ValueError):
        images.read_png(raw[:60])


def test_sheets():
    sheet = images.contact_sheet([("00:00:01.000", np.full((50, 100), 200, np.uint8))] * 5)
    assert sheet.shape == (2 * 245, 4 * 360, 3) and sheet[100, 180, 0] == 200 and sheet[2, 180, 0] == 0
    assert images.label("1.5").max() == 255 and images.letterbox(np.full((300, 100, 3), 9, np.uint8)).shape == (203, 360, 3)
    with pytest.raises(ValueError):
        images.contact_sheet([])


def slow_clock(times, fps, rate, start):
    out, due = [], start
    for i, t in enumerate(times):
        if t + 0.5 / fps >= due - 1e-9:
            out.append(i)
            due += 1 / rate
            while due <= t + 1e-9:
                due += 1 / rate
    return out


@pytest.mark.parametrize("fps,rate", [(30.0, 2.0), (2.0, 2.0), (3.0, 2.0), (25.0, 4.0), (7.0, 3.0), (1.0, 2.0)])
def test_clock(fps, rate):
    times = [i / fps for i in range(60)]
    assert images.clock(times, fps, rate, 0.0) == slow_clock(times, fps, rate, 0.0)
    gap = times[:10] + times[25:]
    assert images.clock(gap, fps, rate, 0.0) == slow_clock(gap, fps, rate, 0.0)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("video")
    (root / "v").mkdir()
    for i in range(8):
        (root / "v" / f"{i:04d}.png").write_bytes(images.png(np.full((20, 30, 3), 30 * i, np.uint8)))
    return root


def test_frame_folders(spark, folder):
    meta = spark.createDataFrame([("v", 2.0, 8)], "video_id string, fps double, frame_count long")
    frames = images.read_frames(spark, str(folder))
    got = images.scan(frames, meta, 1.0, 2.5).orderBy("frame_index").collect()
    assert [(r.frame_index, r.t) for r in got] == [(2, 1.0), (3, 1.5), (4, 2.0), (5, 2.5)]
    with pytest.raises(Exception, match="cannot be read"):
        images.scan(frames.where("frame_index <> 3"), meta).count()
    probes = spark.createDataFrame([("v", 0, -1.0), ("v", 1, 1.2), ("v", 2, 99.0)], "video_id string, n int, t double")
    assert sorted((r.n, r.frame_index) for r in images.frames_at(probes, frames, meta).collect()) == [(0, 0), (1, 2), (2, 7)]
    gray = images.to_gray(frames, 10).where("frame_index = 4").first()
    assert (gray.w, gray.h) == (10, 7) and set(gray.gray) == {120}
    assert [r.frame_index for r in images.sampled(images.scan(frames, meta), meta, 1.0).orderBy("frame_index").collect()] == [0, 2, 4, 6]


def test_content_cuts(spark):
    rows = [("v", i, i * 500_000, d) for i, d in enumerate([0.0, 0.2, 0.0, 0.3, 0.01, 0.2])]
    own = spark.createDataFrame(rows, "video_id string, sample_index long, t_us long, pixel_delta double")
    assert [r.cut_us for r in images.content_cuts(own, ["video_id"]).orderBy("cut_us").collect()] == [0, 1_500_000, 2_500_000]


def test_coarse_grid(spark):
    meta = spark.createDataFrame([("v", 10.0, 1000)], "video_id string, fps double, frame_count long")
    times = lambda *a: [r.t for r in media.coarse_grid(meta, *a).orderBy("position").collect()]
    assert times(30.0, 9) == [0.0, 30.0, 60.0, 90.0, 99.9] and times(25.0, 9) == [0.0, 25.0, 50.0, 75.0, 99.9]
    assert times(100.0, 9) == [0.0, 99.9] and times(50.0, 9, 99.0) == [99.0]
    with pytest.raises(Exception, match="more frames"):
        times(30.0, 4)


# ---- annotations -------------------------------------------------------------------------

REVIEW = {"coverage": "exhaustive", "scope": "full_segment", "unlisted_states": "reject", "source_review": {"basis": "source_video", "full_segment_watched": True, "algorithm_outputs_used_as_labels": False}, "confirmation": {"confirmed_by": "user", "labels_complete": True, "plateau_windows_confirmed": True}}
DOC = {"schema_version": 4, "video": "v.mp4", "review_status": "human_reviewed", "segment": {"start": "00:10", "duration": 60}, "review": REVIEW, "must_keep": [{"timestamp": 20}, {"timestamp": 40, "acceptable_start": 38, "acceptable_end": 45}], "nice_to_keep": [{"timestamp": "00:50"}], "avoid_duplicates": [{"start": 15, "end": 25, "max_selected_frames": 1}]}


def test_annotations_must_be_whole():
    assert annotations.problems(DOC, "v.mp4", 10.0, 60.0) == []
    for change, part in (({"video": "w.mp4"}, "another video"), ({"source_sha256": "x"}, "another source"), ({"segment": {"start": 11}}, "range"), ({"review_status": "draft"}, "human_reviewed"), ({"schema_version": "x"}, "schema_version"), ({"review": {"coverage": "all"}}, "one of")):
        assert any(part in p for p in annotations.problems(DOC | change, "v.mp4", 10.0, 60.0, "y")), change
    for key in ("source_review", "confirmation"):
        bad = {k: v for k, v in REVIEW.items() if k != key}
        assert len(annotations.problems(DOC | {"review": bad}, "v.mp4", 10.0, 60.0)) == 3
        assert annotations.problems(DOC | {"review": bad, "schema_version": 3}, "v.mp4", 10.0, 60.0) == []
    with pytest.raises(Violation):
        annotations.validate(DOC, "w.mp4", 10.0, 60.0)


def test_selection_scores():
    got = annotations.evaluate_selection(DOC, [20.5, 22.0, 41.0])
    q = got["selection_quality"]
    assert (q["accepted_matches"], q["accepted_states"]) == (2, 3) and q["precision"] == q["recall"] == pytest.approx(2 / 3) and q["f1"] == pytest.approx(2 / 3)
    assert got["ground_truth"] == "human_reviewed_full_segment" and not got["avoid_duplicates"]["items"][0]["passed"] and got["must_keep"]["median_error_seconds"] == 0.75
    part = DOC | {"review": {"coverage": "strategy_candidate_set", "scope": "selected_candidates", "unlisted_candidates": "reject", "strategy": "settled", "strategy_file_sha256": "a" * 64, "reviewed_candidate_count": 1}}
    assert annotations.evaluate_selection(part, [20.0], "settled", "a" * 64)["selection_quality"]["recall"] is None
    for times, sha in (([20.0], "b" * 64), ([20.0, 21.0], "a" * 64)):
        with pytest.raises(Violation):
            annotations.evaluate_selection(part, times, "settled", sha)
    loose = annotations.evaluate_selection({"must_keep": [{"timestamp": 10}, {"timestamp": 12}]}, [11.0])
    assert loose["must_keep"]["matched"] == 1 and loose["must_keep"]["recall"] == 0.5 and loose["selection_quality"] is None
    assert loose["ground_truth"] == "annotation_yaml_not_confirmed_as_ground_truth"
    for bad in ({"timestamp": 5, "acceptable_start": 1}, {"timestamp": 5, "acceptable_start": 6, "acceptable_end": 7}, {"timestamp": 5, "tolerance_seconds": -1}, {}):
        with pytest.raises(Violation):
            annotations.point(bad)


def test_curated_points():
    assert annotations.curated_points(DOC, 10.0, 70.0) == [(20.0, "must_keep"), (40.0, "must_keep")]
    for change in ({"review_status": "draft"}, {"segment": None}, {"must_keep": []}, {"must_keep": [{"timestamp": 20}, {"timestamp": 20}]}, {"must_keep": [{"timestamp": 80}]}):
        with pytest.raises(Violation):
            annotations.curated_points(DOC | change, 10.0, 70.0)


def test_anchors_are_bound():
    times = {"relative_start_seconds": 0.0, "relative_end_seconds": 1.0, "absolute_start_seconds": 5.0, "absolute_end_seconds": 6.0}
    seg, own = [{"id": 1, "text": "wrong words", **times}], {"id": "a", "segment_id": 1, "baseline_text": "wrong words", "baseline_span": "wrong", "expected_span": "right", **times}
    assert annotations.bound_anchors([own], seg) == []
    for change in ({"segment_id": 2}, {"baseline_text": "x"}, {"relative_end_seconds": 1.1}, {"baseline_span": "none"}, {"expected_span": ""}):
        assert annotations.bound_anchors([own | change], seg)
    assert annotations.bound_anchors([own, own], seg) == ["anchor 1 has no id of its own"]


# ---- helpers -----------------------------------------------------------------------------

def helper(tmp_path, body: str) -> tuple[str, ...]:
    path = tmp_path / "helper.py"
    path.write_text(f"import json, sys\nq = json.load(sys.stdin)\n{body}")
    return (sys.executable, str(path))


def test_text_helper(tmp_path):
    good = helper(tmp_path, "print(json.dumps({'protocol': q['protocol'], 'image_sha256': q['image_sha256'], 'observations': [{'text': q['route_kind'], 'confidence': 0.5, 'bbox': [0, 0, 1, 1]}]}))")
    assert backends.ProcessOcr(good).recognize(b"x", ["en"], "table", (0, 0, 1, 1))[0]["text"] == "table"
    for body in ("print('no')", "sys.exit(65)", "print(json.dumps({'protocol': 'x'}))", "print(json.dumps({'protocol': q['protocol'], 'image_sha256': 'y', 'observations': []}))", "import time; time.sleep(9)"):
        with pytest.raises(backends.Unavailable):
            backends.ProcessOcr(helper(tmp_path, body), seconds=2.0).recognize(b"x", ["en"], "table", (0, 0, 1, 1))
    with pytest.raises(backends.Unavailable):
        backends.call(["/no/such/helper"], {}, "p", 1.0)


class Ears:
    def describe(self):
        return {"engine": "fake"}

    def transcribe(self, audio, language, prompt, profile):
        if audio == b"bad":
            raise RuntimeError("no model")
        if audio == b"mute":
            return {"segments": []}
        text = "again" if audio == b"loop" else "part"
        return {"segments": [{"start": float(i), "end": i + 0.5, "text": f"{text}{'' if audio == b'loop' else i}", "compression_ratio": float("nan") if i else 1.2, "words": [{"word": text, "start": float(i), "end": i + 0.4}]} for i in range(4)]}


def test_speech_stage(spark):
    audio = spark.createDataFrame([("a", 100.0, 10.0, b"fine"), ("b", 0.0, 10.0, b"bad"), ("c", 0.0, 10.0, b"loop"), ("d", 0.0, 10.0, b"mute")], "video_id string, range_start double, audio_seconds double, content binary")
    raw = backends.transcribe(audio, Ears, "zh", "  words ").cache()
    out = backends.asr_ledger(raw)
    segments = out["segments"].where("video_id = 'a'").orderBy("speech_id").collect()
    assert [s.absolute_start_seconds for s in segments] == [100.0, 101.0, 102.0, 103.0] and segments[1].compression_ratio is None
    assert {(r.video_id, r.stage, r.error_type) for r in out["failures"].collect()} == {("b", "transcribe", "RuntimeError"), ("c", "quality_gate", "QualityGate"), ("d", "transcribe", "NoSpeech")}
    for bad in ("a\x07b", " ", "x" * 1001):
        with pytest.raises(ValueError):
            backends.prompt(bad)
    with pytest.raises(ValueError):
        backends.transcribe(audio, Ears, "zh", profile="best")


def test_boxes(spark):
    one = spark.range(1)
    lit = [F.lit(x) for x in (0.1, 0.2, 0.55, 0.5, 101, 50)]
    r = one.select(backends.pixel_region(*lit).alias("r")).first().r
    assert (r.left, r.top, r.right, r.bottom) == (10, 10, 66, 35) and r.x == pytest.approx(10 / 101)
    box = one.select(backends.whole_image_box(F.array(F.lit(0.0), F.lit(0.75), F.lit(0.5), F.lit(0.5)), F.struct(F.lit(0.2).alias("x"), F.lit(0.4).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))).alias("b")).first().b
    assert box == [0.2, 0.4, 0.25, 0.125]
    obs = "array(named_struct('order', 0, 'text', 'b', 'confidence', 1.0D, 'bbox', array(0.5D, 0.2D, 0.1D, 0.1D)), named_struct('order', 1, 'text', 'a', 'confidence', 1.0D, 'bbox', array(0.1D, 0.2D, 0.1D, 0.1D)), named_struct('order', 2, 'text', 'first', 'confidence', 1.0D, 'bbox', array(0.9D, 0.1D, 0.1D, 0.1D)))"
    got = one.select(backends.reading_order(F.expr(obs)).alias("o")).first().o
    assert [(x.order, x.text) for x in got] == [(0, "first"), (1, "a"), (2, "b")]


# ---- documents ---------------------------------------------------------------------------

def test_fields():
    f = ledgers.Fields({"a": {"n": 1.5, "i": 3, "t": "x", "l": [], "e": "visual-0012"}})
    a = f.fields("a")
    assert (a.number("n"), a.integer("i"), a.text("t"), a.items("l"), a.event("e", "visual")) == (1.5, 3, "x", [], "visual-0012")
    for get in (lambda: f.fields("b"), lambda: a.integer("n"), lambda: a.text("l"), lambda: a.items("t"), lambda: a.event("e", "speech"), lambda: ledgers.Fields({"x": True}).number("x"), lambda: ledgers.Fields({"x": float("nan")}).number("x")):
        with pytest.raises(Violation):
            get()


def test_binding(spark):
    a = spark.createDataFrame([("v", "h1", "m"), ("w", "h2", "m")], "video_id string, video_sha256 string, manifest_sha256 string")
    ledgers.bind(run=a, ocr=a.select("video_id", "video_sha256"))
    with pytest.raises(Violation, match="run and ocr"):
        ledgers.bind(run=a, ocr=a.withColumn("video_sha256", F.lit("h1")))
    s = spark.createDataFrame([("v", 1, 0, 5, "x"), ("v", 2, 5, 9, "y")], "video_id string, speech_id long, start_us long, end_us long, text string")
    ledgers.same_speech(s, s)
    with pytest.raises(Violation):
        ledgers.same_speech(s, s.withColumn("text", F.lit("z")))


def test_kinds_of_segments(spark):
    frames = spark.createDataFrame([("v", "r1"), ("v", "r2"), ("v", "r3"), ("v", None)], "video_id string, segment_id string")
    mine = spark.createDataFrame([("v", "r1", "table")], "video_id string, segment_id string, kind string")
    all_ = spark.createDataFrame([("v", "r1", "chart"), ("v", "r2", "chart")], "video_id string, segment_id string, kind string")
    got = {r.segment_id: r.route_kind for r in joins.source_kind(frames, mine, all_, ["video_id"]).collect()}
    assert got == {"r1": "table", "r2": "chart", "r3": "unknown", None: "unknown"}


def test_names_lists_and_numbers(spark):
    own = spark.createDataFrame([("Ｖｉｄｅｏ １ (final).mp4",), ("...",), (None,), ("a" * 100,)], "t string").select(textual.safe_name("t").alias("n")).collect()
    assert [r.n for r in own] == ["Video-1-final-mp4", "run", None, "a" * 72]
    one = spark.range(1)
    assert one.select(textual.clean_list(F.array(*map(F.lit, (" a", "b", "a ", "", " "))))).first()[0] == ["a", "b"]
    ready = textual.json_ready(one.select(F.lit(float("nan")).alias("a"), F.lit(2.5).alias("b"), F.array(F.lit(1.0), F.lit(float("inf"))).alias("c"), F.lit("x").alias("d"))).first()
    assert tuple(ready) == (None, 2.5, [1.0, None], "x")
    told = textual.public(one.select(F.lit(1 / 3).alias("a"), F.array(F.lit(2 / 3)).alias("b"), F.lit(3).alias("c"))).first()
    assert tuple(told) == (0.333333, [0.666667], 3)
    assert one.select(clock.plain_duration(F.lit(59.9996)), clock.plain_duration(F.lit(3661.25))).first()[:] == ("00:00:60.000", "01:01:01.250")
    assert stages.unique_names(["a", "A", "a", "b"], ["B"]) == ["a", "A-2", "a-3", "b-2"]
    require.ratios(x=0.5)
    for f, v in ((require.ratios, 1.5), (require.positive, 0), (require.positive, float("inf"))):
        with pytest.raises(ValueError):
            f(x=v)
    assert require.at_most(one, 1, "no").count() == 1
    with pytest.raises(Violation):
        require.at_most(spark.range(3), 2, "too many")


def test_landing(tmp_path):
    target = stages.land([b"ab", b"c"], 3, tmp_path / "x.mp4", lambda p: None)
    assert target.read_bytes() == b"abc"

    def refuse(path):
        raise Violation("no video")

    for parts, size, check in (([b"ab"], 3, lambda p: None), ([b"abc"], 3, refuse)):
        with pytest.raises(Violation):
            stages.land(parts, size, tmp_path / "y.mp4", check)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.mp4"]
    assert stages.confined(tmp_path, "a/b.png") == tmp_path.resolve() / "a/b.png"
    for bad in ("../x", "/etc/passwd", "a/.hidden"):
        with pytest.raises(Violation):
            stages.confined(tmp_path, bad)


def test_pages_escape():
    rows = [{"t_us": 1_000_000, "image_path": "a b/c.png", "status": "selected", "score": 0.5, "reasons": ["<x>"], "segment_id": None}]
    body = reports.visual_review("<t>", {"settled": rows}, {"settled": {"raw_candidates": 1}}, [{"segment_id": "route-001", "kind": "table", "start_us": 0, "left": 0.0, "width": 100.0, "empty": True, "confidence": 0.5}]).decode()
    assert "<x>" not in body and "a%20b/c.png" in body and "00:00:01.000" in body and "no frame selected" in body and "script-src" not in body
    chapter = reports.chapter_review("c", [{"chapter_id": "chapter-001", "title": "<script>", "start_us": 0, "end_us": 5, "raw_text": "x", "keywords": ["k"], "forced": True}], {}).decode()
    assert chapter.count("<script>") == 1 and "script-src 'sha256-" in chapter and "forced" in chapter
    assert b"route_kind" in reports.ocr_review("o", [{"status": "error", "t_us": 0, "route_kind": "table", "error": "E"}])
    assert b"stage" in reports.asr_review("a", [{"start_us": 0, "end_us": 1, "text": "t"}], {"passed": False}, {"stage": "x", "error_type": "y", "error": "z"})
    assert b"before" in reports.alignment_review("l", [{"t_us": 0, "event_id": "visual-0001", "status": "s", "speech": ["a"], "nearby": [{"relation": "before", "gap_us": 5, "text": "b"}]}], {"frames": 1})
    assert b'href="run/x.html"' in reports.status_page("w", {"visual": "ok"}, "E", {"visual": "run/x.html"}) and b"scan" in reports.scan_review("scan", [{"timestamp": 1.0, "image_path": "x.png"}], 0.0, 2.0)
