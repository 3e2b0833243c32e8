"""The selector machine and the visual stage on small clips whose states are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.operators import automata, selectors
from tessera.operators.require import Violation
from tessera.plans import visual


def clip(frames, fps=2.0, last=None):
    return automata.Clip([i / fps for i in range(len(frames))], frames, fps, last)


def slide(page: int, items: int) -> np.ndarray:
    img = np.full((120, 200), 235 if page == 1 else 40, np.uint8)
    for i in range(items):
        y = 15 + 14 * i
        img[y : y + 8, 20 : 20 + 110 - 9 * i] = 60 if page == 1 else 200
    return img


def sheet(offset: int, focus: int | None = None) -> np.ndarray:
    """A worksheet whose rows of cells move with the offset; focus shades one row."""
    img = np.full((120, 200), 250, np.uint8)
    img[::15] = 120
    rng = np.random.default_rng(offset)
    for y in range(31, 112, 15):
        for x in range(4, 196, 16):
            img[y + 3 : y + 10, x : x + int(rng.integers(3, 13))] = 30
    if focus is not None:
        y = 31 + 15 * focus
        img[y : y + 13] = np.minimum(img[y : y + 13], 200)
    return img


def bar(width: int) -> np.ndarray:
    img = np.zeros((96, 160), np.uint8)
    img[20:70, 10 : 10 + width] = 200
    return img


def test_settled_waits_for_the_picture_and_scores_its_peak():
    frames = [bar(0)] * 4 + [bar(w) for w in (25, 50, 75, 100)] + [bar(100)] * 6
    got = automata.Settled(clip(frames)).run()
    assert [i for i, _, _ in got] == [11] and got[0][2] == ["settled_after_change"] and got[0][1] >= 0.4
    tail = automata.Settled(clip([bar(0)] * 4 + [bar(w) for w in range(10, 120, 10)])).run()
    assert tail[-1][0] == 14 and tail[-1][2] == ["segment_end_after_change"] and 0.3 <= tail[-1][1]
    assert automata.Settled(clip([bar(5)] * 10)).run() == []


def test_the_gap_keeps_a_state_from_being_shown_but_moves_the_base():
    frames = [bar(0)] * 3 + [bar(60)] * 3 + [bar(120)] * 12
    shown = automata.Settled(clip(frames), hold=1.0, gap=30.0).run()
    assert len(shown) == 1 and shown[0][0] == 5


def test_slides_emit_the_last_of_each_build():
    frames = [slide(1, n) for n in (1, 2, 3) for _ in range(6)] + [slide(2, 2)] * 8
    got = automata.presentation_states(clip(frames))
    assert len(got) == 2 and 12 <= got[0][0] < 18 and got[1][0] >= 18
    assert got[0][2][-2:] == ["presentation:additive_build_final", "presentation:page_terminal"]
    assert got[1][2] == ["presentation:hard_page_change", "presentation:page_change", "presentation:bounded_tail_stable"]
    again = automata.presentation_states(clip([*frames, *[slide(1, 3)] * 8]))
    assert len(again) == 2  # a slide that was seen is no new state
    with pytest.raises(ValueError):
        automata.presentation_states(clip(frames, fps=0.5))


def test_slides_do_not_emit_look_ahead():
    frames = [slide(1, 2)] * 8 + [slide(2, 2)] * 8
    got = automata.presentation_states(clip(frames, last=7))
    assert [i for i, _, _ in got] == [2] and got[0][2] == ["presentation:initial_stable", "presentation:bounded_tail_stable"]


def test_worksheets_tell_scrolling_from_focus():
    frames = [sheet(0)] * 6 + [sheet(1)] * 16
    got = automata.Worksheet(clip(frames)).run()
    assert [r for _, _, r in got] == [["table_viewport:initial_stable"], ["table_viewport:post_transition"]] and got[0][1] == 0.10
    moved = [sheet(0, 0)] * 6 + [sheet(0, 3)] * 16
    assert len(automata.Worksheet(clip(moved)).run()) == 1
    assert [r for _, _, r in automata.Worksheet(clip(moved), focus=True).run()][-1] == ["table_focus:post_row_focus"]
    back = frames + [sheet(0)] * 16
    assert len(automata.Worksheet(clip(back)).run()) == 2  # distinct from every state before
    assert automata.Worksheet(clip(frames, last=0)).run() == []
    assert len(automata.Worksheet(clip(frames, last=6)).run()) == 1  # the state would rest in the look-ahead


def drawn(n: int) -> np.ndarray:
    img = np.full((96, 160), 20, np.uint8)
    for k in range(n):
        img[10 + 9 * k : 14 + 9 * k, 12:150:3] = 230
    return img


def test_the_last_picture_before_a_replacement():
    frames = [drawn(n) for n in (2, 4, 6, 8) for _ in range(2)] + [drawn(8)] * 4 + [drawn(0)] * 10
    got = automata.boundary_terminal(clip(frames))
    assert [i for i, _, _ in got] == [11] and got[0][2] == ["boundary_terminal:boundary=6.000"]
    ahead = automata.boundary_terminal(clip(frames, last=9))
    assert [i for i, _, _ in ahead] == [9] and ahead[0][2] == ["boundary_terminal:boundary=6.000", "lookahead_confirmed_terminal", "actual_terminal=5.500"]
    assert automata.boundary_terminal(clip(frames[:12])) == []  # nothing replaced it yet
    flash = [drawn(0)] * 4 + [drawn(8)] * 2 + [drawn(0)] * 10
    assert automata.boundary_terminal(clip(flash)) == []  # what was there before came back


def test_the_score_is_the_greatest_of_the_medians():
    frames = [drawn(8)] * 8 + [drawn(0)] * 8
    (_, score, _), = automata.boundary_terminal(clip(frames))
    before, after = frames[7], frames[8]
    apart = np.abs(before.astype(int) - after)
    assert score == pytest.approx(max(apart.mean() / 255, px.edge_density(before) - px.edge_density(after), (apart >= 12).mean()))


def test_equal_pictures_are_compared_once():
    seen = []
    kernel = px.remembered(lambda a, b: seen.append(1) or float(np.abs(a.astype(int) - b).sum()))
    a, b = slide(0, 1), slide(0, 2)
    assert kernel(a, b) == kernel(a.copy(), b.copy()) == float(np.abs(a.astype(int) - b).sum()) and len(seen) == 1
    kernel(b, a), kernel(a.reshape(-1, a.shape[1] // 2), b.reshape(-1, b.shape[1] // 2))
    assert len(seen) == 3  # order and shape count
    still = clip([a.copy() for _ in range(40)] + [b.copy() for _ in range(40)])
    asked = []
    compare = still.pairs(lambda x, y: asked.append(1) or float(px.frame_delta(x, y)))
    assert [compare(i - 1, i) for i in range(1, 80)] == [px.frame_delta(still.images[i - 1], still.images[i]) for i in range(1, 80)]
    assert len(asked) == 3  # still, change, still


def test_duplicates_keep_the_higher_rank_then_the_later():
    base = np.zeros((96, 160), np.uint8)
    other = base.copy()
    other[:40, :40] = 200

    def rows(*cells):
        return [{"sample_index": i, "t_us": i, "score": s, "rank": r, "reasons": [f"r{i}"], "image": x} for i, (x, s, r) in enumerate(cells)]

    same = lambda a, b: selectors.measured(a["image"], b["image"])
    kept, dropped = selectors.fold_duplicates(rows((base, 0.1, 1), (base, 0.1, 1), (other, 0.1, 1)), same)
    assert [k["sample_index"] for k in kept] == [1, 2] and kept[0]["reasons"] == ["r0", "r1"] and dropped[0]["measured"] == (0, 1.0, 0.0)
    kept, dropped = selectors.fold_duplicates(rows((base, 0.1, 4), (base, 0.9, 3)), same)
    assert [k["sample_index"] for k in kept] == [0] and dropped[0]["sample_index"] == 1 and dropped[0]["duplicate_of_us"] == 0
    assert len(selectors.fold_duplicates(rows(*[(base if i % 7 == 0 else np.full_like(base, 30 * (i % 7)), 0.1, 1) for i in range(8)]), same, window=6)[0]) == 8


@pytest.fixture(scope="module")
def stage(spark):
    """Two sources: slides that build and turn, and a worksheet that scrolls, with look-ahead."""
    a = [slide(1, n) for n in (1, 2, 3) for _ in range(8)] + [slide(2, n) for n in (1, 3) for _ in range(10)] + [slide(1, 1)] * 20
    b = [sheet(k) for k in (0, 1) for _ in range(20)] + [sheet(2)] * 30
    rows = [(v, i, i / 2.0, *x.shape, x.tobytes()) for v, own in (("a", a), ("b", b)) for i, x in enumerate(own)]
    frames = spark.createDataFrame(rows, "video_id string, frame_index long, t double, h int, w int, gray binary")
    return visual.build_samples(frames).cache()


def test_samples_compare_neighbours(stage):
    rows = stage.where("video_id = 'a'").orderBy("sample_index").collect()
    assert rows[0].change_score == 0 and rows[0].ssim_previous == 1 and rows[0].pixel_delta == 0
    want = px.comparison(slide(1, 3), slide(2, 1))
    assert rows[24].change_score == pytest.approx(want["score"]) and rows[24].phash_delta == want["phash_delta"] and rows[1].change_score == pytest.approx(0, abs=1e-12)


def test_visual_stage(spark, stage):
    ranges = spark.createDataFrame([("a", 0.0, 26.0), ("b", 0.0, 20.0)], "video_id string, range_start double, range_end double")
    cuts = spark.createDataFrame([("a", 0, "scenedetect_content"), ("a", 12_000_000, "scenedetect_content"), ("b", 0, "scenedetect_content")], "video_id string, cut_us long, reason string")
    p = visual.Parameters(duration=26.0, strategies=("uniform", "content", "adaptive", "settled", "hybrid", "presentation_states", "boundary_terminal", "table_viewport"), interval=10.0)
    out = visual.run_visual(stage, cuts, ranges, p)
    ledger = out["ledger"].cache()
    assert ledger.where("t_us > 26000000").count() == 0
    uniform = [r.sample_index for r in ledger.where("video_id = 'a' and strategy = 'uniform'").orderBy("sample_index").collect()]
    assert uniform == [0, 20, 40, 52]
    hybrid = ledger.where("video_id = 'a' and strategy = 'hybrid'")
    parts = ledger.where("video_id = 'a' and strategy in ('uniform', 'content', 'adaptive', 'settled')")
    assert {r.sample_index for r in hybrid.collect()} == {r.sample_index for r in parts.collect()}
    dropped = ledger.where("status = 'duplicate'").collect()
    assert dropped and all(r.phash_distance <= 4 and r.ssim >= 0.996 and r.block_change <= 0.012 for r in dropped)
    slides = ledger.where("video_id = 'a' and strategy = 'presentation_states'").orderBy("t_us").collect()
    assert [r.reasons[-1] for r in slides] == ["presentation:page_terminal", "presentation:bounded_tail_stable"]
    assert ledger.where("video_id = 'b' and strategy = 'table_viewport'").count() == 2
    m = {(r.video_id, r.strategy): r for r in out["metrics"].collect()}
    assert m["a", "uniform"].raw_candidates == 4 and m["a", "uniform"].candidate_frames_per_minute == pytest.approx(m["a", "uniform"].selected_frames / (26 / 60))
    assert m["a", "hybrid"].duplicate_drop_ratio == pytest.approx(ledger.where("video_id = 'a' and strategy = 'hybrid' and status = 'duplicate'").count() / m["a", "hybrid"].raw_candidates)
    need = out["images"].groupBy("purpose").count().collect()
    assert {r.purpose for r in need} == {"thumbnail", "evidence"}


def test_caps_are_told(spark, stage):
    ranges = spark.createDataFrame([("a", 0.0, 26.0)], "video_id string, range_start double, range_end double")
    cuts = spark.createDataFrame([], "video_id string, cut_us long, reason string")
    out = visual.run_visual(stage.where("video_id = 'a'"), cuts, ranges, visual.Parameters(duration=26.0, strategies=("uniform",), interval=2.0, most=3))
    n = {r.status: r["count"] for r in out["ledger"].groupBy("status").count().collect()}
    assert n["selected"] == 3 and n["capped"] >= 1


def test_routed_segments_use_the_selector_of_their_kind(spark, stage):
    ranges = spark.createDataFrame([("a", 0.0, 26.0), ("b", 0.0, 20.0)], "video_id string, range_start double, range_end double")
    cuts = spark.createDataFrame([], "video_id string, cut_us long, reason string")
    # page 2 and page 1 are told apart by layout; the plan is made of what the features say
    out = visual.run_visual(stage, cuts, ranges, visual.Parameters(duration=26.0, strategies=("routed",)))
    plan = out["segments"].orderBy("video_id", "start_index").collect()
    assert {r.kind for r in plan} <= {"presentation", "table", "chart", "unknown"} and all(r.candidates >= 0 for r in plan)
    for r in out["ledger"].collect():
        own = next(s for s in plan if (s.video_id, s.segment_id) == (r.video_id, r.segment_id))
        assert own.start_index <= r.sample_index < own.stop_index and f"route:kind={own.kind}" in r.reasons and f"route:selector={own.selector}" in r.reasons
    assert out["ledger"].count() > 0
    with pytest.raises(Violation):
        visual.run_visual(stage, cuts, ranges, visual.Parameters(duration=26.0, strategies=("routed",), most=1))


def test_parameters_are_checked():
    assert visual.Parameters(strategies=("boundary_terminal", "table_focus")).ahead == 15.0 and visual.Parameters().ahead == 0.0
    for bad in ({"strategies": ("best",)}, {"strategies": ()}, {"duration": 721}, {"rate": 5}, {"rate": 0.5, "strategies": ("routed",)}, {"width": 100}, {"most": 0}, {"duration": 0}):
        with pytest.raises(ValueError):
            visual.Parameters(**bad)
    assert visual.Parameters(duration=721, allow_long=True).duration == 721


def test_ranks_decide_caps_and_duplicates(spark):
    rows = [("v", 0, 0, 0.9, ["density_floor"]), ("v", 1, 1, 0.1, ["settled_after_change"]), ("v", 2, 2, 0.5, ["scenedetect_adaptive"]), ("v", 3, 3, 0.8, ["adaptive_change_settled"]), ("v", 4, 4, 0.7, ["presentation:page_terminal"])]
    own = spark.createDataFrame(rows, "v string, sample_index long, t_us long, score double, reasons array<string>")
    got = {r.sample_index: r.r for r in own.select("sample_index", selectors.priority()["rank"].alias("r")).collect()}
    assert got == {0: 1, 1: 4, 2: 3, 3: 2, 4: 1}
    kept = [r.sample_index for r in selectors.cap(own, ["v"], 1).where(F.col("kept")).collect()]
    assert kept == [1]
