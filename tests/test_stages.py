"""Stage drivers on a small source, and what they refuse."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators.require import Violation
from tessera.plans import stages

S = 1_000_000


def source(spark):
    speech = spark.createDataFrame([("v", i, i * 40 * S, i * 40 * S + 30 * S, f"part {i} " + "alpha beta gamma delta"[: 8 + i]) for i in range(15)], "video_id string, speech_id long, start_us long, end_us long, text string")
    ranges = spark.createDataFrame([("v", 0, 600 * S)], "video_id string, range_start_us long, range_end_us long")
    frames = spark.createDataFrame([("v", i, i * 80 * S) for i in range(7)], "video_id string, sample_index long, t_us long")
    return speech, ranges, frames


def test_align(spark):
    speech, ranges, frames = source(spark)
    ocr = frames.withColumn("status", F.lit("ok"))
    out = stages.align(frames, ocr, speech, ranges)
    assert out["summary"].collect()[0].frames == 7 and out["timeline"].count() == 22
    with pytest.raises(Violation, match="one to one"):
        stages.align(frames, ocr.where("sample_index > 0"), speech, ranges)
    with pytest.raises(Violation, match="outside"):
        stages.align(frames, ocr, speech.withColumn("end_us", F.col("end_us") + 600 * S), ranges)


def test_semantic_covers_every_event(spark):
    speech, ranges, _ = source(spark)
    titles = spark.createDataFrame([("v", 1, 200 * S, "alpha beta gamma", 0.9)], "video_id string, title_id long, t_us long, title string, confidence double")
    out = stages.semantic(speech, titles, ranges, most=160.0, target=120.0)
    parts = out["chapters"].orderBy("start_us").collect()
    assert parts[0].start_us == 0 and parts[-1].end_us == 600 * S
    assert all(a.end_us == b.start_us for a, b in zip(parts, parts[1:])) and all(p.end_us - p.start_us <= 160 * S for p in parts)
    assert sum(len(p.speech_ids) for p in parts) == 15
    with pytest.raises(ValueError):
        stages.semantic(speech, titles, ranges, least=200.0)


def test_review_is_escaped_and_batches_go_on():
    assert b"<script>" not in stages.review_html("x", [{"a": "<script>"}], ["a"])

    def work(item):
        if item == "b":
            raise RuntimeError("no")

    assert stages.run_batch(["a", "b", "c"], work)["status"] == "partial"
    with pytest.raises(ValueError):
        stages.run_batch(["a", "a"], work)
