"""Commands over a small video: a folder of frames, its audio, and helper processes."""

from __future__ import annotations

import json
import struct
import sys
from pathlib import Path

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from tessera.operators.require import Violation
from tessera.plans import commands, visual
from tessera.sources import images

OCR = """
import json, sys
q = json.load(sys.stdin)
rows = [{'text': 'alpha beta topic', 'confidence': 0.9, 'bbox': [0.1, 0.05, 0.5, 0.1]}]
print(json.dumps({'protocol': q['protocol'], 'image_sha256': q['image_sha256'], 'observations': rows}))
"""
ASR = """
import json, sys
q = json.load(sys.stdin)
rows = [{'start': 4.0 * i, 'end': 4.0 * i + 3.5, 'text': f'part {i} of the alpha beta topic', 'compression_ratio': 1.1} for i in range(14)]
print(json.dumps({**{k: q[k] for k in ('protocol', 'audio_sha256', 'prompt_sha256', 'prompt_length', 'decoding_profile')}, 'segments': rows}))
"""


def words(page: int, lines: int) -> np.ndarray:
    """A slide of marks like words on a gray page."""
    img = np.full((120, 200), 150, np.uint8)
    rng = np.random.default_rng(page)
    for k in range(lines):
        for x in range(12, 180, 12):
            img[16 + 12 * k : 21 + 12 * k, x : x + int(rng.integers(3, 8))] = 30
    return img


@pytest.fixture(scope="module")
def video(tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    (root / "v").mkdir()
    shown = [words(1, n) for n in (2, 4, 6) for _ in range(8)] + [words(2, n) for n in (3, 7) for _ in range(12)] + [words(3, 5)] * 64
    for i, img in enumerate(shown):
        (root / "v" / f"{i:05d}.png").write_bytes(images.png(np.repeat(img[..., None], 3, 2)))
    meta = {"video_id": "v", "fps": 2.0, "frame_count": len(shown), "width": 200, "height": 120, "fingerprint": "f" * 64}
    (root / "sources.json").write_text(json.dumps([meta]))
    data = b"\0\0" * (16000 * len(shown) // 2)
    (root / "v.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
    for name, body in (("ocr.py", OCR), ("asr.py", ASR)):
        (root / name).write_text(body)
    return root


def run(spark, *args):
    return commands.run(commands.parser().parse_args([str(a) for a in args]), spark)


def test_probe_scan_and_curate(spark, video, tmp_path):
    assert run(spark, "probe", video)["sources"][0]["duration_seconds"] == 56.0
    got = run(spark, "scan", video, "--output", tmp_path / "scan", "--interval", 20)
    assert got["frame_count"] == 4 and (tmp_path / "scan" / "scan-v.html").exists() and (tmp_path / "scan" / "contact-sheet-v.png").exists()
    doc = {"video": "v", "review_status": "human_reviewed", "segment": {"start": 0, "duration": 56}, "must_keep": [{"timestamp": 10}, {"timestamp": "00:30"}]}
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(doc))
    assert run(spark, "curate", video, "--annotations", tmp_path / "a.yaml", "--output", tmp_path / "curated")["selected"] == 2
    done = json.loads((tmp_path / "curated" / "manifest.json").read_text())
    assert done["selected"][1]["timestamp"] == 30.0 and images.read_png((tmp_path / "curated" / done["selected"][1]["image_path"]).read_bytes()).shape == (120, 200, 3)
    with pytest.raises(Violation):
        run(spark, "scan", video, "--output", tmp_path / "scan")
    with pytest.raises(Violation):
        run(spark, "scan", video, "--output", video / "inside")


def test_benchmark_and_evaluate(spark, video, tmp_path):
    out = tmp_path / "run"
    got = run(spark, "benchmark", video, "--output", out, "--start", 0, "--duration", 40, "--strategies", "uniform,settled,presentation_states", "--uniform-interval", 10)
    by = {m["strategy"]: m for m in got["metrics"]}
    assert by["uniform"]["raw_candidates"] == 5 and by["presentation_states"]["selected_frames"] == 3
    page = (out / "review-v.html").read_text()
    assert "presentation:additive_build_final" in page and "presentation:pre_replacement" in page and (out / "contact-sheet-v-settled.png").exists()
    evidence = spark.read.parquet(f"{out}/evidence").collect()
    assert evidence and all((out / "frames" / r.image_path).exists() for r in evidence)
    doc = {"video": "v", "segment": {"start": 0, "duration": 40}, "must_keep": [{"timestamp": 9.5, "tolerance_seconds": 1}, {"timestamp": 200}]}
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(doc))
    score = run(spark, "evaluate", out, "--annotations", tmp_path / "a.yaml")
    strategies = json.loads(Path(score["output"]).read_text())["strategies"]
    assert strategies["presentation_states"]["annotations"]["must_keep"]["matched"] == 1 and strategies["uniform"]["raw_candidates"] == 5
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(doc | {"video": "w"}))
    with pytest.raises(Violation):
        run(spark, "evaluate", out, "--annotations", tmp_path / "b.yaml")


def test_workflow(spark, video, tmp_path):
    out, seen = tmp_path / "flow", []
    helper = lambda n: f"{sys.executable} {video / n}"
    see = lambda: commands.backends.ProcessOcr(tuple(helper("ocr.py").split()))
    listen = lambda: commands.backends.ProcessSpeech(tuple(helper("asr.py").split()))
    got = commands.workflow(spark, str(video), str(out), see, listen, progress=seen.append)
    assert got["status"] == "ok" and list(got["stages"]) == ["visual", "ocr", "asr", "alignment", "semantic", "markdown"]
    assert seen[0]["current_stage"] == "visual" and seen[-1]["status"] == "ok" and json.loads((out / "workflow.json").read_text())["status"] == "ok"
    frames = spark.read.parquet(f"{out}/alignment/visual").count()
    report = spark.read.parquet(f"{out}/markdown/report").first().markdown
    assert frames > 0 and report.count("![") == frames
    links = spark.read.parquet(f"{out}/alignment/links")
    assert links.where("status = 'outside_asr_range'").count() == 0
    chapters = spark.read.parquet(f"{out}/semantic/chapters").orderBy("start_us").collect()
    assert chapters[0].start_us == 0 and sum(len(c.speech_ids) for c in chapters) == 14
    ids = [r.event_id for r in spark.read.parquet(f"{out}/alignment/timeline").where("kind = 'visual'").orderBy("event_id").collect()]
    assert ids[0] == "visual-0001" and len(ids) == frames
    anchors = {"kind": "asr_anchor_set", "review_status": "human_reviewed", "coverage": "reported_issue_only", "review": {"assertions_complete_for_clip": False}, "anchors": []}
    base = [{**r.asDict(), "id": r.speech_id} for r in spark.read.parquet(f"{out}/asr/segments").collect()]
    s = base[2]
    anchors["anchors"] = [{"id": "x", "segment_id": 2, "baseline_text": s["text"], "baseline_span": "part 2", "expected_span": "part two", **{k: s[k] for k in s if k.endswith("_seconds") and k != "audio_seconds"}}]
    us = lambda c: F.rint(F.col(c) * 1e6).cast("long")
    heard = spark.read.parquet(f"{out}/asr/segments").select("video_id", "speech_id", us("absolute_start_seconds").alias("start_us"), us("absolute_end_seconds").alias("end_us"), "text", "compression_ratio")
    told = commands.anchor_report(base, heard, anchors)
    assert told["summary"]["baseline_error_persists_count"] == 1 and told["summary"]["expected_exact_hit_rate"] == 0.0
    with pytest.raises(Violation):
        commands.anchor_report(base, heard, anchors | {"coverage": "all"})


def test_a_failing_stage_ends_the_run(spark, video, tmp_path):
    broken = lambda: commands.backends.ProcessOcr(("/no/such/helper",))
    with pytest.raises(Violation, match="recognition failed"):
        commands.gate("ocr")({"ocr": spark.createDataFrame([("error",)], "status string")})
    with pytest.raises(Violation, match="no rows"):
        commands.gate("markdown")({"report": spark.createDataFrame([], "markdown string")})
    assert broken().describe()["engine"] == "process"


def test_bad_arguments_end_with_two(capsys, monkeypatch, spark):
    monkeypatch.setattr(commands, "session", lambda: spark)
    assert commands.main(["probe", "/no/such/folder"]) == 2 and "tessera:" in capsys.readouterr().err
    assert commands.main(["query", "no_such_query", "/root/testdata/sf0.001"]) == 2
    with pytest.raises(SystemExit):
        commands.main(["benchmark", "x"])
    assert visual.environment()["pyspark"]
