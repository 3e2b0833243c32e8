"""Sources, publishing, recognition backends and streaming twins."""

from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tessera.operators import ocr, sequences
from tessera.operators.require import Violation
from tessera.sources import ledgers, media
from tessera.streaming import twins


def wav(seconds, rate=16000):
    data = b"\0\0" * int(seconds * rate)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_paths_and_codecs(spark):
    df = spark.createDataFrame([("a/B.MP4",), ("a.mkv.part",), ("a.txt",), ("x.webm",)], "p string")
    assert [r[0] for r in df.select(media.video_path_ok(F.col("p"))).collect()] == [True, False, False, True]
    assert spark.range(1).select(media.fourcc(F.lit(int.from_bytes(b"avc1", "little")))).first()[0] == "avc1"


def test_audio(spark):
    df = spark.createDataFrame([("a", bytearray(wav(2)), 2.5), ("b", bytearray(wav(2, 8000)), 2.0), ("c", bytearray(b"x"), 1.0), ("d", bytearray(wav(5)), 2.0)], "path string, content binary, requested_seconds double")
    got = {r.path: (r.ok, r.error) for r in media.audio_checks(df).collect()}
    assert got["a"] == (True, None) and not any(got[k][0] for k in "bcd") and got["d"][1] == "not as long as asked"


def test_fingerprint_and_bound_hash(spark, tmp_path):
    body = ledgers.document({"kind": "k", "schema_version": 1, "n": 3})
    (tmp_path / "a.json").write_bytes(body)
    sha = hashlib.sha256(body).hexdigest()
    assert media.fingerprints(spark, str(tmp_path)).first().sha256 == sha
    schema = "kind string, schema_version int, n int"
    assert ledgers.read_json(spark, str(tmp_path / "a.json"), schema, "k", 1, sha).first().n == 3
    for kind, version, h in (("x", 1, sha), ("k", 2, sha), ("k", 1, "0")):
        with pytest.raises(Exception, match="bound|no x|version"):
            ledgers.read_json(spark, str(tmp_path / "a.json"), schema, kind, version, h).collect()


def test_publish_is_whole_or_nothing(tmp_path):
    src = tmp_path / "in" / "x"
    src.parent.mkdir()
    src.write_bytes(b"1")
    out = tmp_path / "out" / "run"
    with pytest.raises(Violation, match="changed"):
        ledgers.publish(out, {"a.md": b"x"}, {src: "0"})
    assert not out.exists() and not list((tmp_path / "out").iterdir())
    ledgers.publish(out, {"d/a.md": b"x"}, {src: hashlib.sha256(b"1").hexdigest()})
    assert (out / "d/a.md").read_bytes() == b"x"
    for target in (out, src.parent):
        with pytest.raises(Violation):
            ledgers.publish(target, {}, {src: "0"})
    with pytest.raises(Violation):
        ledgers.artifact(tmp_path, "../x")


class Fake:
    def describe(self):
        return {"name": "fake"}

    def recognize(self, image, languages, kind, region):
        if image == b"bad":
            raise RuntimeError("unreadable")
        return [{"text": "low", "confidence": None, "bbox": [0, 0.5, 0.1, 0.1]}, {"text": image.decode(), "confidence": 0.5, "bbox": [0, 0, 0.1, 0.1]}]


def test_recognition_keeps_failures_as_rows(spark):
    df = spark.createDataFrame([(1, "presentation", bytearray(b"hi")), (2, "chart", bytearray(b"x")), (3, "table", bytearray(b"bad"))], "sample_index int, route_kind string, image binary")
    out = ocr.recognize(df, Fake, ["presentation", "table"]).cache()
    got = {r.sample_index: r for r in out.collect()}
    assert got[1].plain_text == "hi\nlow" and got[1].roi_normalized == [0, 0, 1, 0.92]
    assert (got[2].status, got[3].status) == ("skipped", "error") and "unreadable" in got[3].error
    assert tuple(ocr.summary(out).first()) == (1, 1, 1, 2)


def test_candidates_and_worst_ratios(spark, tmp_path):
    from tessera.operators import speech

    (tmp_path / "s.json").write_text('{"strategy": "settled", "selected": [{"sample_index": 1, "timestamp": 2.5}, {"sample_index": 2, "timestamp": 3, "score": 0.5, "reasons": ["r"], "segment_id": "x"}]}')
    got = ledgers.candidates(spark, str(tmp_path / "s.json")).orderBy("sample_index").collect()
    assert (got[0].score, got[0].reasons, got[0].image_path) == (0.0, [], None) and (got[1].score, got[1].reasons) == (0.5, ["r"])
    (tmp_path / "t.json").write_text('{"strategy": "x", "selected": [{"timestamp": 1}]}')
    with pytest.raises(Exception, match="no index"):
        ledgers.candidates(spark, str(tmp_path / "t.json")).collect()
    df = spark.createDataFrame([("v", 1, 2.5), ("v", 2, 1.0), ("v", 3, 3.0), ("w", 1, None)], "v string, speech_id long, compression_ratio double")
    out = {r.v: r for r in speech.worst_ratios(df, ["v"]).collect()}
    assert out["v"].max_ratio == 3.0 and [x.id for x in out["v"].offenders] == [1, 3] and out["w"].offenders == []


def test_markdown(spark):
    df = spark.createDataFrame([("v", 2, "e2", "00:02", "a b/c.png"), ("v", 1, "e1", "00:01", "x.png")], "k string, t_us long, event_id string, timecode string, image_path string")
    assert ledgers.markdown(df, ["k"]).first().markdown == "![00:01](x.png)\n\n![00:02](a%20b/c.png)\n"


def test_streaming_runs_equal_batch(spark, tmp_path):
    rows = [(k, i, "ab"[(i // (2 + k)) % 2]) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, i long, label string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = twins.label_runs(stream, "k", "i", "label").writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.run_id, r.label, r.length) for r in spark.sql("select * from runs").collect()}
    want = {(r.k, r.run_id, r.label, r.length) for r in sequences.runs(df, ["k"], ["i"], "label").collect()}
    assert got < want and len(want - got) == 3  # the last run of each key is still open


def test_settled_stream_equals_batch(spark, tmp_path):
    change = [0.0, 0.5, 0.2, 0.001, 0.002, 0.001, 0.0, 0.3, 0.3, 0.0]
    rows = [(k, i, i * 1_000_000, c + 0.001 * k) for k in range(2) for i, c in enumerate(change)] + [(9, 0, 3_600_000_000, 0.0)]
    df = spark.createDataFrame(rows, "k long, sample_index long, t_us long, change_score double").withColumn("ts", F.timestamp_micros("t_us"))
    # two files: what the second adds moves the watermark beyond the first's sources
    df.where("k < 9").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    told = []
    listener = twins.Progress(told.append)
    spark.streams.addListener(listener)
    q = twins.settled_stream(stream, "k", "ts", "1 second", 5000, hold=2).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    df.where("k = 9").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(listener)
    got = sorted(map(tuple, spark.sql("select * from settled").collect()))
    want = sorted(map(tuple, twins.settled_batch(df.where("k < 9"), "k", hold=2).collect()))
    assert got == want and {r[4] for r in want} == {"settled_after_change", "segment_end_after_change"}
    assert any(t["state"] == "running" for t in told)


def test_rows_out_of_order_are_told():
    state, out = twins.settle(twins.OPEN, [(5, 1, 0.0), (3, 0, 0.9)], 0.1, 0.01, 2)
    assert out == [(0, 3, 0.9, "out_of_order")] and state[0] is False and twins.ended(state) == []


def test_frames_arrive(spark, tmp_path):
    import numpy as np

    from tessera.sources import images

    (tmp_path / "in" / "v").mkdir(parents=True)
    for i in range(3):
        (tmp_path / "in" / "v" / f"{i}.png").write_bytes(images.png(np.full((4, 5), i, np.uint8)))
    q = twins.frame_stream(spark, str(tmp_path / "in"), files=2).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.video_id, r.frame_index, r.w) for r in spark.sql("select * from frames").collect()) == [("v", i, 5) for i in range(3)]
