"""The command line: one subcommand a stage, over folders of ledgers, and registered queries.

A video is a folder of decoded frames: PATH/sources.json, a list of metadata, and PATH/VIDEO/NUMBER.png;
its audio, for asr, is PATH/VIDEO.wav. Recognisers are helper processes. Violations and unreadable
input end with code 2 and a message.
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import parse_seconds
from ..operators import annotations, backends, chapters, evaluate, require, speech
from ..operators.require import Violation
from ..session import session
from ..sources import images, ledgers, media
from . import reports, stages, visual

KEYS = ["video_id"]


def written(folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """A step as a table below folder/steps, read back: lineage ends there."""

    def cut(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/steps/{name}"
        df.write.mode("errorifexists").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return cut


# ---- stages over folders -----------------------------------------------------------------

def selected(spark: SparkSession, run: str, strategy: str) -> DataFrame:
    """(video_id, sample_index, t_us, segment_id, image_path, image_sha256) of a run's selected frames."""
    if strategy not in visual.STRATEGIES:
        raise Violation(f"no strategy: {strategy}")
    own = spark.read.parquet(f"{run}/ledger").where((F.col("strategy") == strategy) & (F.col("status") == "selected"))
    return own.join(spark.read.parquet(f"{run}/evidence").select(*KEYS, "sample_index", "image_path", "image_sha256"), [*KEYS, "sample_index"])


def routed_kinds(spark: SparkSession, run: str, frames: DataFrame) -> DataFrame:
    from ..operators import joins

    manifest = spark.createDataFrame([], "video_id string, segment_id string, kind string")
    strategy = spark.read.parquet(f"{run}/segments").select(*KEYS, "segment_id", "kind") if Path(run, "segments").exists() else manifest
    return joins.source_kind(frames, strategy, manifest, KEYS)


def recognise(spark: SparkSession, run: str, strategy: str, routes: Sequence[str], languages: Sequence[str], backend: Callable) -> DataFrame:
    frames = routed_kinds(spark, run, selected(spark, run, strategy))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{run}/frames").select(F.regexp_extract("path", r"/frames/(.+)$", 1).alias("image_path"), F.col("content").alias("image"))
    own = frames.join(files, "image_path").select(*KEYS, "sample_index", "t_us", "segment_id", "route_kind", "image_path", "image_sha256", "image")
    changed = own.where(F.sha2("image", 256) != F.col("image_sha256"))
    require.require_none(changed, "an evidence image has changed since it was published")
    return backends.ocr_ledger(own, backend, routes, languages)


def hear(spark: SparkSession, path: str, source: visual.Source, start: float, duration: float | None, backend: Callable, language: str, prompt: str | None, profile: str) -> dict[str, DataFrame]:
    ranges = visual.range_of(source, start, duration)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("video_id"), "path", "content")
    own = files.join(ranges, KEYS).withColumn("requested_seconds", F.col("range_end") - F.col("range_start"))
    checked = media.audio_checks(own)
    require.require_none(checked.where("not ok"), "an audio file is not mono, 16 kHz, 16 bits and as long as its range")
    audio = own.join(checked.select("path", F.col("seconds").alias("audio_seconds")), "path").select("video_id", "range_start", "audio_seconds", "content")
    out = backends.asr_ledger(backends.transcribe(audio, backend, language, prompt, profile))
    return out | {"ranges": ranges.select("video_id", F.rint(F.col("range_start") * 1e6).cast("long").alias("range_start_us"), F.rint(F.col("range_end") * 1e6).cast("long").alias("range_end_us"))}


def told(spark: SparkSession, asr: str) -> tuple[DataFrame, DataFrame]:
    """Speech events and ranges of an asr folder that passed its checks."""
    require.require_none(spark.read.parquet(f"{asr}/failures"), "the transcript failed; see its failures")
    own = spark.read.parquet(f"{asr}/segments")
    us = lambda c: F.rint(F.col(c) * 1e6).cast("long")
    return own.select("video_id", F.col("speech_id").cast("long").alias("speech_id"), us("absolute_start_seconds").alias("start_us"), us("absolute_end_seconds").alias("end_us"), "text"), spark.read.parquet(f"{asr}/ranges")


def align(spark: SparkSession, run: str, strategy: str, ocr: str, asr: str, context: float) -> dict[str, DataFrame]:
    heard, ranges = told(spark, asr)
    seen = spark.read.parquet(f"{ocr}/ocr")
    frames = selected(spark, run, strategy)
    ledgers.bind(run=frames.select("video_id", "image_sha256"), ocr=seen.select("video_id", "image_sha256"))
    out = stages.align(frames.select(*KEYS, "sample_index", "t_us", "image_path", "image_sha256"), seen, heard, ranges, round(context * 1e6))
    texts = seen.select(*KEYS, "sample_index", "t_us", "observations")
    return out | {"speech": heard, "ranges": ranges, "visual": frames.select(*KEYS, "sample_index", "t_us", "image_path", "image_sha256"), "texts": texts}


def titles(texts: DataFrame) -> DataFrame:
    """(video_id, title_id, t_us, title, confidence) of titles that changed, from recognised lines."""
    lines = texts.select(*KEYS, "sample_index", "t_us", F.explode("observations").alias("o")).select(*KEYS, "sample_index", "t_us", "o.text", F.col("o.bbox")[1].alias("y"), F.col("o.bbox")[2].alias("width"), "o.confidence")
    best = chapters.title_lines(lines, [*KEYS, "sample_index", "t_us"]).withColumnRenamed("sample_index", "title_id")
    return chapters.changed_titles(best, KEYS, ["t_us", "title_id"])


def segment(spark: SparkSession, aligned: str, least: float, target: float, most: float, window: float) -> dict[str, DataFrame]:
    heard, ranges = spark.read.parquet(f"{aligned}/speech"), spark.read.parquet(f"{aligned}/ranges")
    out = stages.semantic(heard, titles(spark.read.parquet(f"{aligned}/texts")), ranges, least, target, most, window)
    events = spark.read.parquet(f"{aligned}/timeline").where("kind = 'visual'")
    return out | {"events": chapters.assign(events, out["chapters"], KEYS).select(*KEYS, "event_id", "t_us", "chapter_id")}


def export(spark: SparkSession, aligned: str, semantic: str) -> DataFrame:
    from ..functions import time as clock
    from ..operators import joins

    frames = joins.numbered(spark.read.parquet(f"{aligned}/visual"), KEYS, ["t_us", "sample_index"], "visual-%04d")
    parts = spark.read.parquet(f"{semantic}/chapters").select(*KEYS, "chapter_id", "start_us", "end_us", "last")
    return stages.export(frames.withColumn("timecode", clock.timecode(F.col("t_us"))), parts)


#: What each stage of a workflow has to show before the next one starts: (table, condition of a bad row, message).
GATES: dict[str, list[tuple[str, str, str]]] = {
    "visual": [("ledger", "strategy = 'routed' and status = 'capped'", "routing capped evidence frames")],
    "ocr": [("ocr", "status = 'error'", "recognition failed on evidence frames")],
    "asr": [("failures", "true", "the transcript failed")],
    "alignment": [("links", "status = 'outside_asr_range'", "frames lie outside the transcript's range")],
    "semantic": [("chapters", "speech_ids is null", "a chapter holds no speech")],
    "markdown": [("report", "markdown is null or markdown = ''", "no screenshots")],
}


def gate(name: str) -> Callable[[dict[str, DataFrame]], None]:
    def check(out: dict[str, DataFrame]) -> None:
        for table, bad, message in GATES[name]:
            require.require_none(out[table].where(bad), f"{name}: {message}")
        first = out[GATES[name][0][0]] if name != "asr" else out["segments"]
        if not first.limit(1).count():
            raise Violation(f"{name}: no rows")

    return check


def workflow(spark: SparkSession, path: str, folder: str, see: Callable, listen: Callable, rate: float = 2.0, width: int = 480, most: int = 500, progress: Callable[[dict], None] | None = None) -> dict:
    """The six stages of a source over its whole length, one after the other, each behind its gate."""
    source = visual.Source.of_folder(spark, path)
    longest = source.metadata.agg(F.max(F.col("frame_count") / F.col("fps"))).first()[0]
    p = visual.Parameters(duration=longest, strategies=("routed",), rate=rate, width=width, most=most, allow_long=True)
    cut = written(f"{folder}/work")

    def look(s: SparkSession, _: str) -> dict[str, DataFrame]:
        visual.benchmark(s, source, f"{folder}/run", p, cut)
        return {k: s.read.parquet(f"{folder}/run/{k}") for k in ("ledger", "segments", "evidence")}

    run, name = f"{folder}/run", lambda n: f"{folder}/{n}"
    work = [
        ("visual", look),
        ("ocr", lambda s, _: {"ocr": cut(recognise(s, run, "routed", ("presentation", "table"), ("zh-Hans", "en-US"), see), "ocr")}),
        ("asr", lambda s, _: {k: cut(v, f"asr-{k}") for k, v in hear(s, path, source, 0.0, None, listen, "zh", None, "fixed_zero").items()}),
        ("alignment", lambda s, _: align(s, run, "routed", name("ocr"), name("asr"), 20.0)),
        ("semantic", lambda s, _: segment(s, name("alignment"), 30.0, 180.0, 480.0, 45.0)),
        ("markdown", lambda s, _: {"report": export(s, name("alignment"), name("semantic"))}),
    ]
    return stages.Workflow(spark, folder, [(n, f, gate(n)) for n, f in work], progress).run()


def anchor_report(baseline: list[dict], candidate: DataFrame, doc: dict, tolerance: float = 0.75) -> dict:
    """Score reviewed anchors against a transcript (video_id, speech_id, start_us, end_us, text, compression_ratio)."""
    require.within(0, 5, tolerance=tolerance)
    for ok, message in (
        (doc.get("kind") == "asr_anchor_set", "the annotations are no anchor set"),
        (doc.get("review_status") == "human_reviewed", "anchors must be human_reviewed"),
        (doc.get("coverage") == "reported_issue_only", "anchors must disclose reported_issue_only coverage"),
        ((doc.get("review") or {}).get("assertions_complete_for_clip") is False, "the review of the clip must be marked as not exhaustive"),
    ):
        if not ok:
            raise Violation(message)
    spark, out = candidate.sparkSession, {}
    for part, expected in (("anchors", "expected_span"), ("related_candidates", "candidate_expected_span")):
        own = doc.get(part, [])
        if found := annotations.bound_anchors(own, baseline, expected):
            raise Violation("; ".join(found))
        rows = [("v", a["id"], round(a["absolute_start_seconds"] * 1e6), round(a["absolute_end_seconds"] * 1e6), a["baseline_span"], a[expected]) for a in own]
        df = spark.createDataFrame(rows, "video_id string, anchor_id string, start_us long, end_us long, baseline_span string, expected_span string")
        out[part] = [r.asDict() for r in evaluate.anchor_scores(df, candidate.withColumn("video_id", F.lit("v")), KEYS, round(tolerance * 1e6)).orderBy("anchor_id").collect()]  # reviewed by hand
    own, kinds = out["anchors"], [r["outcome"] for r in out["anchors"]]
    checks = speech.quality_gate(candidate, KEYS, ["start_us", "speech_id"], ratio="compression_ratio").collect()
    worst = candidate.agg(F.max("compression_ratio")).first()[0]
    hits = kinds.count("expected_exact")
    return {
        "kind": "asr_anchor_evaluation", "schema_version": 1, "method": {"name": "time_window_exact_substring", "tolerance_seconds": tolerance, "claim_limit": "reported anchors only; not transcript accuracy or CER"},
        "summary": {
            "confirmed_anchor_count": len(own), "expected_exact_hit_count": hits, "expected_exact_hit_rate": round(hits / len(own), 6) if own else None, "baseline_error_persists_count": kinds.count("baseline_error_persists"),
            "other_output_count": kinds.count("other_output"), "off_anchor_expected_occurrence_count": sum(r["off_anchor"] for r in own), "related_candidate_count": len(out["related_candidates"]),
            "related_candidate_exact_hit_count": sum(r["outcome"] == "expected_exact" for r in out["related_candidates"]),
        },
        "quality_checks": [r.asDict() for r in checks], "max_compression_ratio": worst, **out,
    }


# ---- commands ----------------------------------------------------------------------------

def _list(value: str) -> list[str]:
    out = list(dict.fromkeys(x.strip() for x in value.split(",") if x.strip()))
    if not out:
        raise argparse.ArgumentTypeError("an empty list")
    return out


def _time(value: str) -> float:
    try:
        return parse_seconds(value)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, **options: tuple) -> None:
        own = commands.add_parser(name)
        for p in places:
            own.add_argument(p)
        for o, (kind, default) in options.items():
            flag = "--" + o.replace("_", "-")
            if kind is bool:
                own.add_argument(flag, action="store_true")
            else:
                own.add_argument(flag, type=kind, default=default, required=default is ...)

    add("probe", "video")
    add("scan", "video", output=(str, ...), start=(_time, 0.0), duration=(_time, None), interval=(float, 60.0), max_frames=(int, 120))
    add("benchmark", "video", output=(str, ...), start=(_time, ...), duration=(_time, ...), strategies=(_list, ["uniform", "content", "adaptive", "settled", "hybrid"]), annotations=(str, None), analysis_fps=(float, 2.0),
        analysis_width=(int, 320), uniform_interval=(float, 10.0), max_frames=(int, 80), content_threshold=(float, 27.0), adaptive_threshold=(float, 3.0), boundary_lookahead_seconds=(float, 15.0),
        table_lookahead_seconds=(float, 8.0), presentation_lookahead_seconds=(float, 6.0), allow_long_range=(bool, None))
    add("curate", "video", annotations=(str, ...), output=(str, ...), video_id=(str, None))
    add("ocr", "run", strategy=(str, "routed"), routes=(_list, ["presentation", "table"]), helper=(str, ...), languages=(_list, ["zh-Hans", "en-US"]), output=(str, ...))
    add("asr", "video", start=(_time, ...), duration=(_time, ...), helper=(str, ...), language=(str, "zh"), initial_prompt=(str, None), decoding_profile=(str, "fixed_zero"), allow_long_range=(bool, None), output=(str, ...))
    add("asr-evaluate", "candidate", baseline=(str, ...), annotations=(str, ...), tolerance=(float, 0.75), output=(str, ...))
    add("align", "run", strategy=(str, ...), ocr=(str, ...), asr=(str, ...), context=(float, 20.0), output=(str, ...))
    add("semantic", "alignment", output=(str, ...), min_chapter_seconds=(float, 30.0), target_chapter_seconds=(float, 180.0), max_chapter_seconds=(float, 480.0), topic_window_seconds=(float, 45.0))
    add("markdown", "alignment", "semantic", output=(str, ...))
    add("workflow", "video", output=(str, ...), ocr_helper=(str, ...), asr_helper=(str, ...), analysis_fps=(float, 2.0), analysis_width=(int, 480), max_frames=(int, 500))
    add("batch", output=(str, ...), ocr_helper=(str, ...), asr_helper=(str, ...), videos=(_list, ...))
    add("evaluate", "run", annotations=(str, ...), video_id=(str, None), output=(str, None))
    add("query", "name", "tables", output=(str, None))
    return top


def _new(path: str, inputs: Sequence[str] = ()) -> str:
    own = Path(path).resolve()
    if own.exists():
        raise Violation(f"{path} exists")
    for i in inputs:
        other = Path(i).resolve()
        if own == other or other in own.parents or own in other.parents:
            raise Violation("the output lies at or around an input")
    return str(own)


def _publish(out: dict[str, DataFrame], folder: str) -> dict:
    for name, df in out.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return {"output": folder, "tables": sorted(out)}


def _one(source: visual.Source, name: str | None) -> str:
    names = [r.video_id for r in source.metadata.select("video_id").limit(2).collect()]
    if name is None and len(names) != 1:
        raise Violation("the folder has more than one video; name one")
    return name or names[0]


def _json(doc: dict, path: str) -> dict:
    ledgers.replace(Path(_new(path)), doc)
    return {"output": path, "kind": doc["kind"]}


def run(a: argparse.Namespace, spark: SparkSession) -> dict:
    source = visual.Source.of_folder(spark, a.video) if getattr(a, "video", None) else None
    see = lambda: backends.ProcessOcr(tuple(shlex.split(getattr(a, "ocr_helper", None) or a.helper)))
    listen = lambda: backends.ProcessSpeech(tuple(shlex.split(getattr(a, "asr_helper", None) or a.helper)))
    match a.command:
        case "probe":
            return {"sources": [{**r.asDict(), "duration_seconds": r.frame_count / r.fps} for r in source.metadata.collect()]}
        case "scan":
            out = _new(a.output, [a.video])
            doc = visual.coarse_scan(source, out, a.interval, a.max_frames, a.start, a.duration)
            for v in {f["video_id"] for f in doc["frames"]}:
                own = [f for f in doc["frames"] if f["video_id"] == v]
                ledgers.replace_bytes(Path(out, f"scan-{v}.html"), reports.scan_review(v, own, own[0]["timestamp"], own[-1]["timestamp"]))
            return {"output": out, "frame_count": doc["frame_count"]}
        case "benchmark":
            out = _new(a.output, [a.video])
            ahead = visual.LOOKAHEAD | {"boundary_terminal": a.boundary_lookahead_seconds, "table_viewport": a.table_lookahead_seconds, "table_focus": a.table_lookahead_seconds, "presentation_states": a.presentation_lookahead_seconds}
            ahead["routed"] = max(a.boundary_lookahead_seconds, a.table_lookahead_seconds, a.presentation_lookahead_seconds)
            p = visual.Parameters(a.start, a.duration, a.strategies, a.analysis_fps, a.analysis_width, a.uniform_interval, a.max_frames, a.content_threshold, a.adaptive_threshold, a.allow_long_range, ahead)
            visual.benchmark(spark, source, out, p, written(out + ".work"))
            _review(spark, out, p)
            got = spark.read.parquet(f"{out}/metrics").collect()
            scores = {}
            if a.annotations:
                video = _one(source, None)
                scores = visual.evaluate_run(spark, out, video, ledgers.read_yaml(a.annotations))["strategies"]
                ledgers.replace(Path(out, "annotations.json"), scores)
            return {"output": out, "metrics": [r.asDict() for r in got], "annotations": bool(scores)}
        case "curate":
            return {"output": a.output, "selected": len(visual.curate(source, _new(a.output, [a.video]), _one(source, a.video_id), ledgers.read_yaml(a.annotations))["selected"])}
        case "ocr":
            out = _new(a.output, [a.run])
            done = written(out + ".work")(recognise(spark, a.run, a.strategy, a.routes, a.languages, see), "ocr")
            from ..operators import ocr

            rows = [r.asDict(recursive=True) for r in done.drop("observations").orderBy(*KEYS, "t_us").collect()]  # at most the cap of frames
            got = _publish({"ocr": done, "summary": ocr.summary(done)}, out)
            ledgers.replace_bytes(Path(out, "review.html"), reports.ocr_review("Text", rows))
            return got
        case "asr":
            if a.duration > 600 and not a.allow_long_range:
                raise ValueError("ranges above 600 seconds must be allowed explicitly")
            return _publish(hear(spark, a.video, source, a.start, a.duration, listen, a.language, a.initial_prompt, a.decoding_profile), _new(a.output))
        case "asr-evaluate":
            heard = spark.read.parquet(f"{a.candidate}/segments")
            us = lambda c: F.rint(F.col(c) * 1e6).cast("long")
            candidate = heard.select("video_id", "speech_id", us("absolute_start_seconds").alias("start_us"), us("absolute_end_seconds").alias("end_us"), "text", "compression_ratio")
            base = [{**r.asDict(), "id": r.speech_id} for r in spark.read.parquet(f"{a.baseline}/segments").select("speech_id", "text", "relative_start_seconds", "relative_end_seconds", "absolute_start_seconds", "absolute_end_seconds").collect()]
            return _json(anchor_report(base, candidate, ledgers.read_yaml(a.annotations), a.tolerance), a.output)
        case "align":
            return _publish(align(spark, a.run, a.strategy, a.ocr, a.asr, a.context), _new(a.output, [a.run, a.ocr, a.asr]))
        case "semantic":
            return _publish(segment(spark, a.alignment, a.min_chapter_seconds, a.target_chapter_seconds, a.max_chapter_seconds, a.topic_window_seconds), _new(a.output, [a.alignment]))
        case "markdown":
            out = Path(_new(a.output, [a.alignment, a.semantic]))
            rows = export(spark, a.alignment, a.semantic).collect()  # a text a video
            ledgers.publish(out, {f"{r.video_id}.md": r.markdown.encode() for r in rows})
            return {"output": str(out), "reports": [r.video_id for r in rows]}
        case "workflow":
            return workflow(spark, a.video, _new(a.output, [a.video]), see, listen, a.analysis_fps, a.analysis_width, a.max_frames, lambda d: print(json.dumps(d), file=sys.stderr))
        case "batch":
            names = dict(zip(a.videos, stages.unique_names([Path(v).name for v in a.videos])))
            root = Path(a.output)
            root.mkdir(parents=True, exist_ok=True)
            return stages.run_batch(a.videos, lambda v: workflow(spark, v, _new(str(root / names[v]), [v]), see, listen), ledger=root / "batch.json")
        case "evaluate":
            manifest = json.loads(Path(a.run, "manifest.json").read_text(encoding="utf-8"))
            video = a.video_id or manifest["sources"][0]["video_id"]
            doc = visual.evaluate_run(spark, a.run, video, ledgers.read_yaml(a.annotations))
            return _json(doc, a.output or f"{a.run}/evaluation-{Path(a.annotations).stem}.json")
        case _:
            from . import catalog

            if a.name not in catalog.QUERIES:
                raise ValueError(f"no query {a.name}; there are: {', '.join(sorted(catalog.QUERIES))}")
            df = catalog.QUERIES[a.name](spark, a.tables)
            if a.output:
                df.write.mode("errorifexists").parquet(a.output)
            else:
                df.show(20, truncate=80)
            return {"query": a.name, "output": a.output}


def _review(spark: SparkSession, folder: str, p: visual.Parameters) -> None:
    """A review page and a contact sheet of each video of a run; its rows are bounded by the cap and its raw candidates."""
    ledger = spark.read.parquet(f"{folder}/ledger")
    paths = spark.read.parquet(f"{folder}/thumbnails").select(*KEYS, "sample_index", F.concat(F.lit("thumbs/"), "image_path").alias("thumb")).distinct()
    whole = spark.read.parquet(f"{folder}/evidence").select(*KEYS, "sample_index", F.concat(F.lit("frames/"), "image_path").alias("frame")).distinct()
    rows = ledger.join(paths, [*KEYS, "sample_index"], "left").join(whole, [*KEYS, "sample_index"], "left").withColumn("image_path", F.when(F.col("status") == "selected", F.col("frame")).otherwise(F.col("thumb")))
    metrics = {(r.video_id, r.strategy): r.asDict() for r in spark.read.parquet(f"{folder}/metrics").collect()}
    manifest = json.loads(Path(folder, "manifest.json").read_text(encoding="utf-8"))
    bars: list[dict] = []
    if "routed" in p.strategies:
        spans = [(v, round(r["start_seconds"] * 1e6), round(r["end_seconds"] * 1e6)) for v, r in manifest["ranges"].items()]
        ranges = spark.createDataFrame(spans, "video_id string, range_start_us long, range_end_us long")
        held = ledger.where("strategy = 'routed' and status = 'selected'").select(*KEYS, "segment_id")
        bars = [r.asDict() for r in reports.route_bars(spark.read.parquet(f"{folder}/segments"), ranges, held, KEYS).orderBy("start_us").collect()]
    for s in manifest["sources"]:
        v = s["video_id"]
        own = [r.asDict() for r in rows.where(F.col("video_id") == v).orderBy("strategy", "t_us").collect()]
        by = {n: [r for r in own if r["strategy"] == n] for n in p.strategies}
        body = reports.visual_review(v, by, {n: {k: x for k, x in metrics.get((v, n), {}).items() if k not in ("video_id", "strategy")} for n in p.strategies}, [b for b in bars if b["video_id"] == v])
        ledgers.replace_bytes(Path(folder, f"review-{v}.html"), body)
        for n, found in by.items():
            shown = [r for r in found if r["status"] == "selected"]
            if shown:
                tiles = [(reports.clock(r["t_us"]), images.read_png(Path(folder, r["image_path"]).read_bytes())) for r in shown]
                ledgers.replace_bytes(Path(folder, f"contact-sheet-{v}-{n}.png"), images.png(images.contact_sheet(tiles)))


def main(args: Sequence[str]) -> int:
    a = parser().parse_args(args)
    try:
        print(json.dumps(run(a, session()), ensure_ascii=False, indent=2, default=str))
    except (Violation, ValueError, OSError, backends.Unavailable) as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 2
    return 0
