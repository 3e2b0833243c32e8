"""Stage drivers: each reads ledgers, checks them, computes, checks coverage and publishes or fails.

Ledgers are Parquet tables below a run's folder. A stage that finds a violation raises before it
writes, so that earlier stages' ledgers stay as they were.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chapters, joins
from ..operators import require as checks
from ..operators.require import Violation
from ..sources import ledgers
from . import reports

KEYS = ["video_id"]


def align(frames: DataFrame, ocr: DataFrame, speech: DataFrame, ranges: DataFrame, context_us: int = 20_000_000) -> dict[str, DataFrame]:
    """Links, nearby speech, timeline and status counts of frames and speech of each source.

    frames(video_id, sample_index, t_us), ocr(video_id, sample_index, t_us, status), speech(video_id,
    speech_id, start_us, end_us, text), ranges(video_id, range_start_us, range_end_us).
    """
    if not 0 <= context_us <= 120_000_000:
        raise ValueError("context is 0 to 120 seconds")
    key = F.concat_ws(":", "video_id", "sample_index").alias("key")
    checks.require_none(joins.one_to_one(frames.select(key), ocr.select(key), "key").where("status <> 'matched'"), "frames and recognised text do not match one to one")
    both = frames.join(ocr.select(*KEYS, "sample_index", F.col("t_us").alias("ocr_us"), F.col("status").alias("ocr_status")), [*KEYS, "sample_index"])
    checks.require_none(both.where(F.abs(F.col("t_us") - F.col("ocr_us")) > 1), "recognised text is of another time than its frame")
    bad = speech.join(ranges, KEYS, "left").where("range_start_us is null or start_us < range_start_us or end_us > range_end_us or end_us < start_us")
    checks.require_none(bad, "speech lies outside its range")
    own = both.drop("ocr_us")
    links = joins.align_points(own, speech.drop("text"), KEYS, ranges)
    near = joins.nearby_speech(own, speech, KEYS, ranges, context_us, context_us)
    timeline = joins.timeline(own, speech, KEYS)
    summary = links.groupBy(*KEYS, "status").agg(F.count_distinct("sample_index").alias("frames"), F.count("speech_id").alias("links"))
    return {"links": links, "nearby": near, "timeline": timeline.orderBy(*KEYS, "t_us", "k", "event_id"), "summary": summary}


def semantic(speech: DataFrame, titles: DataFrame, ranges: DataFrame, least: float = 30.0, target: float = 180.0, most: float = 480.0, window: float = 45.0) -> dict[str, DataFrame]:
    """Candidates and chapters of each source; every speech event is in exactly one chapter, or it raises."""
    if not 0 < least <= target <= most <= 3600 or not 0 < window <= 300:
        raise ValueError("chapter lengths must satisfy least <= target <= most <= 3600 and window <= 300")
    features = chapters.boundary_features(speech, KEYS, round(window * 1e6))
    attached = chapters.attach_titles(features, titles, speech, KEYS, ranges, round(least * 1e6))
    candidates = chapters.scored(attached, "visual_title_change")
    parts = chapters.chapters(chapters.boundaries(candidates, ranges, KEYS, least, target, most), ranges, KEYS)
    held = chapters.assign(speech, parts, KEYS, t="start_us")
    key = F.concat_ws(":", "video_id", "speech_id").alias("key")
    lost = joins.coverage(speech.select(key), held.select(key), "key").first()
    if any(lost):
        raise Violation(f"speech is not covered once each: {lost.asDict()}")
    return {"candidates": candidates, "chapters": chapters.chapter_texts(speech, parts, KEYS)}


def export(events: DataFrame, parts: DataFrame) -> DataFrame:
    """Markdown of each source; chapters that do not follow each other, or events outside them, raise."""
    from ..operators import sequences

    checks.require_none(sequences.contiguous(parts, KEYS, ["start_us"], "start_us", "end_us"), "chapters do not follow each other")
    held = chapters.assign(events, parts, KEYS)
    key = F.concat_ws(":", "video_id", "event_id").alias("key")
    lost = joins.coverage(events.select(key), held.select(key), "key").first()
    if any(lost):
        raise Violation(f"events are not covered once each: {lost.asDict()}")
    return ledgers.markdown(events, KEYS)


def review_html(title: str, rows: Sequence[dict], columns: Sequence[str]) -> bytes:
    """A table for reviewers; every value is escaped and no script can run."""
    return reports.page(title, reports.table(rows, columns))


@dataclass
class Workflow:
    """Stages in order, each with a gate over its ledgers; the first failure ends the run and is recorded.

    After each change of state the status document and page in the run's folder are replaced as a
    whole, and `progress` is told.
    """

    spark: SparkSession
    folder: str
    stages: list[tuple[str, Callable[[SparkSession, str], dict[str, DataFrame]], Callable[[dict[str, DataFrame]], None] | None]]
    progress: Callable[[dict], None] | None = None
    status: dict[str, str] = field(default_factory=dict)
    error: str | None = None

    def document(self) -> dict:
        done = set(self.status.values())
        state = "error" if "error" in done else "running" if done & {"running", "pending"} else "ok"
        now = next((n for n, s in self.status.items() if s == "running"), None)
        return {"kind": "workflow", "schema_version": 1, "status": state, "current_stage": now, "stages": dict(self.status), "error": self.error}

    def tell(self, name: str, state: str) -> None:
        self.status[name] = state
        doc = self.document()
        if "://" not in self.folder:
            Path(self.folder).mkdir(parents=True, exist_ok=True)
            ledgers.replace(Path(self.folder, "workflow.json"), doc)
            ledgers.replace_bytes(Path(self.folder, "status.html"), reports.status_page("Workflow", self.status, self.error))
        if self.progress:
            self.progress(doc)

    def run(self) -> dict:
        self.status = {name: "pending" for name, _, _ in self.stages}
        for name, work, gate in self.stages:
            self.tell(name, "running")
            try:
                out = work(self.spark, self.folder)
                if gate:
                    gate(out)
                for ledger, df in out.items():
                    df.write.mode("errorifexists").parquet(f"{self.folder}/{name}/{ledger}")
            except Exception as e:
                self.error = f"{type(e).__name__}: {str(e)[:500]}"
                self.tell(name, "error")
                raise
            self.tell(name, "ok")
        return {"status": "ok", "stages": dict(self.status)}


def unique_names(names: Sequence[str], taken: Sequence[str] = (), most: int = 80) -> list[str]:
    """Run names that differ in more than case from each other and from those taken: a number is added."""
    held = {t.casefold() for t in taken}
    out = []
    for base in names:
        tries = itertools.chain([base], (f"{base[: most - len(f'-{k}')]}-{k}" for k in itertools.count(2)))
        out.append(next(t for t in tries if t.casefold() not in held))
        held.add(out[-1].casefold())
    return out


def confined(root: Path, name: str) -> Path:
    """A file below root by its relative name; a name or link that leaves root, or is hidden, is refused."""
    path = (Path(root) / name).resolve()
    inside = Path(root).resolve() in path.parents
    if not inside or any(p.startswith(".") for p in Path(name).parts):
        raise Violation("the path leaves the run's folder")
    return path


def land(source: Iterable[bytes], size: int, target: Path, check: Callable[[Path], None]) -> Path:
    """Copy an announced number of bytes into a landing folder: the file gets its name only if it is
    whole and `check` does not raise; else nothing is left."""
    target = Path(target)
    if target.exists():
        raise Violation(f"{target} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    hidden = target.with_name(f".{target.name}.part")
    try:
        with open(hidden, "wb") as f:
            got = sum(f.write(part) for part in source)
        if got != size:
            raise Violation(f"{got} of {size} bytes arrived")
        check(hidden)
        hidden.rename(target)
    finally:
        hidden.unlink(missing_ok=True)
    return target


def run_batch(items: Sequence[str], work: Callable[[str], None], most: int = 50, ledger: Path | None = None) -> dict:
    """Items one after the other; a failure is recorded and the rest go on. Status ok, partial or error.

    With `ledger`, a file, the batch's document is replaced after each change, so that a batch that
    is broken off shows how far it came.
    """
    if not 1 <= len(items) <= most or len(set(items)) != len(items):
        raise ValueError(f"a batch has 1 to {most} different items")
    done = {item: "pending" for item in items}

    def document() -> dict:
        n = Counter(v.split(":")[0] for v in done.values())
        state = "running" if n["pending"] or n["running"] else "ok" if n["ok"] == len(items) else "partial" if n["ok"] else "error"
        return {"kind": "batch", "status": state, "items": dict(done), "summary": {"ok": n["ok"], "error": n["error"], "pending": n["pending"]}}

    def tell(item: str, state: str) -> None:
        done[item] = state
        if ledger:
            ledgers.replace(Path(ledger), document())

    for item in items:
        tell(item, "running")
        try:
            work(item)
            tell(item, "ok")
        except Exception as e:
            tell(item, f"error: {e}")
    return document()
