"""Review pages: static HTML of collected, bounded rows. Their data are DataFrames; a page only draws.

Every value is escaped, links are encoded element by element, and the policy of each page allows
styles and its own images, and no script but the one of the chapter page, named by its hash.
"""

from __future__ import annotations

import base64
import hashlib
import html
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledgers import link

STYLE = "body{font:15px sans-serif;margin:2em auto;max-width:80em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left;vertical-align:top}img{max-width:24em}.bar{position:relative;height:1.6em;background:#eee}.bar span{position:absolute;top:0;bottom:0;overflow:hidden;font-size:.8em}.presentation{background:#9ec5fe}.table{background:#a3cfbb}.chart{background:#ffe69c}.unknown{background:#ddd}"
#: The chapter page's script: a filter over chapters by their text.
SCRIPT = "const q=document.getElementById('q');q.addEventListener('input',()=>{for(const s of document.querySelectorAll('section'))s.hidden=!s.textContent.toLowerCase().includes(q.value.toLowerCase())});"

Cell = object


class Raw(str):
    """Markup that this module made, which is not escaped again."""


def text(value: Cell) -> str:
    if isinstance(value, Raw):
        return value
    if isinstance(value, float):
        return html.escape(f"{value:.6g}")
    if isinstance(value, (list, tuple)):
        return ", ".join(text(v) for v in value)
    return "" if value is None else html.escape(str(value))


def image(path: str | None) -> Raw:
    return Raw(f'<img src="{html.escape(link(path))}" alt="">' if path else "")


def anchor(path: str, name: str) -> Raw:
    return Raw(f'<a href="{html.escape(link(path))}">{html.escape(name)}</a>')


def table(rows: Iterable[Mapping], columns: Sequence[str]) -> Raw:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{text(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return Raw(f"<table><tr>{head}</tr>{body}</table>")


def page(title: str, *parts: tuple[str, Raw] | Raw, script: str | None = None) -> bytes:
    allowed = f"; script-src 'sha256-{base64.b64encode(hashlib.sha256(script.encode()).digest()).decode()}'" if script else ""
    policy = f"default-src 'none'; style-src 'unsafe-inline'; img-src 'self'{allowed}"
    body = "".join(f"<h2>{html.escape(p[0])}</h2>{p[1]}" if isinstance(p, tuple) else p for p in parts)
    tail = f"<script>{script}</script>" if script else ""
    return f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}{tail}</body></html>\n'.encode()


def clock(us: int) -> str:
    ms = round(us / 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


# ---- data --------------------------------------------------------------------------------

def distinct_segments(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments of all strategies, each id once, by start."""
    w = Window.partitionBy(*keys, "segment_id").orderBy("start_us", "end_us")
    return segments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*keys, "start_us", "segment_id")


def route_bars(segments: DataFrame, ranges: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """segments with left and width in percent of the range, and empty: known segments without a selected frame.

    ranges(keys, range_start_us, range_end_us); selected(keys, segment_id).
    """
    w = Window.partitionBy(*keys).orderBy("start_us")
    own = distinct_segments(segments, keys).join(ranges, list(keys))
    until = F.least(F.coalesce(F.lead("start_us").over(w), F.col("range_end_us")), F.col("range_end_us"))
    span = F.greatest(F.lit(1), F.col("range_end_us") - F.col("range_start_us"))
    share = lambda c: F.round(100.0 * F.greatest(F.lit(0), c) / span, 4)
    own = own.withColumn("_until", until).withColumns({"left": share(F.col("start_us") - F.col("range_start_us")), "width": share(F.col("_until") - F.col("start_us"))})
    held = selected.select(*keys, "segment_id").distinct().withColumn("_held", F.lit(True))
    own = own.join(held, [*keys, "segment_id"], "left")
    return own.withColumn("empty", F.col("_held").isNull() & (F.col("kind") != "unknown")).drop("_until", "_held", "range_start_us", "range_end_us")


# ---- pages -------------------------------------------------------------------------------

def _frames(rows: Iterable[Mapping], columns: Sequence[str]) -> Raw:
    return table(({**r, "time": clock(r["t_us"]), "image": image(r.get("image_path"))} for r in rows), ["time", "image", *columns])


def metric_line(m: Mapping) -> Raw:
    return Raw("<p>" + " · ".join(f"{html.escape(k.replace('_', ' '))}: {text(v)}" for k, v in m.items() if v is not None) + "</p>")


def visual_review(title: str, strategies: Mapping[str, Sequence[Mapping]], metrics: Mapping[str, Mapping], bars: Sequence[Mapping] = ()) -> bytes:
    """Every strategy's selected, dropped and capped frames, after a time line of the route."""
    parts: list = []
    if bars:
        spans = "".join(f'<span class="{html.escape(b["kind"])}" style="left:{b["left"]:.4f}%;width:{b["width"]:.4f}%">{html.escape(b["segment_id"])}</span>' for b in bars)
        rows = [{**b, "start": clock(b["start_us"]), "note": "no frame selected" if b["empty"] else ""} for b in bars]
        parts.append(("Route", Raw(f'<div class="bar">{spans}</div>' + table(rows, ["segment_id", "kind", "start", "confidence", "note"]))))
    for name, rows in strategies.items():
        parts.append((name, metric_line(metrics.get(name, {}))))
        for status, columns in (("selected", ["score", "reasons", "segment_id"]), ("duplicate", ["score", "reasons", "duplicate_of_us", "phash_distance", "ssim", "block_change"]), ("capped", ["score", "reasons"])):
            own = [r for r in rows if r["status"] == status]
            if own:
                parts.append(Raw(f"<h3>{status}: {len(own)}</h3>" + _frames(own, columns)))
    return page(title, *parts)


def scan_review(title: str, frames: Sequence[Mapping], start: float, end: float) -> bytes:
    rows = [{"t_us": round(f["timestamp"] * 1e6), "image_path": f["image_path"]} for f in frames]
    return page(title, metric_line({"start": start, "end": end, "frames": len(rows)}), _frames(rows, []))


def ocr_review(title: str, rows: Sequence[Mapping]) -> bytes:
    """Recognised frames with their lines, then failures and skipped frames with their reasons."""
    parts = [metric_line({s: sum(r["status"] == s for r in rows) for s in ("ok", "error", "skipped")})]
    for status, columns in (("ok", ["route_kind", "plain_text"]), ("error", ["route_kind", "error"]), ("skipped", ["route_kind", "reason"])):
        own = [r for r in rows if r["status"] == status]
        if own:
            parts.append((status, _frames(own, columns)))
    return page(title, *parts)


def asr_review(title: str, segments: Sequence[Mapping], gate: Mapping, failure: Mapping | None = None) -> bytes:
    """The transcript and its quality checks; of a failed run the failure."""
    parts: list = [("Quality", metric_line(gate))]
    if failure:
        parts.append(("Failure", table([failure], ["stage", "error_type", "error"])))
    rows = [{**s, "from": clock(s["start_us"]), "to": clock(s["end_us"])} for s in segments]
    return page(title, *parts, ("Segments", table(rows, ["from", "to", "text", "compression_ratio", "avg_logprob", "no_speech_prob"])))


def alignment_review(title: str, frames: Sequence[Mapping], summary: Mapping) -> bytes:
    """Each frame with its status, its text, the speech at its time and the speech near it."""
    rows = [{**f, "speech": Raw("<br>".join(text(s) for s in f.get("speech") or [])), "nearby": Raw("<br>".join(f"{text(n['relation'])} {n['gap_us'] / 1e6:.3f} s: {text(n['text'])}" for n in f.get("nearby") or []))} for f in frames]
    return page(title, metric_line(summary), _frames(rows, ["event_id", "status", "plain_text", "speech", "nearby"]))


def chapter_review(title: str, chapters: Sequence[Mapping], frames: Mapping[str, Sequence[Mapping]]) -> bytes:
    """Chapters with title, keywords, text and frames; a field filters them."""
    parts: list = [Raw('<p><input id="q" placeholder="filter"></p>')]
    for c in chapters:
        forced = " · forced by the longest length" if c.get("forced") else ""
        head = f"<h2>{html.escape(c['chapter_id'])}: {text(c['title'])}</h2><p>{clock(c['start_us'])} – {clock(c['end_us'])}{forced} · {text(c.get('keywords'))}</p>"
        parts.append(Raw(f"<section>{head}{_frames(frames.get(c['chapter_id'], []), ['event_id'])}<p>{text(c.get('raw_text'))}</p></section>"))
    return page(title, *parts, script=SCRIPT)


def status_page(title: str, status: Mapping[str, str], error: str | None = None, links: Mapping[str, str] | None = None) -> bytes:
    """Stages of a run with their state and the way to their results."""
    rows = [{"stage": anchor(links[s], s) if links and s in links else s, "state": v} for s, v in status.items()]
    return page(title, table(rows, ["stage", "state"]), *([("Error", Raw(f"<pre>{html.escape(error)}</pre>"))] if error else []))
