"""Recognisers outside this engine: a process that speaks JSON, and speech recognition with its ledger.

A helper process reads one JSON request from its standard input and writes one JSON answer. It
must echo the protocol's name and what it was asked, so that an answer of another request is seen.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import subprocess
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ocr, speech
from .require import Violation


class Unavailable(RuntimeError):
    """A helper cannot be started, does not end in time or does not speak the protocol."""


def call(command: Sequence[str], request: dict, protocol: str, seconds: float) -> dict:
    """The answer of a helper process to a request."""
    try:
        done = subprocess.run(list(command), input=json.dumps({"protocol": protocol, **request}).encode(), capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise Unavailable(f"{command[0]}: {e}") from e
    if done.returncode:
        raise Unavailable(f"{command[0]} ended with {done.returncode}: {done.stderr.decode(errors='replace')[:500]}")
    try:
        answer = json.loads(done.stdout)
    except ValueError as e:
        raise Unavailable(f"{command[0]} gave no JSON") from e
    if not isinstance(answer, dict) or answer.get("protocol") != protocol:
        raise Unavailable(f"{command[0]} does not speak {protocol}")
    return answer


@dataclass(frozen=True)
class ProcessOcr:
    """Text recognition by a helper process; an ocr.Backend."""

    command: tuple[str, ...]
    protocol: str = "ocr-helper-v1"
    seconds: float = 60.0

    def describe(self) -> dict:
        return {"engine": "process", "command": list(self.command), "protocol": self.protocol}

    def recognize(self, image: bytes, languages: Sequence[str], kind: str, region: Sequence[float]) -> list[dict]:
        sha = hashlib.sha256(image).hexdigest()
        answer = call(self.command, {"image": base64.b64encode(image).decode(), "image_sha256": sha, "languages": list(languages), "route_kind": kind, "roi": list(region)}, self.protocol, self.seconds)
        if answer.get("image_sha256") != sha or not isinstance(answer.get("observations"), list):
            raise Unavailable("the answer is of another image")
        return answer["observations"]


class SpeechBackend(Protocol):
    def describe(self) -> dict: ...

    def transcribe(self, audio: bytes, language: str, prompt: str | None, profile: str) -> dict: ...


@dataclass(frozen=True)
class ProcessSpeech:
    """Speech recognition by a helper process; it echoes the hash of prompt and audio, and the profile."""

    command: tuple[str, ...]
    protocol: str = "asr-helper-v1"
    seconds: float = 1800.0

    def describe(self) -> dict:
        return {"engine": "process", "command": list(self.command), "protocol": self.protocol}

    def transcribe(self, audio: bytes, language: str, prompt: str | None, profile: str) -> dict:
        asked = {"audio_sha256": hashlib.sha256(audio).hexdigest(), "prompt_sha256": hashlib.sha256((prompt or "").encode()).hexdigest(), "prompt_length": len(prompt or ""), "decoding_profile": profile}
        answer = call(self.command, {"audio": base64.b64encode(audio).decode(), "language": language, "initial_prompt": prompt, **asked}, self.protocol, self.seconds)
        if any(answer.get(k) != v for k, v in asked.items()):
            raise Unavailable("the answer is of another request")
        return answer


PROFILES = ("fixed_zero", "fallback")


def prompt(value: str | None) -> str | None:
    """A prompt as it may be used: trimmed, 1 to 1000 characters, none of them for control."""
    if value is None:
        return None
    if any(unicodedata.category(c) == "Cc" for c in value):
        raise ValueError("a prompt holds no control characters")
    if not 1 <= len(value.strip()) <= 1000:
        raise ValueError("a prompt has 1 to 1000 characters")
    return value.strip()


def transcribe(audio: DataFrame, backend: Callable[[], SpeechBackend], language: str, initial_prompt: str | None = None, profile: str = "fixed_zero") -> DataFrame:
    """audio(video_id, range_start, audio_seconds, content) with status, segments and, of a failure, its stage and error.

    One source's failure is a row; others go on.
    """
    if profile not in PROFILES:
        raise ValueError(f"a decoding profile is one of {', '.join(PROFILES)}")
    said = prompt(initial_prompt)
    segment = "struct<id:int,start:double,end:double,text:string,tokens:array<bigint>,temperature:double,avg_logprob:double,compression_ratio:double,no_speech_prob:double,words:array<struct<word:string,start:double,end:double,probability:double>>>"

    def plain(x: object) -> object:
        return None if isinstance(x, float) and not math.isfinite(x) else x

    def run(parts):
        engine = backend()
        for part in parts:
            out = []
            for raw in part["content"]:
                try:
                    got = engine.transcribe(bytes(raw), language, said, profile).get("segments")
                    if not isinstance(got, list):
                        raise ValueError("the answer has no segments")
                    rows = [
                        {
                            "id": i, "start": float(s["start"]), "end": float(s["end"]), "text": str(s.get("text") or ""), "tokens": [int(t) for t in s.get("tokens") or []],
                            **{k: plain(s.get(k)) for k in ("temperature", "avg_logprob", "compression_ratio", "no_speech_prob")},
                            "words": [{"word": str(w["word"]), "start": float(w["start"]), "end": float(w["end"]), "probability": plain(w.get("probability"))} for w in s.get("words") or []],
                        }
                        for i, s in enumerate(got)
                    ]
                    out.append(("ok", rows, None, None, None))
                except Exception as e:  # a row of its own, so that one source does not end the run
                    out.append(("error", [], "transcribe", type(e).__name__, str(e)))
            names = ("status", "segments", "stage", "error_type", "error")
            yield part.drop(columns="content").assign(**dict(zip(names, map(list, zip(*out))))) if out else part.drop(columns="content").assign(**{n: [] for n in names})

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in audio.schema if f.name != "content")
    return audio.mapInPandas(run, f"{own}, status string, segments array<{segment}>, stage string, error_type string, error string")


def asr_ledger(raw: DataFrame, elapsed: Column | None = None) -> dict[str, DataFrame]:
    """Normalised segments, the quality gate, totals and failures of transcribe().

    A source that fails its gate is a failure of stage quality_gate; its segments stay as evidence.
    """
    rows = raw.where("status = 'ok'").select("video_id", "range_start", "audio_seconds", F.explode("segments").alias("s")).select("video_id", "range_start", "audio_seconds", F.col("s.id").alias("speech_id"), "s.start", "s.end", "s.text", "s.words", "s.tokens", "s.temperature", "s.avg_logprob", "s.compression_ratio", "s.no_speech_prob")
    segments = speech.normalise(rows)
    gate = speech.quality_gate(segments, ["video_id"], ["speech_id"], ratio="compression_ratio")
    failed = raw.where("status <> 'ok'").select("video_id", "stage", "error_type", "error")
    gated = gate.where("not passed").select("video_id", F.lit("quality_gate").alias("stage"), F.lit("QualityGate").alias("error_type"), F.array_join("failures", ", ").alias("error"))
    silent = raw.where("status = 'ok' and size(segments) = 0").select("video_id", F.lit("transcribe").alias("stage"), F.lit("NoSpeech").alias("error_type"), F.lit("no segments").alias("error"))
    return {"segments": segments, "quality": gate, "totals": speech.totals(segments, ["video_id"]), "failures": failed.unionByName(gated).unionByName(silent)}


def ocr_ledger(frames: DataFrame, backend: Callable[[], ocr.Backend], routes: Sequence[str], languages: Sequence[str] = ("zh-Hans", "en-US")) -> DataFrame:
    """Recognition of evidence frames; routes that are unknown kinds are refused before a job starts."""
    from .routing import KINDS

    if unknown := sorted(set(routes) - set(KINDS)):
        raise Violation(f"unknown routes: {', '.join(unknown)}")
    return ocr.recognize(frames, backend, routes, languages)


# ---- boxes -------------------------------------------------------------------------------

def pixel_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The whole pixels that a relative region touches, at least one, and the region that they make:
    struct(left, top, right, bottom, x, y, w, h)."""
    left, top = F.greatest(F.lit(0), F.floor(x * width)), F.greatest(F.lit(0), F.floor(y * height))
    left, top = F.least(left, width - 1).cast("int"), F.least(top, height - 1).cast("int")
    right = F.greatest(left + 1, F.least(width, F.ceil((x + w) * width))).cast("int")
    bottom = F.greatest(top + 1, F.least(height, F.ceil((y + h) * height))).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), (left / width).alias("x"), (top / height).alias("y"), ((right - left) / width).alias("w"), ((bottom - top) / height).alias("h"))


def whole_image_box(box: Column, region: Column) -> Column:
    """A box in a region, measured from its bottom left, as (x, y, w, h) of the whole image from the top
    left, kept within 0 and 1 and rounded to six places. box: array of four; region: pixel_region()."""
    keep = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    x0, x1 = keep(box[0]), keep(box[0] + box[2])
    y0, y1 = keep(1.0 - box[1] - box[3]), keep(1.0 - box[1])
    left, top = region["x"] + x0 * region["w"], region["y"] + y0 * region["h"]
    return F.array(*[F.round(v, 6) for v in (left, top, (x1 - x0) * region["w"], (y1 - y0) * region["h"])])


def reading_order(observations: Column) -> Column:
    """Observations by y, then x, then the order in which they came, and numbered anew.

    observations: array<struct<order, text, confidence, bbox>>.
    """
    by = F.array_sort(F.transform(observations, lambda o: F.struct(o["bbox"][1].alias("y"), o["bbox"][0].alias("x"), o["order"].alias("n"), o.alias("o"))))
    return F.transform(by, lambda x, i: F.struct(i.cast("int").alias("order"), x["o"]["text"].alias("text"), x["o"]["confidence"].alias("confidence"), x["o"]["bbox"].alias("bbox")))
