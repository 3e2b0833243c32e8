"""Text recognition as a pluggable backend: routes, regions, validity, failures as rows, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Region of interest by kind, as x, y, width, height.
REGIONS = {"presentation": (0.0, 0.0, 1.0, 0.92), "table": (0.0, 0.25, 1.0, 0.67), "chart": (0.0, 0.0, 1.0, 1.0), "unknown": (0.0, 0.0, 1.0, 1.0)}
OBSERVATION = "array<struct<`order`: int, text: string, confidence: double, bbox: array<double>>>"


class Backend(Protocol):
    def describe(self) -> dict: ...

    def recognize(self, image: bytes, languages: Sequence[str], kind: str, region: Sequence[float]) -> list[dict]: ...


def problem(text: object, confidence: object, bbox: object) -> str | None:
    """What is wrong with an observation, or None."""
    if not isinstance(text, str) or not text.strip():
        return "blank text"
    if confidence is not None and not (isinstance(confidence, (int, float)) and 0 <= confidence <= 1):
        return "confidence out of range"
    if not isinstance(bbox, (list, tuple)) or len(bbox) != 4 or not all(isinstance(v, (int, float)) and 0 <= v <= 1 for v in bbox):
        return "bad box"
    x, y, w, h = bbox
    return None if x + w <= 1.000001 and y + h <= 1.000001 else "box leaves the image"


def recognize(frames: DataFrame, backend: Callable[[], Backend], routes: Sequence[str], languages: Sequence[str] = ("en",)) -> DataFrame:
    """frames(sample_index, route_kind, image, ...) with status, region, observations, plain_text and error.

    Kinds outside `routes` are skipped with a reason. A failing image gives an error row; others go on.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = backend()
        for part in parts:
            out = []
            for image, kind in zip(part["image"], part["route_kind"]):
                region = list(REGIONS.get(kind, REGIONS["unknown"]))
                if kind not in routes:
                    out.append(("skipped", region, [], "", "route_not_requested", None))
                    continue
                try:
                    got = sorted(engine.recognize(bytes(image), languages, kind, region), key=lambda o: (o["bbox"][1], o["bbox"][0]))
                    bad = next((p for p in (problem(o.get("text"), o.get("confidence"), o.get("bbox")) for o in got) if p), None)
                    if bad:
                        raise ValueError(bad)
                    seen = [{"order": i, "text": o["text"], "confidence": o.get("confidence"), "bbox": [float(v) for v in o["bbox"]]} for i, o in enumerate(got)]
                    out.append(("ok", region, seen, "\n".join(o["text"] for o in seen), None, None))
                except Exception as e:  # a row of its own, so that one image does not end the run
                    out.append(("error", region, [], "", None, f"{type(e).__name__}: {e}"))
            yield part.drop(columns="image").assign(**dict(zip(("status", "roi_normalized", "observations", "plain_text", "reason", "error"), map(list, zip(*out)))))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != "image")
    return frames.mapInPandas(run, f"{own}, status string, roi_normalized array<double>, observations {OBSERVATION}, plain_text string, reason string, error string")


def summary(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failures"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(F.size("observations")), F.lit(0)).alias("observations"))
