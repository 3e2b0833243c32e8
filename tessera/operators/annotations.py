"""Reviewed annotations: what they must say before they count, and how a selection scores against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePath
from statistics import median

from ..functions.time import parse_seconds
from . import evaluate
from .require import Violation

COVERAGE = ("positive_only", "exhaustive", "strategy_candidate_set")
#: What a review of a kind has to state, by the path of the key.
STATEMENTS = {
    "exhaustive": {"scope": "full_segment", "unlisted_states": "reject"},
    "strategy_candidate_set": {"scope": "selected_candidates", "unlisted_candidates": "reject"},
}
#: What an exhaustive review states as well from schema version 4 on.
ATTESTATIONS = {
    "source_review": {"basis": "source_video", "full_segment_watched": True, "algorithm_outputs_used_as_labels": False},
    "confirmation": {"confirmed_by": "user", "labels_complete": True, "plateau_windows_confirmed": True},
}
#: Names of the ground truth by coverage of a human review.
GROUND_TRUTH = {"exhaustive": "human_reviewed_full_segment", "strategy_candidate_set": "human_reviewed_strategy_candidate_set"}


def problems(doc: Mapping, video: str, start: float, duration: float, sha256: str | None = None) -> list[str]:
    """Everything that keeps an annotation document from being used for a source and range; empty if nothing does."""
    out: list[str] = []
    version = doc.get("schema_version", 1)
    if isinstance(version, bool) or not str(version).isdigit() or int(version) < 1:
        return ["schema_version must be a positive integer"]
    named = doc.get("video")
    named = named.get("basename") if isinstance(named, Mapping) else named
    if named and PurePath(str(named)).name != video:
        out.append("the annotations are of another video")
    if doc.get("source_sha256") and sha256 and str(doc["source_sha256"]) != sha256:
        out.append("source_sha256 is of another source")
    segment = doc.get("segment")
    if segment is not None:
        if not isinstance(segment, Mapping):
            out.append("segment must be a mapping")
        elif any(abs(parse_seconds(segment.get(k, v)) - v) > 0.050 for k, v in (("start", start), ("duration", duration))):
            out.append("segment is not the range that was run")
    review = doc.get("review") or {}
    if not isinstance(review, Mapping):
        return [*out, "review must be a mapping"]
    coverage = review.get("coverage", "positive_only")
    if coverage not in COVERAGE:
        return [*out, f"review.coverage must be one of {', '.join(COVERAGE)}"]
    if review.get("scope") not in (None, "full_segment", "selected_candidates"):
        out.append("review.scope must be full_segment or selected_candidates")
    out += [f"{coverage} review requires {k}={v}" for k, v in STATEMENTS.get(coverage, {}).items() if review.get(k) != v]
    if coverage == "exhaustive" and int(version) >= 4:
        for part, wants in ATTESTATIONS.items():
            said = review.get(part)
            out += [f"review.{part} must attest {k}={v}" for k, v in wants.items() if not isinstance(said, Mapping) or said.get(k) is not v and said.get(k) != v]
    if coverage == "strategy_candidate_set" and (not review.get("strategy") or len(str(review.get("strategy_file_sha256", ""))) != 64):
        out.append("a reviewed candidate set names its strategy and the 64-character hash of its file")
    if coverage != "positive_only" and doc.get("review_status") != "human_reviewed":
        out.append(f"review.coverage={coverage} requires review_status=human_reviewed")
    return out


def validate(doc: Mapping, video: str, start: float, duration: float, sha256: str | None = None) -> None:
    if found := problems(doc, video, start, duration, sha256):
        raise Violation("; ".join(found))


def point(item: object) -> tuple[float, float, float]:
    """(time, acceptable start, acceptable end) of a labelled point."""
    if not isinstance(item, Mapping) or "timestamp" not in item:
        raise Violation("each point needs a timestamp")
    t = parse_seconds(item["timestamp"])
    slack = float(item.get("tolerance_seconds", 3.0))
    if not slack >= 0:
        raise Violation("a tolerance is not negative")
    if ("acceptable_start" in item) != ("acceptable_end" in item):
        raise Violation("acceptable_start and acceptable_end go together")
    low = parse_seconds(item["acceptable_start"]) if "acceptable_start" in item else t - slack
    high = parse_seconds(item["acceptable_end"]) if "acceptable_end" in item else t + slack
    if not low <= t <= high:
        raise Violation("a point lies outside its own window")
    return t, low, high


def score_points(items: Sequence, times: Sequence[float]) -> dict:
    """Matched points of a list against selected times, one to one, with recall and the median error."""
    points = [point(x) for x in items]
    order = sorted(range(len(points)), key=lambda i: (points[i][0], i))
    chosen = sorted(times)
    pairs = {order[i]: chosen[j] for i, j in evaluate.match_points([points[i] for i in order], chosen)}
    errors = [abs(pairs[i] - points[i][0]) for i in sorted(pairs)]
    rows = [{"timestamp": t, "matched": i in pairs, "candidate": pairs.get(i), "error": abs(pairs[i] - t) if i in pairs else None} for i, (t, _, _) in enumerate(points)]
    return {"total": len(points), "matched": len(pairs), "recall": len(pairs) / len(points) if points else None, "median_error_seconds": median(errors) if errors else None, "items": rows}


def evaluate_selection(doc: Mapping, times: Sequence[float], strategy: str | None = None, sha256: str | None = None) -> dict:
    """How selected times score: points, duplicate windows, and precision and recall where the review allows them."""
    windows = []
    for item in doc.get("avoid_duplicates", []):
        a, b, most = parse_seconds(item["start"]), parse_seconds(item["end"]), int(item["max_selected_frames"])
        n = sum(a <= t <= b for t in times)
        windows.append({"start": a, "end": b, "max_selected_frames": most, "selected_frames": n, "passed": n <= most, "reason": item.get("reason", "")})
    review = doc.get("review") or {}
    human, coverage = doc.get("review_status") == "human_reviewed", review.get("coverage", "positive_only")
    stated = human and coverage in STATEMENTS and all(review.get(k) == v for k, v in STATEMENTS[coverage].items())
    whole = stated and coverage == "exhaustive"
    listed = stated and coverage == "strategy_candidate_set" and strategy == review.get("strategy")
    if listed and sha256 != str(review.get("strategy_file_sha256")):
        raise Violation("the reviewed candidate set is not this file")
    if listed and review.get("reviewed_candidate_count") is not None and int(review["reviewed_candidate_count"]) != len(times):
        raise Violation("the reviewed candidate set has another size")
    keep, nice = doc.get("must_keep", []), doc.get("nice_to_keep", [])
    quality = None
    if whole or listed:
        states = score_points([*keep, *nice], times)
        hits, total = states["matched"], states["total"]
        precision = hits / len(times) if times else None
        recall = hits / total if whole and total else None
        f1 = 2 * precision * recall / (precision + recall) if precision is not None and recall is not None and precision + recall > 0 else None
        quality = {
            "review_basis": "full_segment" if whole else "strategy_candidate_set", "review_scope": review.get("scope"), "reviewed_strategy": review.get("strategy") if listed else None,
            "selection_policy": review.get("selection_policy", "unspecified"), "selected_frames": len(times), "accepted_states": total, "accepted_matches": hits,
            "unlisted_selected_frames": len(times) - hits, "precision": precision, "recall": recall, "f1": f1, "source_segment_recall_assessable": whole,
        }
    truth = GROUND_TRUTH.get(coverage, "human_reviewed_positive_labels_not_exhaustive") if human else "annotation_yaml_not_confirmed_as_ground_truth"
    return {
        "annotation_status": doc.get("review_status", "unspecified"), "ground_truth": truth, "must_keep": score_points(keep, times), "nice_to_keep": score_points(nice, times),
        "selection_quality": quality, "avoid_duplicates": {"total": len(windows), "passed": sum(w["passed"] for w in windows), "items": windows},
    }


def curated_points(doc: Mapping, start: float, end: float) -> list[tuple[float, str]]:
    """(time, kind) of the points of a human review that are to be exported: inside the range, each once."""
    if doc.get("review_status") != "human_reviewed":
        raise Violation("a curated export requires review_status=human_reviewed")
    segment = doc.get("segment")
    if not isinstance(segment, Mapping) or not {"start", "duration"} <= segment.keys():
        raise Violation("a curated export requires an explicit segment")
    if not doc.get("must_keep"):
        raise Violation("a curated export requires a must_keep point")
    out = [(point(x)[0], str(x.get("kind", "must_keep"))) for x in doc["must_keep"]]
    times = sorted(t for t, _ in out)
    if times[0] < start or times[-1] > end + 1e-6:
        raise Violation("a curated point is outside the segment")
    if any(b - a < 1e-6 for a, b in zip(times, times[1:])):
        raise Violation("curated points must be unique")
    return out


def bound_anchors(anchors: Sequence[Mapping], segments: Sequence[Mapping], expected: str = "expected_span") -> list[str]:
    """What keeps anchors from being bound to the baseline segments they name; empty if nothing does."""
    by = {s.get("id"): s for s in segments}
    out, seen = [], set()
    for n, a in enumerate(anchors):
        name = a.get("id") if isinstance(a, Mapping) else None
        if not isinstance(name, str) or not name or name in seen:
            out.append(f"anchor {n} has no id of its own")
            continue
        seen.add(name)
        s = by.get(a.get("segment_id"))
        if s is None:
            out.append(f"{name} names no baseline segment")
            continue
        if s.get("text") != a.get("baseline_text"):
            out.append(f"{name} has another text than its segment")
        for k in ("relative_start_seconds", "relative_end_seconds", "absolute_start_seconds", "absolute_end_seconds"):
            if not abs(float(s[k]) - float(a.get(k, float("nan")))) <= 1e-6:
                out.append(f"{name} {k} is not its segment's")
        if not isinstance(a.get("baseline_span"), str) or a["baseline_span"] not in str(a.get("baseline_text")):
            out.append(f"{name} baseline_span is not in its text")
        if not isinstance(a.get(expected), str) or not a[expected]:
            out.append(f"{name} has no {expected}")
    return out
