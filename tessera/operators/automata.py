"""Selectors that watch pictures come to rest, as one table-driven machine.

A clip is one segment's frames in time order with its look-ahead; `last` is the last frame that may
be emitted. What neighbouring frames say is computed once, as arrays; a selector is then a reading
of each frame as symbols, and a table of what each phase does with a symbol:

    phase     event              quiet             noise
    OPENING   arm                count             clear      until the first still picture
    IDLE      arm                -                 -          until something happens
    PENDING   arm                count             clear      until a still picture follows

`arm` notes the time of an event and forgets what was still; `count` counts still steps and fixes
the first frame that ends enough of them; `clear` begins the count anew. A fixed frame becomes a
state once the machine was calm for long enough after the last event. Only a pending event reads
on into the look-ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from ..functions import pixels as px

OPENING, IDLE, PENDING = "opening", "idle", "pending"
EVENT, QUIET, NOISE = "event", "quiet", "noise"
Geometry = dict[str, float]
Emit = tuple[int, float, list[str]]


class Clip:
    """Frames with their change scores and hashes; comparisons of two frames are kept."""

    def __init__(self, t: Sequence[float], images: Sequence[np.ndarray], fps: float, last: int | None = None):
        self.t, self.fps = np.asarray(t, float), fps
        self.last = len(self.t) - 1 if last is None else last
        # equal pictures are one: frames that stand still are compared once
        first: dict[tuple, int] = {}
        self.same = [first.setdefault((x.shape, x.tobytes()), i) for i, x in enumerate(images)]
        self.images = [images[i] for i in self.same]
        self.compare: Callable[[int, int], Geometry] = self.pairs(px.comparison)
        self.slide: Callable[[int, int], Geometry] = self.pairs(px.slide_geometry)
        self.table: Callable[[int, int], Geometry] = self.pairs(px.table_geometry)
        self.hash: Callable[[int], int] = self.each(px.perceptual_hash)
        self.density: Callable[[int], float] = self.each(px.edge_density)
        self.near: Callable[[int, int], tuple[float, float]] = self.pairs(lambda a, b: (px.frame_ssim(a, b), px.block_change(a, b)))

    def each(self, f: Callable) -> Callable:
        own = lru_cache(None)(lambda a: f(self.images[a]))
        return lambda a: own(self.same[a])

    def pairs(self, f: Callable) -> Callable:
        own = lru_cache(4096)(lambda a, b: f(self.images[a], self.images[b]))
        return lambda a, b: own(self.same[a], self.same[b])

    @property
    def change(self) -> np.ndarray:
        if not hasattr(self, "_change"):
            self._change = np.array([0.0, *(self.compare(i - 1, i)["score"] for i in range(1, len(self.t)))])
        return self._change

    def steps(self, seconds: float) -> int:
        return max(1, round(seconds * self.fps))

    def alike(self, a: int, b: int, bits: int = 4, ssim: float = 0.996, block: float = 0.012) -> bool:
        """Near-duplicate frames; the cheapest test comes first."""
        return self.same[a] == self.same[b] or ((self.hash(a) ^ self.hash(b)).bit_count() <= bits and self.near(a, b)[0] >= ssim and self.near(a, b)[1] <= block)


def merged(found: list[Emit]) -> list[Emit]:
    """One emission a frame, in order: the highest score, all reasons."""
    by: dict[int, Emit] = {}
    for i, score, reasons in found:
        old = by.get(i)
        by[i] = (i, score, reasons) if old is None else (i, max(score, old[1]), sorted({*reasons, *old[2]}))
    return [by[i] for i in sorted(by)]


class Watch:
    """The machine. A subclass reads frames, judges states and may replace cells of the table."""

    TABLE = {
        (OPENING, EVENT): "arm", (OPENING, QUIET): "count", (OPENING, NOISE): "clear",
        (IDLE, EVENT): "arm", (IDLE, QUIET): None, (IDLE, NOISE): None,
        (PENDING, EVENT): "arm", (PENDING, QUIET): "count", (PENDING, NOISE): "clear",
    }
    START = OPENING

    def __init__(self, clip: Clip, hold: float, calm: float):
        self.clip, self.hold, self.calm = clip, clip.steps(hold), calm
        self.phase, self.since, self.still, self.fixed, self.peak = self.START, 0, 0, None, 0.0
        self.out: list[Emit] = []

    # what a subclass says
    def read(self, i: int) -> Sequence[str]:
        """The symbols of frame i, in order."""
        raise NotImplementedError

    def opened(self, i: int) -> None:
        """The first still picture."""

    def state(self, i: int) -> None:
        """A still picture after an event."""

    def end(self) -> None:
        """The clip is over."""

    def rests(self, i: int) -> bool:
        """Whether frame i may be fixed, once it ends enough still steps."""
        return self.fixed is None and i <= self.clip.last

    # what the table names
    def arm(self, i: int) -> None:
        self.phase, self.since = PENDING, i
        self.clear(i)

    def count(self, i: int) -> None:
        self.still += 1
        if self.still >= self.hold and self.rests(i):
            self.fixed = i

    def clear(self, i: int) -> None:
        self.still, self.fixed = 0, None

    def run(self) -> list[Emit]:
        for i in range(1, len(self.clip.t)):
            if self.phase != PENDING and i > self.clip.last:
                break
            for symbol in self.read(i):
                if action := self.TABLE[self.phase, symbol]:
                    getattr(self, action)(i)
            ready = self.fixed is not None and (self.phase == OPENING or self.clip.t[i] - self.clip.t[self.since] >= self.calm)
            if ready:
                (self.opened if self.phase == OPENING else self.state)(self.fixed)
                self.phase, self.peak = IDLE, 0.0
                self.clear(i)
        self.end()
        return merged(self.out)


class Settled(Watch):
    """After activity, or drift away from the last rest, the frame at which the picture lies still."""

    START = IDLE
    TABLE = Watch.TABLE | {(PENDING, EVENT): None}

    def __init__(self, clip: Clip, trigger: float = 0.014, far: float = 0.024, quiet: float = 0.006, hold: float = 2.0, gap: float = 3.0):
        super().__init__(clip, hold, 0.0)
        self.far, self.span, self.gap = far, max(1.5 * quiet, 0.01), gap
        self.active, self.quiet = clip.change >= trigger, clip.change <= quiet
        self.base, self.shown = 0, -np.inf

    def read(self, i: int) -> Sequence[str]:
        away = self.clip.compare(self.base, i)["score"]
        calm = QUIET if self.quiet[i] else NOISE
        if not self.active[i] and away < self.far:
            return (calm,)
        self.peak = max(self.peak, self.clip.change[i], away)
        return EVENT, calm

    def rests(self, i: int) -> bool:
        return self.clip.compare(max(self.base, i - self.hold + 1), i)["score"] <= self.span

    def state(self, i: int) -> None:
        # the base moves even where the gap keeps the frame from being shown
        self.base = i
        if self.clip.t[i] - self.shown >= self.gap:
            self.out.append((i, max(0.4, self.peak), ["settled_after_change"]))
            self.shown = self.clip.t[i]

    def end(self) -> None:
        i = len(self.clip.t) - 1
        if self.phase == PENDING and self.clip.compare(self.base, i)["score"] >= self.far:
            self.out.append((i, max(0.3, self.peak), ["segment_end_after_change"]))


def table_event(g: Geometry, focus: bool) -> str | None:
    if g["residual_ratio"] >= 0.055 and g["residual_row_coverage"] >= 0.20 and g["residual_column_coverage"] >= 0.50:
        return "viewport"
    if focus and g["highlight_ratio"] >= 0.012 and g["highlight_row_share"] >= 0.015 and g["highlight_column_coverage"] >= 0.75:
        return "focus"
    return None


class Worksheet(Watch):
    """Distinct, still worksheet states; with `focus`, moved highlight rows are events too."""

    #: Reasons by kind of event.
    REASONS = {"viewport": "table_viewport:post_transition", "focus": "table_focus:post_row_focus"}

    def __init__(self, clip: Clip, focus: bool = False, hold: float = 1.0, calm: float = 5.0, quiet: float = 0.01):
        super().__init__(clip, hold, calm)
        self.focus, self.limit, self.kinds = focus, quiet, set()

    def read(self, i: int) -> Sequence[str]:
        g = self.clip.table(i - 1, i)
        kind = table_event(g, self.focus)
        if kind is None:
            return (QUIET if g["changed_ratio"] <= self.limit else NOISE,)
        self.kinds.add(kind)
        self.peak = max(self.peak, *(g[c] for c in ("residual_ratio", "residual_row_coverage", "highlight_ratio", "highlight_column_coverage")))
        return (EVENT,)

    def show(self, i: int, score: float, reasons: list[str]) -> None:
        if all(table_event(self.clip.table(j, i), self.focus) for j, _, _ in self.out):
            self.out.append((i, score, reasons))

    def opened(self, i: int) -> None:
        self.show(i, 0.10, ["table_focus:initial_stable" if self.focus else "table_viewport:initial_stable"])

    def state(self, i: int) -> None:
        self.show(i, max(0.20, self.peak), [r for k, r in self.REASONS.items() if k in self.kinds])
        self.kinds.clear()

    def run(self) -> list[Emit]:
        return super().run() if self.clip.last else []


def noise(g: Geometry, edge: float = 0.005) -> bool:
    most = {"component_count": 4, "largest_area": 0.006, "largest_width": 0.08, "largest_height": 0.12, "changed_ratio": 0.012, "block_spread": 0.0625}
    return g["edge_delta"] < edge and all(g[c] <= x for c, x in most.items())


def meaningful(g: Geometry) -> bool:
    return not noise(g) and (g["changed_ratio"] >= 0.003 or g["edge_delta"] >= 0.005 or g["block_spread"] >= 0.03)


def still(g: Geometry) -> bool:
    return g["soft_changed_ratio"] <= 0.002 or noise(g)


def hard(g: Geometry) -> bool:
    return g["changed_ratio"] >= 0.08 and g["block_spread"] >= 0.35


def additive(g: Geometry) -> bool:
    return g["retained"] >= 0.96 and g["edge_loss"] <= 0.004 and g["edge_gain"] >= 0.001


class Slides(Watch):
    """The states in which a slide settles; events are seen against the last state, the anchor."""

    TABLE = Watch.TABLE | {(PENDING, NOISE): "delay"}

    def __init__(self, clip: Clip, hold: float = 1.0, calm: float = 2.0):
        super().__init__(clip, hold, calm)
        self.anchor, self.first, self.page = 0, 0, False
        self.states: list[tuple[int, float, list[str], bool]] = []

    def begun(self, g: Geometry) -> Sequence[str]:
        self.page |= hard(g)
        self.peak = max(self.peak, g["changed_ratio"], g["edge_delta"], g["block_spread"])
        self.first = None
        return (EVENT,)

    def read(self, i: int) -> Sequence[str]:
        if self.phase == IDLE:
            g = self.clip.slide(self.anchor, i)
            return self.begun(g) if meaningful(g) else (QUIET,)
        g = self.clip.slide(i - 1, i)
        if self.phase == PENDING and meaningful(g):
            return self.begun(g)
        if not still(g):
            self.first = i if self.phase == OPENING else None
            return (NOISE,)
        self.first = i - 1 if self.first is None else self.first
        if still(self.clip.slide(self.first, i)):
            return (QUIET,)
        self.first = i
        return (NOISE,)

    def delay(self, i: int) -> None:
        self.since = i
        self.clear(i)

    def opened(self, i: int) -> None:
        self.states.append((i, 0.10, ["presentation:initial_stable"], False))
        self.anchor = i

    def state(self, i: int) -> None:
        g = self.clip.slide(self.anchor, i)
        page = not additive(g) and (self.page or hard(g))
        reasons = ["presentation:hard_page_change", "presentation:page_change"] if page else ["presentation:post_settle_meaningful"]
        self.states.append((i, max(0.20, self.peak, g["changed_ratio"], g["edge_delta"]), reasons, page))
        self.anchor, self.page, self.first = i, False, None

    def twin(self, a: int, b: int) -> bool:
        """Whether two states show the same slide."""
        g = self.clip.slide(a, b)
        if g["changed_ratio"] > 0.002 or g["edge_delta"] > 0.004:
            return False
        x, y = (px.crop(self.clip.images[i], 0.04, 0.02, 0.98, 0.90) for i in (a, b))
        return px.frame_ssim(x, y) >= 0.995 and (px.perceptual_hash(x) ^ px.perceptual_hash(y)).bit_count() <= 4

    def end(self) -> None:
        """Builds that only add are one state; each shown state says what ended it."""
        if self.phase == PENDING and self.fixed is not None:
            self.state(self.fixed)
        new: list[tuple[int, float, list[str], bool]] = []
        for s in self.states:
            if not any(self.twin(old[0], s[0]) for old in new):
                new.append(s)
        built = [not b[3] and additive(self.clip.slide(a[0], b[0])) for a, b in zip(new, new[1:])]
        for k, (i, score, reasons, _) in enumerate(new):
            own = [*reasons, "presentation:additive_build_final"] if k and built[k - 1] else reasons
            if k == len(new) - 1:
                self.out.append((i, score, [*own, "presentation:bounded_tail_stable"]))
            elif not built[k]:
                self.out.append((i, score, [*own, "presentation:page_terminal" if new[k + 1][3] else "presentation:pre_replacement"]))


def terminal(clip: Clip, first: int, boundary: int, back: float = 2.0, hold: float = 1.0, quiet: float = 0.008, upto: int | None = None) -> int:
    """The latest still run before a boundary whose picture lasts until it, else the frame before it."""
    end = min(boundary - 1, boundary - 1 if upto is None else upto)
    end = max(first, end)
    low, k = max(first, end - clip.steps(back) + 1), clip.steps(hold)
    calm = np.concatenate([[0], np.cumsum(clip.change[low : end + 1] <= quiet)])
    ends = np.flatnonzero(calm[k:] - calm[:-k] == k) + low + k - 1 if len(calm) > k else []
    return next((int(e) for e in ends[::-1] if all(clip.alike(int(e), j) for j in range(int(e) + 1, end + 1))), end)


def replacements(clip: Clip) -> list[tuple[int, float]]:
    """(frame, strength) where what was on screen is replaced for good: each test is one array over all frames."""
    pre, post, back, n = clip.steps(0.5), clip.steps(1.5), clip.steps(2.0), len(clip.t)
    at = np.arange(pre, max(pre, n - post))
    at = at[clip.change[at] >= 0.025]
    if not len(at):
        return []
    density = np.array([clip.density(i) for i in range(n)])
    after = at[:, None] + np.arange(1, post + 1)
    losses = density[at - pre][:, None] - density[after]

    def apart(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        d = np.abs(b.astype(np.int16) - a)
        return float(d.mean() / 255), float((d >= 12).mean())

    away = clip.pairs(apart)

    def medians(i: int, own: np.ndarray) -> tuple[float, float]:
        delta, mask = np.array([away(int(i) - pre, int(j)) for j in own]).T
        return float(np.median(delta)), float(np.median(mask))

    delta, mask = np.array([medians(i, own) for i, own in zip(at, after)]).T
    lasting = (delta >= 0.004) & (mask >= 0.001) & (losses[:, 0] >= 0.003) & ((losses >= 0.003).mean(1) >= 2 / 3)

    def reverted(i: int) -> bool:
        past, before, final = (clip.images[j] for j in (max(0, i - back), i - pre, i + post))
        return px.frame_delta(past, before) >= 0.004 and px.frame_delta(past, final) < 0.002 and px.frame_ssim(past, final) >= 0.997

    strength = np.maximum.reduce([delta, np.median(losses, 1), mask])
    return [(int(i), float(s)) for i, s in zip(at[lasting], strength[lasting]) if not reverted(int(i))]


def boundary_terminal(clip: Clip, gap: float = 3.0) -> list[Emit]:
    """The last still picture before each confirmed replacement of what was on screen."""
    events = replacements(clip)
    times = clip.t[[i for i, _ in events]] if events else np.zeros(0)
    # the first of each cluster counts; rounds begin after the last of the cluster before
    firsts = [k for k in range(len(events)) if not k or times[k] - times[k - 1] > gap]
    out: list[Emit] = []
    for k in firsts:
        i, strength = events[k]
        start = min(len(clip.t) - 1, events[k - 1][0] + clip.steps(1.5)) if k else 0
        if start > clip.last or (k and events[firsts[firsts.index(k) - 1]][0] > clip.last):
            break
        real = shown = terminal(clip, start, i)
        reasons = [f"boundary_terminal:boundary={clip.t[i]:.3f}"]
        if real > clip.last:  # the look-ahead confirms it if the picture lasts from the last frame that may be shown
            shown = terminal(clip, start, i, upto=clip.last)
            if not all(clip.alike(shown, j) for j in range(shown, real + 1)):
                break
            reasons += ["lookahead_confirmed_terminal", f"actual_terminal={clip.t[real]:.3f}"]
        out.append((shown, strength, reasons))
    return merged(out)


def presentation_states(clip: Clip) -> list[Emit]:
    if clip.fps < 1:
        raise ValueError("presentation states need at least one frame a second")
    return Slides(clip).run()


STRATEGIES: dict[str, Callable[[Clip], list[Emit]]] = {
    "settled": lambda c: Settled(c).run(),
    "boundary_terminal": boundary_terminal,
    "table_viewport": lambda c: Worksheet(c).run(),
    "table_focus": lambda c: Worksheet(c, focus=True).run(),
    "presentation_states": presentation_states,
}
