"""The ladder of attempts at a page: the next rung is climbed only if those before weren't good enough."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from ..config import OcrKnobs
from ..functions.text import SPACES


@dataclass(frozen=True)
class Reading:
    """What a recogniser has read: its text, the mean confidence and the number of words."""

    text: str
    confidence: float
    words: int

    @property
    def chars(self) -> int:
        """As UTF-16 engines count them."""
        return len(self.text) + sum(c > "\uffff" for c in self.text)


@dataclass(frozen=True)
class Rung:
    """How an attempt looks at an image: as it is, prepared, or prepared to black and white; with the first or second layout mode; turned by an angle."""

    label: str
    mode: int
    angle: int = 0


@dataclass(frozen=True)
class Climbed:
    """What is taken of a page: the reading (None if all attempts failed), its rung and score, and how many attempts were made and failed."""

    reading: Reading | None
    rung: Rung | None
    score: float
    made: int
    failed: int


#: Attempt at a rung; it may raise.
Attempt = Callable[[Rung], Reading]
#: Whether the image that a rung looks at could be made.
Ready = Callable[[Rung], bool]


def score(r: Reading) -> float:
    return min(max(r.confidence, 0.0), 100.0) + min(r.chars / 120, 35.0) + min(12 * math.log10(r.words + 1.0), 25.0) * 1.2


def good(r: Reading, knobs: OcrKnobs) -> bool:
    return r.confidence >= knobs.good_confidence and r.words >= knobs.good_words and r.chars >= knobs.good_chars


def weak(r: Reading, knobs: OcrKnobs) -> bool:
    return r.words <= knobs.weak_words or r.confidence <= knobs.weak_confidence or r.chars <= knobs.weak_chars


def later_rungs(knobs: OcrKnobs) -> tuple[Rung, ...]:
    """What follows an attempt that isn't good enough, as far as max_attempts allows."""
    return (Rung("prep", knobs.mode), Rung("orig", knobs.second_mode), Rung("prep_thr", knobs.second_mode))


def preparation(rung: Rung, knobs: OcrKnobs = OcrKnobs(), tools: str = "") -> tuple[tuple[str, str], ...]:
    """The steps, with their settings, by which the image of a rung is prepared: grey, without transparency, straightened, normalised, resized if it is
    scaled, and for the last rung made black and white by the best way that tools, the help text of an image program, names."""
    if rung.label == "rotated":
        return (("rotate", str(rung.angle)),)
    if rung.label == "orig":
        return ()
    steps = [("colorspace", "Gray"), ("alpha", "off"), ("deskew", f"{knobs.deskew:g}%"), ("normalize", "")]
    if knobs.scale != 100:
        steps += [("filter", "Lanczos"), ("resize", f"{knobs.scale}%")]
    if rung.label == "prep_thr":
        named = {"adaptive-threshold": knobs.adaptive_threshold, "lat": knobs.lat, "threshold": knobs.threshold}
        way = next((k for k in ("adaptive-threshold", "lat") if re.search(rf"-{k}\b", tools, re.IGNORECASE)), "threshold")
        steps.append((way, named[way]))
    return tuple(steps)


def climb(attempt: Attempt, ready: Ready = lambda rung: True, knobs: OcrKnobs = OcrKnobs(), angles: Sequence[int] = ()) -> Climbed:
    """Attempts in order, up to max_attempts; the first that is good enough is taken and ends them, else the best score, and the first of equals.

    Further rungs are queued by an attempt that was read and isn't good enough; one that fails is skipped and queues none, so that a first one that
    fails ends the ladder. A rung whose image can't be made is left out, and none is climbed twice. Then, if turning is enabled and what is best is neither good enough nor more than
    weak evidence, the first rotate_max_attempts angles are tried: one counts with words enough and gain enough over the score before.
    """
    queue = [Rung("orig", knobs.mode)]
    best: Reading | None = None
    taken, top = None, -math.inf
    made = failed = 0
    k = 0
    while k < len(queue):
        rung = queue[k]
        k += 1
        made += 1
        try:
            reading = attempt(rung)
        except Exception:
            failed += 1
            continue
        if score(reading) > top:
            best, taken, top = reading, rung, score(reading)
        if good(reading, knobs):
            best, taken, top = reading, rung, score(reading)
            break
        for after in later_rungs(knobs):
            if len(queue) < knobs.max_attempts and after not in queue and ready(after):
                queue.append(after)
    if knobs.rotate and (best is None or not good(best, knobs) and weak(best, knobs)):
        before = top
        for angle in list(angles)[: knobs.rotate_max_attempts]:
            rung = Rung("rotated", knobs.mode, angle)
            made += 1
            try:
                if not ready(rung):
                    made -= 1
                    continue
                reading = attempt(rung)
            except Exception:
                failed += 1
                continue
            if reading.words >= knobs.rotate_min_words and score(reading) - before >= knobs.rotate_min_gain and score(reading) > top:
                best, taken, top = reading, rung, score(reading)
    return Climbed(best, taken, top, made, failed)


def reading_of(table: str) -> Reading:
    """The words of a recogniser's table of tab-separated lines, as operators.ocr's tsv_words and tsv_text read them: words of a line are joined by
    spaces, a line ends where its key changes, and a confidence counts if it is finite and not negative."""
    out: list[str] = []
    confidences: list[float] = []
    last = None
    for key, confidence, word in _words(table):
        if out:
            out.append(" " if key == last else "\n")
        out.append(word)
        last = key
        if confidence is not None and 0 <= confidence < math.inf:
            confidences.append(confidence)
    return Reading("".join(out), sum(confidences) / len(confidences) if confidences else 0.0, (len(out) + 1) // 2)




def _words(table: str) -> Iterator[tuple[tuple[str, ...], float | None, str]]:
    for line in table.split("\n"):
        cells = line.rstrip("\r").split("\t")
        if len(cells) < 12 or cells[0] != "5" or not (word := cells[11].strip(SPACES)):
            continue
        yield tuple(cells[1:5]), _number(cells[10]), word


def _number(text: str) -> float | None:
    """A number at the beginning of a cell, as far as it goes."""
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text, re.ASCII)
    return float(found[1]) if found else None
