"""The state of one stream: speech regions, windows of samples, speakers in the order of arrival.

All of it is bounded: a window of samples, and one vector for each of at most ``most_speakers`` speakers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from voxframe.operators.clustering import cosines, normalized
from voxframe.operators.segmentation import frame_geometry
from voxframe.streaming.presets import SpeechParams, StreamParams

#: An hour at 16 kHz.
MOST_SAMPLES = 16000 * 3600


class WindowBuffer:
    """Samples that wait for a whole window; windows start every hop."""

    def __init__(self, width: int, hop: int):
        if width <= 0 or hop <= 0 or hop > width:
            raise ValueError("0 < hop <= width")
        self.width, self.hop, self.start, self.held = width, hop, 0, np.zeros(0, dtype=np.float32)

    def extend(self, samples: np.ndarray) -> None:
        self.held = np.concatenate([self.held, samples])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if len(self.held) < self.width:
            return None
        at, window = self.start, self.held[: self.width]
        self.start, self.held = self.start + self.hop, self.held[self.hop :]
        return at, window

    def flush(self) -> tuple[int, np.ndarray] | None:
        """What is left, with zeros behind it up to a window."""
        if not len(self.held):
            return None
        rest, self.held = self.held, self.held[:0]
        return self.start, np.pad(rest, (0, max(0, self.width - len(rest))))

    def restart(self, start: int | None = None) -> None:
        self.held = self.held[:0]
        self.start = self.start if start is None else start


class SpeechTracker:
    """Regions of speech, frame by frame: the twin of ``segmentation.speech_regions`` with its tail kept."""

    def __init__(self, threshold: float, min_off: int):
        self.threshold, self.min_off = threshold, max(1, min_off)
        self.first: int | None = None
        self.silent = 0

    def step(self, prob: float, frame: int) -> tuple[str, int, int] | None:
        if self.first is None:
            if prob >= self.threshold:
                self.first, self.silent = frame, 0
                return "start", frame, frame
            return None
        self.silent = 0 if prob >= self.threshold or prob != prob else self.silent + 1
        return self.flush(frame + 1) if self.silent >= self.min_off else None

    def flush(self, end: int) -> tuple[str, int, int] | None:
        if self.first is None:
            return None
        first, self.first, self.silent = self.first, None, 0
        return "end", first, end


def keep_current(current: int | None, scores: dict[int, float], margin: float) -> int | None:
    """The best speaker (the last of equals), or the current one if it is within the margin of it."""
    if not scores:
        return None
    best = max(scores.values())
    last = [s for s, v in scores.items() if v == best][-1]
    return current if current in scores and best - scores[current] <= margin else last


@dataclass
class Speaker:
    centre: np.ndarray
    count: int = 1
    trust: float = 1.0
    seen: int = 0
    stable: bool = False

    def worth(self, now: int) -> float:
        """What keeps a speaker: mean similarity, how lately it was heard, and stability."""
        return self.trust / self.count + 0.25 / (1 + now - self.seen) + (0.05 if self.stable else 0.0)


@dataclass
class SpeakerCache:
    """Numbers speakers in the order of arrival; at most ``most`` of them, beyond which the best match takes the vector."""

    most: int
    threshold: float
    hits_to_stable: int
    margin: float
    speakers: dict[int, Speaker] = field(default_factory=dict)
    current: int | None = None
    step: int = 0
    next_id: int = 0

    def assign(self, vector: np.ndarray) -> tuple[int, float, bool, bool]:
        """(speaker, confidence, stable, merged because the cache is full)."""
        self.step += 1
        vector = np.asarray(vector, dtype=np.float32)
        names = list(self.speakers)
        found = cosines(vector[None], np.stack([self.speakers[n].centre for n in names]))[0] if names else []
        scores = {n: float(s) for n, s in zip(names, found)}
        chosen = keep_current(self.current, scores, self.margin)
        if chosen is not None and (scores[chosen] >= self.threshold or len(names) >= self.most):
            s, sim = self.speakers[chosen], scores[chosen]
            s.centre = normalized(((s.centre * s.count + vector) / (s.count + 1)).astype(np.float32))
            s.count, s.trust, s.seen = s.count + 1, s.trust + sim, self.step
            s.stable = s.stable or s.count >= self.hits_to_stable
            self.current = chosen
            return chosen, sim, s.stable, sim < self.threshold
        name, self.next_id = self.next_id, self.next_id + 1
        self.speakers[name] = Speaker(normalized(vector), seen=self.step, stable=self.hits_to_stable <= 1)
        self.current = name
        return name, 1.0, self.speakers[name].stable, False

    def evict(self) -> int | None:
        """Takes out the speaker of least worth (the first of equals) of a full cache."""
        if len(self.speakers) < self.most:
            return None
        weakest = min(self.speakers, key=lambda n: self.speakers[n].worth(self.step))
        del self.speakers[weakest]
        self.current = None if self.current == weakest else self.current
        return weakest


class Diarizer:
    """Turns of one stream, as its samples come. vad(frame) gives one probability, embed(window) one vector."""

    def __init__(self, params: StreamParams, speech: SpeechParams, vad: Callable[[np.ndarray], float], embed: Callable[[np.ndarray], np.ndarray]):
        self.speech, self.vad, self.embed = speech, vad, embed
        off, self.min_on = frame_geometry(speech.frame, speech.rate, speech.min_silence_ms, speech.min_speech_s)
        self.tracker = SpeechTracker(speech.threshold, off)
        self.windows = WindowBuffer(round(params.window_s * speech.rate), round(params.hop_s * speech.rate))
        self.cache = SpeakerCache(params.most_speakers, params.threshold, params.hits_to_stable, params.margin)
        self.rest, self.frames = np.zeros(0, dtype=np.float32), 0

    def __getstate__(self) -> dict:
        """What is kept between batches: all but the hooks, which may not be kept and are given anew."""
        return {k: v for k, v in self.__dict__.items() if k not in ("vad", "embed")}

    def _turn(self, start: int, window: np.ndarray, end: int) -> tuple[int, float, float, bool]:
        speaker, _, stable, _ = self.cache.assign(self.embed(window))
        return speaker, start / self.speech.rate, end / self.speech.rate, stable

    def _close(self, first: int, end: int) -> list[tuple[int, float, float, bool]]:
        if end - first < self.min_on:
            self.windows.restart()
            return []
        left = self.windows.flush()
        return [self._turn(left[0], left[1], min(end * self.speech.frame, left[0] + len(left[1])))] if left else []

    def feed(self, samples: np.ndarray) -> list[tuple[int, float, float, bool]]:
        """(speaker, start, end, stable) of the turns that the samples complete."""
        size, out = self.speech.frame, []
        if self.frames * size + len(self.rest) + len(samples) > MOST_SAMPLES:
            raise ValueError("a stream has an hour at most")
        held = np.concatenate([self.rest, np.asarray(samples, dtype=np.float32)])
        for at in range(0, len(held) - size + 1, size):
            frame = held[at : at + size]
            event = self.tracker.step(float(self.vad(frame)), self.frames)
            self.frames += 1
            if event and event[0] == "start":
                self.windows.restart(event[1] * size)
            elif event:
                out += self._close(event[1], event[2])
            if self.tracker.first is not None:
                self.windows.extend(frame)
                while (window := self.windows.pop()) is not None:
                    out.append(self._turn(window[0], window[1], window[0] + len(window[1])))
        self.rest = held[len(held) // size * size :]
        return out

    def flush(self) -> list[tuple[int, float, float, bool]]:
        """The turns that the end of the stream completes; a part of a frame is left out, and speakers stay known."""
        self.rest = self.rest[:0]
        event = self.tracker.flush(self.frames)
        return self._close(event[1], event[2]) if event else []
