"""Parameters by latency, profiles and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class StreamParams:
    window_s: float
    hop_s: float
    right_s: float
    most_speakers: int
    hits_to_stable: int
    margin: float
    threshold: float = 0.45

    def __post_init__(self):
        if not all(math.isfinite(x) for x in (self.window_s, self.hop_s, self.right_s, self.margin, self.threshold)):
            raise ValueError("parameters are finite")
        if self.window_s <= 0 or self.hop_s <= 0 or self.hop_s > self.window_s or self.right_s < 0:
            raise ValueError("0 < hop <= window, and no negative context")
        if self.most_speakers < 1 or self.hits_to_stable < 1 or self.margin < 0 or not -1 <= self.threshold <= 1:
            raise ValueError("at least one speaker and hit, a margin from 0 on, a threshold from -1 to 1")

    def latency(self, rate: int, frame: int) -> float:
        """Seconds of audio that wait before a window is answered."""
        return self.window_s + self.right_s + frame / rate


#: Fixed values.
PRESETS = {
    "realtime": StreamParams(1.0, 0.5, 0.0, 16, 2, 0.05),
    "balanced": StreamParams(1.5, 0.75, 0.0, 32, 3, 0.08),
    "accurate": StreamParams(2.0, 1.0, 0.25, 64, 4, 0.10),
}
#: Other names of presets.
ALIASES = {"rt": "realtime", "low": "realtime", "default": "balanced", "high": "accurate"}


def preset(name: str) -> StreamParams:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PRESETS:
        raise ValueError(f"the preset is one of {sorted(PRESETS)}")
    return PRESETS[key]


@dataclass(frozen=True)
class SpeechParams:
    """When a frame is speech, and which regions count."""

    frame: int = 512
    rate: int = 16000
    threshold: float = 0.5
    min_silence_ms: float = 300.0
    min_speech_s: float = 0.25

    def __post_init__(self):
        if self.frame <= 0 or not 8000 <= self.rate <= 192000:
            raise ValueError("a frame has samples, and a rate is from 8000 to 192000")
        if not (math.isfinite(self.threshold) and math.isfinite(self.min_silence_ms) and math.isfinite(self.min_speech_s)) or self.min_silence_ms < 0 or self.min_speech_s < 0:
            raise ValueError("thresholds are finite, and lengths not negative")
