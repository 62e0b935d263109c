"""Column functions on vectors, samples and class probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.turns import cosine, dot

#: The speaker sets of the seven classes, in order.
POWERSET = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def cosine_mixed(a: Column, b: Column) -> Column:
    """Cosine of a single with a double precision vector, the latter narrowed first."""
    return cosine(a, F.transform(b, lambda v: v.cast("float")))


def l2_normalize(x: Column) -> Column:
    """Unit length; zeros if the norm is not finite, unchanged if it is at most 1e-8."""
    def scaled(n: Column) -> Column:
        finite = ~F.isnan(n) & (n < float("inf"))
        return F.when(~finite, F.transform(x, lambda v: F.lit(0.0))).when(n > 1e-8, F.transform(x, lambda v: v / n)).otherwise(F.transform(x, lambda v: v.cast("double")))

    return F.transform(F.array(F.sqrt(dot(x, x))), scaled)[0]


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite where the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(F.size(a) == F.size(b), F.sqrt(total(squares))).otherwise(float("inf"))


def softmax(logits: Column) -> Column:
    """exp(x - max), divided by its sum, or by 1 where that is 0."""
    low = F.transform(logits, lambda v: F.exp(v.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(F.array(low), lambda e: F.transform(e, lambda v: v / F.when(total(e) == 0, 1.0).otherwise(total(e))))[0]


def speakers_of_class(cls: Column) -> Column:
    """The speakers of a class, null for an unknown one."""
    table = F.array(*[F.array(*map(F.lit, s)).cast("array<int>") for s in POWERSET])
    return F.when((cls >= 0) & (cls < len(POWERSET)), F.get(table, cls))


def class_of_speakers(speakers: Column) -> Column:
    """The class of a set of speakers, in any order; null for a set that has none."""
    known = F.create_map(*[x for i, s in enumerate(POWERSET) for x in (F.lit(",".join(map(str, s))), F.lit(i))])
    return known[F.array_join(F.transform(F.array_sort(F.array_distinct(speakers)), lambda s: s.cast("string")), ",")]


def frame_class(probs: Column) -> Column:
    """struct(cls, p): the first class of greatest probability; class 0 and 0 where none is over 0."""
    top = F.array_max(probs)
    return F.when(top > 0, F.struct((F.array_position(probs, top) - 1).cast("int").alias("cls"), top.alias("p"))).otherwise(F.struct(F.lit(0).alias("cls"), F.lit(0.0).alias("p")))


def speaker_probs(probs: Column) -> Column:
    """The three speakers' probabilities: sums over the classes that hold them."""
    return F.array(*[sum((F.get(probs, F.lit(i)) for i, s in enumerate(POWERSET) if who in s), F.lit(0.0)) for who in range(3)])


def pre_emphasis(x: Column, k: float = 0.97) -> Column:
    """x[i] - k x[i - 1], the first sample kept."""
    return F.concat(F.slice(F.transform(x, lambda v: v.cast("double")), F.lit(1), F.lit(1)), F.zip_with(F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1)), F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - 1)), lambda now, before: now.cast("double") - k * before.cast("double")))


def hamming(n: int) -> Column:
    return F.array(*[F.lit(0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) if n > 1 else 1.0) for i in range(n)])


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)


def silence_spans(samples: Column, spans: Column, rate: int, start: Column | None = None) -> Column:
    """Samples with zeros in [floor(s rate), ceil(e rate)) of every span (struct of start and end); spans without a length are passed over."""
    first = F.lit(0) if start is None else start
    usable = F.filter(spans, lambda s: (s["end"] > s["start"]) & (F.abs(s["start"]) < float("inf")) & (F.abs(s["end"]) < float("inf")))
    return F.transform(samples, lambda v, i: F.when(F.exists(usable, lambda s: (i + first >= F.floor(s["start"] * rate)) & (i + first < F.ceil(s["end"] * rate))), F.lit(0.0)).otherwise(v.cast("double")))


def center_crop(samples: Column, seconds: float, rate: int) -> Column:
    """The middle round(seconds rate) samples; all, if there are fewer."""
    n = round(seconds * rate)
    return F.when(F.size(samples) <= n, samples).otherwise(F.slice(samples, F.floor((F.size(samples) - n) / 2).cast("int") + 1, F.lit(n)))


def downmix(frames: Column) -> Column:
    """The mean of the channels of each frame (an array of arrays)."""
    return F.transform(frames, lambda f: total(f) / F.greatest(F.lit(1), F.size(f)))


def energy(frame: Column, threshold_db: float) -> Column:
    """Speech probability of a frame by its energy: the root of the squares' sum over the threshold, 1 at most."""
    return F.least(F.lit(1.0), F.sqrt(dot(frame, frame)) / F.lit(10.0 ** (threshold_db / 20.0)))
