"""Column functions on turns, words and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_S = 0.01
MOST_FRAMES = 8_640_000
#: Letters whose upper case is several letters or of a late Unicode version in Spark, where SQL keeps to one letter or leaves them.
FULL_CASED = "ßŉƛǰɤΐΰև\u1c8aẖẗẘẙẚὐὒὔὖ" + "".join(map(chr, range(0x1F80, 0x1FB0))) + "ᾲᾳᾴᾶᾷᾼῂῃῄῆῇῌῒ\u1fd3ῖῗῢ\u1fe3ῤῦῧῲῳῴῶῷῼ\ua7cd\ua7db" + "".join(map(chr, [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0x10D70, 0x10D86)]))


def duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(s1, s2) - F.least(e1, e2))


def speaker_label(speaker: Column) -> Column:
    return F.concat(F.lit("SPEAKER_"), F.when(speaker < 10, F.concat(F.lit("0"), speaker.cast("string"))).otherwise(speaker.cast("string")))


def first_frame(start: Column) -> Column:
    """Frame that holds the start; NaN and negative starts count as 0."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.nanvl(start, F.lit(0.0)) / F.lit(FRAME_S), F.lit(float(MOST_FRAMES)))))


def end_frame(end: Column) -> Column:
    return F.ceil(F.greatest(F.lit(0.0), F.least(F.nanvl(end, F.lit(0.0)) / F.lit(FRAME_S), F.lit(float(MOST_FRAMES)))))


def timecode(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds; negative and non-finite times count as 0."""
    ms = F.rint(F.when((seconds > 0) & (seconds < 1e12), seconds).otherwise(0.0) * 1000).cast("long")

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    hours = F.floor(ms / 3_600_000)
    shown = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def cue_text(text: Column) -> Column:
    """Text that can stand in a cue: each line break is a space, no arrow."""
    return F.replace(F.regexp_replace(text, r"\r\n|\r|\n", " "), F.lit("-->"), F.lit("-- >"))


def vtt_text(text: Column) -> Column:
    return F.replace(F.replace(cue_text(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def ends_sentence(word: Column) -> Column:
    return F.regexp_replace(word, "[\"')\\]}]+$", "").rlike("[.?!]$")


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as in SQL: each letter gives one, so that a sharp s does not become two."""
    one = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 and c < "\ua7cd" and c not in "ƛɤ\u1c8a" else c for c in FULL_CASED}
    table = F.create_map(*[F.lit(x) for pair in one.items() for x in pair])
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.upper(c)))
    return F.when(text.rlike(f"[{FULL_CASED}]"), F.array_join(letters, "")).otherwise(F.upper(text))


def rounded(x: Column | str, places: int) -> Column:
    """To so many decimals as SQL does it: the scaled double's nearest whole number, halves away from 0, the sign of a zero kept."""
    scale = F.lit(10.0**places)

    def whole(y: Column) -> Column:
        even = F.rint(y)
        return F.when((y - even == 0.5) & (y > 0), even + 1).when((y - even == -0.5) & (y < 0), even - 1).otherwise(even) / scale

    return F.transform(F.array((F.col(x) if isinstance(x, str) else x) * scale), whole)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a squared norm is under 1e-8 or not finite."""
    na, nb = dot(a, a), dot(b, b)
    fine = (F.size(a) == F.size(b)) & (na >= 1e-8) & (nb >= 1e-8) & (na < float("inf")) & (nb < float("inf"))
    return F.when(fine, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(0.0)


def contains(start: Column, end: Column, at: Column) -> Column:
    """Whether a time lies in the range, both ends included."""
    return (start <= at) & (at <= end)


def anchor(start: Column, end: Column, which: str) -> Column:
    if which not in ("start", "mid", "end"):
        raise ValueError("the anchor is start, mid or end")
    return {"start": start, "mid": (start + end) / 2, "end": end}[which]


def needs_repair(start: Column, end: Column) -> Column:
    """Whether a word's times are not finite or have no length."""
    return ~F.coalesce((end > start) & (F.abs(start) < float("inf")) & (F.abs(end) < float("inf")), F.lit(False))


def confidence(similarity: Column, steepness: float = 10.0, middle: float = 0.5) -> Column:
    """Logistic confidence of a cosine similarity, which counts as -1 if it is not finite. Parameters that can't be used are replaced by the defaults."""
    finite = lambda x: x == x and abs(x) < float("inf")
    k = steepness if finite(steepness) and steepness > 0 else 10.0
    m = middle if finite(middle) else 0.5
    known = F.when(F.isnan(similarity) | (F.abs(similarity) == float("inf")), -1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), similarity)))
    x = k * (known - m)
    return F.when(x >= 20, 1.0).when(x <= -20, 0.0).otherwise(1 / (1 + F.exp(-x)))


def distance_confidence(distance: Column, steepness: float = 10.0, middle: float = 0.5) -> Column:
    """Confidence of a cosine distance, which counts as 2 if it is not finite."""
    known = F.when(F.isnan(distance) | (F.abs(distance) == float("inf")), 2.0).otherwise(distance)
    return confidence(1 - known, steepness, middle)
