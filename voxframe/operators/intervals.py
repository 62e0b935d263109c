"""Interval operators on turns (file, ord, speaker, start, end). All are keyed by file, so they scale over recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.turns import gap, overlap


def merge_adjacent(turns: DataFrame, max_gap: float) -> DataFrame:
    """Neighbours in input order with one speaker and a small gap become one; the end is the last end. A confidence becomes the mean of those that are not null."""
    at = Window.partitionBy("file").orderBy("ord")
    joins = F.lag("speaker").over(at).eqNullSafe(F.col("speaker")) & (F.lag("ord").over(at).isNotNull()) & (F.col("start") - F.lag("end").over(at) <= max_gap)
    marked = turns.withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(at))
    return marked.groupBy("file", "run").agg(F.min("speaker").alias("speaker"), F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.count(F.lit(1)).alias("n_merged"), *([F.avg("confidence").alias("confidence")] if "confidence" in turns.columns else [])).drop("run")


def merge_by_speaker(turns: DataFrame, max_gap: float = 0.0) -> DataFrame:
    """Union of each speaker's turns: sorted by start, joined while the running end is within the gap."""
    at = Window.partitionBy("file", "speaker").orderBy("start", "end")
    before = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    marked = turns.select("file", "speaker", "start", "end", F.when(before.isNull() | (F.col("start") > before + max_gap), 1).otherwise(0).alias("fresh"))
    return marked.withColumn("run", F.sum("fresh").over(at.rowsBetween(Window.unboundedPreceding, 0))).groupBy("file", "speaker", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def binned_join(left: DataFrame, right: DataFrame, condition: Column, width: float) -> DataFrame:
    """Rows of left (file, start, end) and right (rfile, rstart, rend) that can overlap, by equal bins of time.

    Each pair appears once, in the first bin that both sides share.
    """
    lo, hi = left.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))), right.withColumn("rbin", F.explode(F.sequence(F.floor(F.col("rstart") / width), F.floor(F.col("rend") / width))))
    met = lo.join(hi, (F.col("file") == F.col("rfile")) & (F.col("bin") == F.col("rbin")) & condition)
    return met.where(F.col("bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("rstart") / width))).drop("bin", "rbin", "rfile")


def overlapping_pairs(turns: DataFrame, width: float = 60.0) -> DataFrame:
    """Pairs of turns of different speakers that overlap, with the length of the overlap.

    Each pair is a row of the result, so the result grows with the square of how many speak at once. What is shuffled does not: the turns
    in their bins, once for both sides.
    """
    cut = turns.select("file", "ord", "speaker", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    meet = (a("ord") < b("ord")) & (a("speaker") != b("speaker")) & (a("start") < b("end")) & (b("start") < a("end"))
    # A pair counts in the first bin that both share.
    met = cut.alias("a").join(cut.alias("b"), (a("file") == b("file")) & (a("bin") == b("bin")) & meet & (a("bin") == F.floor(F.greatest(a("start"), b("start")) / width)))
    return met.select(a("file").alias("file"), a("ord").alias("ord"), b("ord").alias("ord2"), overlap(a("start"), a("end"), b("start"), b("end")).alias("shared"))


def speaker_at_midpoint(words: DataFrame, turns: DataFrame, width: float = 60.0) -> DataFrame:
    """words with the speaker of the first turn (in turn order) that covers the midpoint, ends inclusive; else null."""
    mids = words.withColumn("mid", (F.col("start") + F.col("end")) / 2)
    points = mids.select("file", "word_ord", F.col("mid").alias("start"), F.col("mid").alias("end"))
    right = turns.select(F.col("file").alias("rfile"), F.col("ord").alias("t_ord"), F.col("speaker").alias("t_speaker"), F.col("start").alias("rstart"), F.col("end").alias("rend"))
    met = binned_join(points, right, (F.col("rstart") <= F.col("start")) & (F.col("start") <= F.col("rend")), width)
    best = met.groupBy(F.col("file").alias("bf"), F.col("word_ord").alias("bo")).agg(F.min_by("t_speaker", "t_ord").alias("speaker"))
    return mids.join(best, (F.col("file") == F.col("bf")) & (F.col("word_ord") == F.col("bo")), "left").drop("bf", "bo", "mid")


def label_words(words: DataFrame, turns: DataFrame, last_turn: bool) -> DataFrame:
    """words with the speaker at the midpoint and confidence 1.0 or 0.0; last_turn: words that no turn covers get the last turn's speaker."""
    found = speaker_at_midpoint(words, turns)
    if last_turn:
        last = turns.groupBy(F.col("file").alias("lf")).agg(F.max_by("speaker", "ord").alias("last"))
        found = found.join(last, F.col("file") == F.col("lf"), "left").withColumn("speaker", F.coalesce("speaker", "last")).drop("lf", "last")
    return found.withColumn("confidence", F.when(F.col("speaker").isNotNull(), 1.0).otherwise(0.0))


def sliding_windows(lengths: DataFrame, width: int, hop: int, partial: bool) -> DataFrame:
    """file, win, start, end for every window over [0, total)."""
    if width <= 0 or hop <= 0 or hop > width:
        raise ValueError("width and hop must be positive, and hop at most width")
    last = F.col("total") - (1 if partial else width)
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return lengths.select("file", "total", F.posexplode(starts).alias("win", "start")).select("file", "win", "start", F.least(F.col("start") + width, F.col("total")).alias("end"))


def nearest_gap(a: DataFrame) -> DataFrame:
    """turns with the gap to the turn before in the file (0 where they touch or overlap)."""
    at = Window.partitionBy("file").orderBy("start", "ord")
    return a.withColumn("gap", F.when(F.lag("ord").over(at).isNotNull(), gap(F.lag("start").over(at), F.lag("end").over(at), F.col("start"), F.col("end"))))


def dense_windows(segments: DataFrame, width: float) -> DataFrame:
    """file, ord, win, start, end: windows of ``width`` s every half of it (0.05 s at least) over each segment; a short one stays whole,
    the last window ends with the segment. Starts are sums of steps, as a loop makes them."""
    hop = max(width / 2, 0.05)
    most = F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start") - width) / hop).cast("int") + 1)
    starts = F.when(F.col("end") - F.col("start") <= width, F.array("start")).otherwise(F.aggregate(F.sequence(F.lit(0), most), F.array("start"), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + hop))))
    rows = segments.select("file", "ord", F.col("end").alias("till"), F.posexplode(starts).alias("win", "start"))
    before = F.lag("start").over(Window.partitionBy("file", "ord").orderBy("win"))
    rows = rows.withColumn("done", F.coalesce(before + width >= F.col("till"), F.lit(False))).where("not done")
    return rows.select("file", "ord", "win", "start", F.least(F.col("start") + width, F.col("till")).alias("end"))


def padded_windows(lengths: DataFrame, width: float = 10.0, hop: float = 2.0) -> DataFrame:
    """file, win, start, end: windows from 0 while they begin within the length; each ends a whole width after its start."""
    last = (F.ceil(F.col("length") / hop) - 1).cast("int")
    rows = lengths.where("length > 0").select("file", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    return rows.select("file", "win", (F.col("win") * hop).alias("start"), (F.col("win") * hop + width).alias("end"))


def chunks(lengths: DataFrame, width: int, overlap: int) -> DataFrame:
    """file, chunk, start, end in samples: chunks that overlap, up to the one that reaches the end; a short recording is one chunk, an empty one none."""
    step = max(width - overlap, 1)
    n = F.when(F.lit(width <= 0) | (F.col("length") <= width), 0).otherwise(F.ceil((F.col("length") - width) / step)).cast("int")
    rows = lengths.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0), n)).alias("chunk"))
    end = F.least(F.col("chunk") * step + width, F.col("length")) if width > 0 else F.col("length")
    return rows.select("file", "chunk", (F.col("chunk") * step).cast("long").alias("start"), end.cast("long").alias("end"))


def region_windows(regions: DataFrame, width: int, hop: int) -> DataFrame:
    """file, ord, win, start, end, padding (samples): whole windows of each region; a shorter region is one window with zeros behind it."""
    size = F.col("end") - F.col("start")
    starts = F.when(size >= width, F.sequence(F.col("start"), F.col("end") - width, F.lit(hop).cast("long"))).otherwise(F.array("start"))
    rows = regions.where("end > start").select("file", "ord", F.col("end").alias("till"), F.posexplode(starts).alias("win", "start"))
    end = F.least(F.col("start") + width, F.col("till"))
    return rows.select("file", "ord", "win", "start", end.alias("end"), (F.lit(width) - (end - F.col("start"))).alias("padding"))
