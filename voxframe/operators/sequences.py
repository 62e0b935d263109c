"""Sequence and label operators: hysteresis gates, regions, exclusive timelines, labels, word times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.spans import in_bins

#: Frames of ten minutes: what of a file one task lays down at once.
BIN = 60_000


def hysteresis(frames: DataFrame, onset: float, offset: float) -> DataFrame:
    """frames (file, frame, prob) with active: on at onset, off under offset, else as before. NaN is off."""
    if offset > onset:
        raise ValueError("offset must not be above onset")
    at = Window.partitionBy("file").orderBy("frame")
    prob = F.nanvl(F.col("prob"), F.lit(float("-inf")))
    switch = F.when(prob >= onset, 1).when(prob < offset, 0)
    return frames.withColumn("active", F.coalesce(F.last(switch, ignorenulls=True).over(at), F.lit(0)) == 1)


def regions(frames: DataFrame, min_off: int, min_on: int) -> DataFrame:
    """file, first, last of the active stretches: gaps under min_off frames are bridged, stretches under min_on left out."""
    at = Window.partitionBy("file").orderBy("frame")
    on = frames.where("active")
    marked = on.withColumn("fresh", F.when(F.col("frame") - F.lag("frame").over(at) - 1 < max(min_off, 1), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(at))
    out = marked.groupBy("file", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("run")
    return out.where(F.col("last") - F.col("first") + 1 >= min_on)


def laid_down(spans: list[list[int]], size: int) -> np.ndarray:
    """For each of ``size`` cells the first of the spans (first cell, end) that holds it, or -1. Cells that are taken are skipped."""
    owner, free = [-1] * size, list(range(size + 1))
    for k, (a, b) in enumerate(spans):
        while True:
            at = a
            while free[at] != at:
                free[at] = free[free[at]]
                at = free[at]
            if at >= b:
                break
            owner[at], free[at], a = k, at + 1, at + 1
    return np.array(owner, dtype=np.int64)


def exclusive_timeline(turns: DataFrame) -> DataFrame:
    """file, speaker, a, b (frames): one speaker at a time, that of the longest covering turn in seconds; ties to the smaller speaker.

    Turns are cut into bins of time. In each bin they are laid down in the order of their rank, each on what is free yet, so that the
    work follows the number of turns and not that of the pairs of turns and stretches.
    """
    spans = in_bins(turns.where("end > start").select("file", F.col("sf").alias("a"), F.col("ef").alias("b"), (F.col("start") - F.col("end")).alias("less"), "speaker", "ord"), BIN)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.iloc[np.lexsort((pdf["ord"], pdf["speaker"], pdf["less"]))]
        cuts, at = np.unique(ranked[["a", "b"]].to_numpy(), return_inverse=True)
        owner = laid_down(at.reshape(-1, 2).tolist(), len(cuts) - 1)
        first = np.flatnonzero((owner >= 0) & (owner != np.r_[-1, owner[:-1]]))
        ends = np.flatnonzero((owner >= 0) & (owner != np.r_[owner[1:], -1]))
        speaker = ranked["speaker"].to_numpy()[owner[first]]
        return pd.DataFrame({"file": pdf["file"].iloc[0], "speaker": speaker, "a": cuts[first], "b": cuts[ends + 1]})

    best = spans.groupBy("file", "bin").applyInPandas(run, "file string, speaker long, a long, b long")
    at = Window.partitionBy("file").orderBy("a")
    joins = (F.lag("speaker").over(at) == F.col("speaker")) & (F.lag("b").over(at) == F.col("a"))
    marked = best.withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(at))
    return marked.groupBy("file", "run").agg(F.min("speaker").alias("speaker"), F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def canonical_labels(labels: DataFrame) -> DataFrame:
    """file, ord, label -> also canon: 0, 1, ... by size, largest first, then by first appearance."""
    sizes = labels.groupBy("file", "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    ranked = sizes.select(F.col("file").alias("cf"), F.col("label").alias("cl"), (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "first")) - 1).alias("canon"))
    return labels.join(ranked, (F.col("file") == F.col("cf")) & (F.col("label") == F.col("cl"))).drop("cf", "cl")


def local_global(pairs: DataFrame) -> DataFrame:
    """file, local, global_id, seconds: the summed positive seconds of each pair."""
    return pairs.where("seconds > 0").groupBy("file", "local", "global_id").agg(F.sum("seconds").alias("seconds"))


def majority_map(pairs: DataFrame) -> DataFrame:
    """file, local, global_id, seconds -> the global id of most time for each local one; ties to the smaller id."""
    summed = pairs.groupBy("file", "local", "global_id").agg(F.sum("seconds").alias("seconds")).where("seconds > 0")
    return summed.groupBy("file", "local").agg(F.min(F.struct((-F.col("seconds")).alias("less"), "global_id")).alias("m")).select("file", "local", F.col("m.global_id").alias("global_id"))


def interpolate_times(words: DataFrame) -> DataFrame:
    """words with bad times (not finite, or no length) taken from the valid neighbours' end and start."""
    at = Window.partitionBy("file").orderBy("word_ord")
    bad = ~F.coalesce((F.col("end") > F.col("start")) & (F.abs("start") < float("inf")) & (F.abs("end") < float("inf")), F.lit(False))
    before = F.last(F.when(~bad, F.col("end")), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    # In falling order: a frame that ends with the partition would be read anew for each row.
    down = Window.partitionBy("file").orderBy(F.desc("word_ord"))
    after = F.last(F.when(~bad, F.col("start")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    marked = words.withColumn("interpolated", bad).withColumn("p", before).withColumn("q", after)
    start = F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("q").isNotNull(), F.greatest(F.col("q") - 0.001, F.lit(0.0))).otherwise(0.0)
    end = F.when(F.col("q").isNotNull(), F.col("q")).when(F.col("p").isNotNull(), F.col("p") + 0.001).otherwise(0.001)
    marked = marked.withColumn("s2", start).withColumn("e2", end)
    s3 = F.when(F.col("e2") > F.col("s2"), F.col("s2")).otherwise(F.greatest("s2", F.lit(0.0)))
    e3 = F.when(F.col("e2") > F.col("s2"), F.col("e2")).otherwise(F.greatest("s2", F.lit(0.0)) + 0.001)
    done = marked.withColumn("start", F.when(F.col("interpolated"), s3).otherwise(F.col("start"))).withColumn("end", F.when(F.col("interpolated"), e3).otherwise(F.col("end")))
    return done.drop("p", "q", "s2", "e2")


def label_flip_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, rate: share of places with different labels (file, place, label)."""
    other = b.select(F.col("file").alias("bf"), F.col("place").alias("bp"), F.col("label").alias("bl"))
    both = a.join(other, (F.col("file") == F.col("bf")) & (F.col("place") == F.col("bp")))
    return both.groupBy("file").agg(F.avg((F.col("label") != F.col("bl")).cast("double")).alias("rate"))
