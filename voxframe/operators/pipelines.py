"""Whole diarizations: operators put together, with hooks for what a model does.

What several steps need (segments, vectors, labels) is persisted, on disk where memory ends, so that no hook runs twice.

Hooks are plain functions: embed(samples, rate) -> vector, and a clusterer f(vectors, start, end) -> labels. Parts of audio are rows
(file, block, samples) of whole frames.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators import attribution, clustering, intervals, scoring, segmentation, vectors

Embed = Callable[[np.ndarray, int], np.ndarray]


def _by_start():
    return Window.partitionBy("file").orderBy("start", "end")


def embed_spans(blocks: DataFrame, spans: DataFrame, rate: int, width: int, embed: Embed) -> DataFrame:
    """file, ord, start, end, embedding of spans of samples (file, ord, start, end); short ones get zeros behind them.

    A file's samples come together in one task, an hour at most.
    """

    def run(key: tuple, audio: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.zeros(0, np.float32), *[np.asarray(s, dtype=np.float32) for s in audio.sort_values("block", kind="stable")["samples"]]])
        rows = []
        for o, a, b in wanted.sort_values("ord", kind="stable")[["ord", "start", "end"]].itertuples(index=False):
            part = x[int(a) : int(b)]
            rows.append((key[0], int(o), a / rate, b / rate, [float(v) for v in embed(np.pad(part, (0, max(0, width - len(part)))), rate)]))
        return pd.DataFrame(rows, columns=["file", "ord", "start", "end", "embedding"])

    wanted = spans.select(F.col("file").alias("span_file"), "ord", "start", "end")
    return blocks.groupBy("file").cogroup(wanted.groupBy("span_file")).applyInPandas(run, "file string, ord long, start double, end double, embedding array<double>")


def labelled_turns(units: DataFrame, clusterer: Callable, max_gap: float, min_speech: float) -> DataFrame:
    """file, speaker, start, end, confidence from embedded units: clustered, scored, merged in order, short ones left out."""
    units = units.persist()
    labels = clustering.cluster_files(units, clusterer).select(F.col("file").alias("lf"), F.col("ord").alias("lo"), "label").persist()
    rows = units.join(labels, (F.col("file") == F.col("lf")) & (F.col("ord") == F.col("lo"))).drop("lf", "lo")
    scored = vectors.segment_confidence(rows).select("file", "ord", F.col("label").alias("speaker"), "start", "end", "confidence")
    return attribution.filter_segments(intervals.merge_adjacent(scored, max_gap), min_speech).select("file", "speaker", "start", "end", "confidence")


def offline(blocks: DataFrame, embed: Embed, clusterer: Callable, frame: int = 512, rate: int = 16000, threshold_db: float = -40.0, threshold: float = 0.5, width_s: float = 1.5, hop_s: float = 0.75, min_silence_ms: float = 300.0, min_speech: float = 0.25, max_gap: float = 0.5) -> DataFrame:
    """Speech by energy, windows over it, vectors, clusters, turns."""
    regions = segmentation.segment_speech(blocks, frame, rate, threshold_db, threshold, min_silence_ms, min_speech)
    regions = regions.select("file", F.col("first").alias("ord"), F.col("first").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    width = round(width_s * rate)
    windows = intervals.region_windows(regions, width, round(hop_s * rate)).select("file", F.col("start").alias("ord"), "start", "end")
    return labelled_turns(embed_spans(blocks, windows, rate, width, embed), clusterer, max_gap, min_speech)


def segmented(frames: DataFrame, blocks: DataFrame, embed: Embed, clusterer: Callable, stride: float, rate: int = 16000, min_seconds: float = 0.2, threshold: float = 0.5, max_gap: float = 0.5) -> DataFrame:
    """Segments of windows' class probabilities, vectors of those with one speaker, clusters, and the second speaker of overlaps.

    A local speaker is taken for the global one with which it shares most time, one to one; where an overlap's locals are both known, they
    are its pair, else the nearest turn and the nearest other centroid are.
    """
    found = segmentation.stitch(frames, stride, min_seconds).persist()
    alone = found.where(~F.col("is_overlap")).withColumn("ord", F.row_number().over(_by_start()))
    spans = alone.select("file", "ord", F.floor(F.col("start") * rate).alias("start"), F.ceil(F.col("end") * rate).alias("end"))
    units = embed_spans(blocks, spans, rate, round(min_seconds * rate), embed).persist()
    labels = clustering.cluster_files(units, clusterer).select(F.col("file").alias("lf"), F.col("ord").alias("lo"), "label").persist()
    known = alone.join(labels, (F.col("file") == F.col("lf")) & (F.col("ord") == F.col("lo"))).drop("lf", "lo")
    turns = known.select("file", "ord", F.col("label").alias("speaker"), "start", "end")
    pairs = known.select("file", F.col("local").cast("long").alias("local"), F.col("label").alias("global_id"), (F.col("end") - F.col("start")).alias("seconds"))
    of = clustering.map_files(pairs)
    both = attribution.overlap_pairs(found.where("is_overlap").withColumn("ord", F.row_number().over(_by_start())))
    lo, hi = (of.select(F.col("file").alias(f"f{x}"), F.col("local").alias(f"l{x}"), F.col("global_id").alias(f"g{x}")) for x in "ab")
    both = both.join(lo, (F.col("file") == F.col("fa")) & (F.col("lo") == F.col("la")), "left").join(hi, (F.col("file") == F.col("fb")) & (F.col("hi") == F.col("lb")), "left")
    both = both.select("file", F.row_number().over(_by_start()).alias("r_id"), "start", "end", "ga", "gb")
    near = attribution.primary_turn(both, turns).withColumnRenamed("speaker", "near")
    over = near.select("file", F.col("r_id").cast("long").alias("ord"), "start", "end", F.coalesce("ga", "gb", "near").alias("speaker"), F.when(F.col("ga").isNotNull() & (F.col("gb") != F.col("ga")), F.col("gb")).alias("second"))
    over = over.persist()
    mixed = embed_spans(blocks, over.select("file", "ord", F.floor(F.col("start") * rate).alias("start"), F.ceil(F.col("end") * rate).alias("end")), rate, round(min_seconds * rate), embed)
    mixed = mixed.select(F.col("file").alias("mf"), F.col("ord").alias("mo"), "embedding")
    over = over.join(mixed, (F.col("file") == F.col("mf")) & (F.col("ord") == F.col("mo"))).drop("mf", "mo")
    named = units.join(labels, (F.col("file") == F.col("lf")) & (F.col("ord") == F.col("lo")))
    out = segmentation.resegment(turns, over, vectors.centroids(named, "file", "label"), threshold)
    return intervals.merge_by_speaker(out, max_gap)


def reconstructed(frames: DataFrame, blocks: DataFrame, embed: Embed, clusterer: Callable, stride: float, rate: int = 16000, min_speech: float = 0.25, max_gap: float = 0.5) -> DataFrame:
    """A vector for each window's speakers, clusters, repaired within windows, and turns from the windows' frames put together."""
    decoded = segmentation.decode_windows(frames).persist()
    units = segmentation.window_units(decoded, stride)
    at = decoded.groupBy(F.col("file").alias("wf"), F.col("win").alias("ww")).agg(F.min("start").alias("start"), (F.min("start") + F.count(F.lit(1)) * stride).alias("end"))
    spans = units.join(at, (F.col("file") == F.col("wf")) & (F.col("win") == F.col("ww")))
    spans = spans.select("file", (F.col("win") * 3 + F.col("local")).alias("ord"), F.floor(F.col("start") * rate).alias("start"), F.ceil(F.col("end") * rate).alias("end"))
    embedded = embed_spans(blocks, spans, rate, 1, embed)

    def label(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return clustering.repair_windows(start, x, np.asarray(clusterer(x, start, end)))

    labels = clustering.cluster_files(embedded, label).select("file", F.expr("ord div 3").alias("win"), (F.col("ord") % 3).cast("int").alias("local"), "label")
    lengths = at.groupBy(F.col("wf").alias("file")).agg(F.max("end").alias("length"))
    return segmentation.reconstruct(decoded, labels, stride, lengths, min_speech, max_gap)


def scored(turns: DataFrame, reference: DataFrame, times: DataFrame, collar: float = 0.25) -> DataFrame:
    """One row for a run: the report over its files' errors."""
    from voxframe.functions.turns import end_frame, first_frame

    framed = [t.withColumn("sf", first_frame(F.col("start"))).withColumn("ef", end_frame(F.col("end"))) for t in (reference, turns)]
    return scoring.run_report(scoring.der(*framed, collar), times)
