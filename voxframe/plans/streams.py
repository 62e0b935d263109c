"""Registered queries of streaming (their batch twins) and of whole diarizations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxframe.operators import clustering, pipelines
from voxframe.plans.base import in_parts, query
from voxframe.plans.frames import STRIDE, logits
from voxframe.plans.voices import emb, made_plda
from voxframe.streaming import jobs
from voxframe.streaming.presets import PRESETS, SpeechParams, StreamParams
from voxframe.streaming.state import Diarizer

RATE = 8000


def tones(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A stand-in for a voice model: the energy in eight bands."""
    bands = np.array_split(np.abs(np.fft.rfft(x)) ** 2, 8)
    return np.sqrt(np.array([b.sum() for b in bands]) + 1e-12).astype(np.float32)


def loud(frame: np.ndarray) -> float:
    return float(min(1.0, np.sqrt((frame.astype(np.float64) ** 2).sum()) / 4))


def blocks(spark, d):
    """file, block, seq, samples: a tenth of a second for each embedding, a tone by its label, silent for every sixth."""
    def run(batches):
        t = np.arange(800) / RATE
        tone = {(loudness, k): (loudness * np.sin(2 * np.pi * (300 + 800 * k) * t)).astype(np.float32) for loudness in (0, 0.5) for k in range(4)}
        for b in in_parts(batches):
            yield b[["file", "block", "seq"]].assign(samples=[tone[0 if i % 6 == 5 else 0.5, k] for i, k in zip(b["block"], b["label"])])

    e = emb(spark, d).select("file", (F.col("ord") % 50).alias("block"), (F.col("ord") % 50).alias("seq"), F.expr("(ord div 10) % 4").alias("label"))
    return e.mapInPandas(run, "file string, block long, seq long, samples array<float>")


def diarizer() -> Diarizer:
    return Diarizer(StreamParams(0.4, 0.2, 0.0, 8, 2, 0.05), SpeechParams(160, RATE, 0.5, 60.0, 0.1), loud, tones)


@query("t1_presets", "SELECT * FROM (VALUES ('accurate', 2.282::DOUBLE), ('balanced', 1.532::DOUBLE), ('realtime', 1.032::DOUBLE)) AS t(preset, latency)")
def t1(spark, d):
    return spark.createDataFrame([(n, round(p.latency(16000, 512), 6)) for n, p in PRESETS.items()], "preset string, latency double")


@query("t2_stream_turns")
def t2(spark, d):
    return jobs.batch_turns(blocks(spark, d), diarizer)


@query("t3_flushed_turns")
def t3(spark, d):
    b = blocks(spark, d)
    last = b.groupBy("file").agg((F.max("seq") + 1).alias("seq")).select("file", "seq", F.lit(None).cast("array<float>").alias("samples"))
    return jobs.batch_turns(b.select("file", "seq", "samples").unionAll(last), diarizer)


@query("t4_speaker_cache")
def t4(spark, d):
    return jobs.assign_in_order(emb(spark, d), 8, 0.3, 3, 0.05)


@query("t5_keep_current")
def t5(spark, d):
    return jobs.assign_in_order(emb(spark, d), 16, 0.2, 2, 0.5)


@query("l1_offline")
def l1(spark, d):
    return pipelines.offline(blocks(spark, d), tones, clustering.clusterer("ahc", 0.8), 160, RATE, 10.0, 0.5, 0.4, 0.2, 60.0, 0.1, 0.3)


@query("l2_with_clusterer")
def l2(spark, d):
    return pipelines.offline(blocks(spark, d), tones, clustering.clusterer("nmesc", most=6), 160, RATE, 10.0, 0.5, 0.4, 0.2, 60.0, 0.1, 0.3)


def padded(spark, d):
    return blocks(spark, d).unionAll(blocks(spark, d).withColumn("block", F.col("block") + 50))


@query("l3_segmented")
def l3(spark, d):
    return pipelines.segmented(logits(spark, d), padded(spark, d), tones, clustering.clusterer("ahc", 0.8), STRIDE, RATE)


@query("l4_reconstructed")
def l4(spark, d):
    return pipelines.reconstructed(logits(spark, d), padded(spark, d), tones, clustering.clusterer("vbx", plda=made_plda(8, 4), windowed=True, reconstruct=True), STRIDE, RATE)


@query("l7_scored_run")
def l7(spark, d):
    turns = pipelines.offline(blocks(spark, d), tones, clustering.clusterer("ahc", 0.8), 160, RATE, 10.0, 0.5, 0.4, 0.2, 60.0, 0.1, 0.3)
    ref = emb(spark, d).where("ord % 6 <> 5").select("file", "ord", F.expr("(ord div 10) % 4").alias("speaker"), (F.col("ord") % 50 / 10.0).alias("start"), ((F.col("ord") % 50 + 1) / 10.0).alias("end"))
    times = ref.groupBy("file").agg(F.lit(5.0).alias("audio_s"), F.lit(0.5).alias("runtime_s"))
    return pipelines.scored(turns.withColumn("ord", F.lit(0).cast("long")), ref, times)


