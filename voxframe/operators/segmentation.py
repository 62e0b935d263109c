"""From frame probabilities to segments and turns: speech detection, powerset classes, overlap-add, binarizing, reconstruction.

Frames are rows (file, frame, ...) or (file, win, start, frame, probs): a window's frames in order, with seven class probabilities.
Everything but the chain of window permutations is declared with window functions, partitioned by file and track.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.vectors import POWERSET, class_of_speakers, energy, frame_class, softmax, speaker_probs, speakers_of_class
from voxframe.operators.scoring import best_assignment


def energy_probs(blocks: DataFrame, frame_size: int, threshold_db: float) -> DataFrame:
    """file, frame, prob from samples (file, block, samples): each block a whole number of frames, else an error."""
    if frame_size <= 0:
        raise ValueError("a frame has at least one sample")
    size = F.size("samples")
    whole = F.when(size % frame_size == 0, F.floor(size / frame_size)).otherwise(F.raise_error(F.lit("a block is not a whole number of frames")).cast("long"))
    rows = blocks.select("file", "block", "samples", whole.alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where("n > 0").select("file", "before", "samples", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return rows.select("file", (F.col("before") + F.col("i")).alias("frame"), energy(F.slice("samples", (F.col("i") * frame_size + 1).cast("int"), F.lit(frame_size)), threshold_db).alias("prob"))


def frame_geometry(frame_size: int, rate: int, min_silence_ms: float, min_speech_s: float) -> tuple[int, int]:
    """(min_off, min_on) in whole frames, rounded up."""
    if frame_size <= 0 or rate <= 0:
        raise ValueError("frame size and rate are positive")
    ms = np.float32(frame_size) / np.float32(rate) * np.float32(1000)
    return int(np.ceil(np.float32(min_silence_ms) / ms)), int(np.ceil(np.float32(min_speech_s) * np.float32(1000) / ms))


def runs(frames: DataFrame, min_off: int, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Rows with run: numbers of the stretches of rows whose gaps in ``frame`` are under max(min_off, 1)."""
    at = Window.partitionBy(*keys).orderBy("frame")
    fresh = F.when(F.col("frame") - F.lag("frame").over(at) - 1 < max(min_off, 1), 0).otherwise(1)
    return frames.withColumn("run", F.sum(fresh).over(at))


def speech_regions(frames: DataFrame, threshold: float, min_off: int, min_on: int, keep_tail: bool = True) -> DataFrame:
    """file, first, end (exclusive) of speech in frames (file, frame, prob).

    A region opens at a frame of at least the threshold, and closes after ``min_off`` silent frames, which belong to it if the tail is
    kept, up to the last frame of the file; under ``min_on`` frames it is left out. A NaN is speech inside a region and silence outside.
    """
    n = frames.groupBy(F.col("file").alias("nf")).agg((F.max("frame") + 1).alias("n"))
    sure, maybe = F.coalesce(~F.isnan("prob") & (F.col("prob") >= threshold), F.lit(False)), F.coalesce(F.isnan("prob"), F.lit(False))
    held = runs(frames.withColumn("sure", sure).where(sure | maybe), min_off)
    found = held.groupBy("file", "run").agg(F.min(F.when(F.col("sure"), F.col("frame"))).alias("first"), F.max("frame").alias("last")).where("first is not null")
    found = found.join(n, F.col("file") == F.col("nf"))
    end = F.least(F.col("last") + max(min_off, 1) + 1, F.col("n")) if keep_tail else F.col("last") + 1
    return found.select("file", "first", end.alias("end")).where(F.col("end") - F.col("first") >= min_on)


def segment_speech(blocks: DataFrame, frame_size: int, rate: int, threshold_db: float, threshold: float, min_silence_ms: float, min_speech_s: float) -> DataFrame:
    """file, first, end in samples: regions of speech by energy; a partial last frame is left out."""
    off, on = frame_geometry(frame_size, rate, min_silence_ms, min_speech_s)
    whole = blocks.withColumn("samples", F.slice("samples", F.lit(1), (F.floor(F.size("samples") / frame_size) * frame_size).cast("int")))
    found = speech_regions(energy_probs(whole, frame_size, threshold_db), threshold, off, on)
    return found.select("file", (F.col("first") * frame_size).alias("first"), (F.col("end") * frame_size).alias("end"))


def decode_windows(frames: DataFrame) -> DataFrame:
    """frames (.., logits) with probs, cls and p."""
    rows = frames.withColumn("probs", softmax(F.col("logits")))
    return rows.withColumn("_c", frame_class(F.col("probs"))).select(*rows.columns, F.col("_c.cls").alias("cls"), F.col("_c.p").alias("p"))


def remap(probs: Column, perm: Column) -> Column:
    """Class probabilities after the local speakers took the numbers of perm."""
    target = F.array(*[F.coalesce(class_of_speakers(F.transform(speakers_of_class(F.lit(c)), lambda s: F.get(perm, s))), F.lit(0)) for c in range(len(POWERSET))])
    both = F.arrays_zip(target.alias("t"), probs.alias("p"))
    return F.transform(F.array(*[F.lit(k) for k in range(len(POWERSET))]), lambda k: F.aggregate(both, F.lit(0.0), lambda s, x: s + F.when(x["t"] == k, x["p"]).otherwise(0.0)))


def window_permutations(frames: DataFrame, stride: float) -> DataFrame:
    """file, win, perm: for each window which global number each of its three local speakers takes.

    A chain: each window is matched to the one before, as that was numbered, by the overlap of their speakers (intersection over
    union), one to one; with under two speakers active on either side of the overlap, it keeps its numbers.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for win, rows in pdf.sort_values(["win", "frame"], kind="stable").groupby("win"):
            at, masks = round(float(rows["start"].iloc[0]) / stride), np.zeros((3, len(rows)), dtype=bool)
            for i, c in enumerate(rows["cls"]):
                masks[list(POWERSET[int(c)]), i] = True
            perm = [0, 1, 2]
            if before is not None:
                b_at, b_masks = before
                lo, hi = max(at, b_at), min(at + masks.shape[1], b_at + b_masks.shape[1])
                a, b = (b_masks[:, lo - b_at : hi - b_at], masks[:, lo - at : hi - at]) if hi > lo else (b_masks[:, :0], masks[:, :0])
                left, right = np.flatnonzero(a.any(axis=1)), np.flatnonzero(b.any(axis=1))
                if len(left) >= 2 and len(right) >= 2:
                    both = (a[left][:, None, :] & b[right][None]).sum(axis=2)
                    either = (a[left][:, None, :] | b[right][None]).sum(axis=2)
                    for i, j in enumerate(best_assignment(both / np.maximum(either, 1))):
                        if j >= 0:
                            perm[int(right[j])] = int(left[i])
            own = np.zeros_like(masks)
            for s, g in enumerate(perm):
                own[g] |= masks[s]
            before = (at, own)
            out.append((pdf["file"].iloc[0], int(win), perm))
        return pd.DataFrame(out, columns=["file", "win", "perm"])

    return frames.select("file", "win", "start", "frame", "cls").groupBy("file").applyInPandas(run, "file string, win long, perm array<int>")


def overlap_add(frames: DataFrame, stride: float, perms: DataFrame | None = None) -> DataFrame:
    """file, frame, probs: the mean class probabilities of all windows' frames whose centre falls on the global frame."""
    first = frames.groupBy(F.col("file").alias("ff")).agg(F.min("start").alias("first"))
    rows = frames.join(first, F.col("file") == F.col("ff"))
    if perms is not None:
        p = perms.select(F.col("file").alias("pf"), F.col("win").alias("pw"), "perm")
        rows = rows.join(p, (F.col("file") == F.col("pf")) & (F.col("win") == F.col("pw"))).withColumn("probs", remap(F.col("probs"), F.col("perm")))
    at = F.floor((F.col("start") + (F.col("frame") + 0.5) * stride - F.col("first")) / stride)
    rows = rows.select("file", at.alias("g"), F.posexplode("probs").alias("c", "v")).where("g >= 0")
    mean = rows.groupBy("file", "g", "c").agg(F.avg("v").alias("v"))
    return mean.groupBy("file", F.col("g").alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("probs"))


def argmax_classes(averages: DataFrame) -> DataFrame:
    """file, frame, cls, p of every covered frame."""
    return averages.select("file", "frame", frame_class(F.col("probs")).alias("c")).select("file", "frame", "c.cls", "c.p")


def binarize(averages: DataFrame, onset: float, offset: float, min_off: int, min_on: int) -> DataFrame:
    """file, frame, cls, p: classes from each speaker's own gate and regions.

    A speaker's probability is that of all classes with it; it is on from onset to under offset, gaps under min_off frames are bridged
    and stretches under min_on left out; uncovered frames end regions. Of three speakers the two most likely stay.
    """
    if offset > onset:
        raise ValueError("offset must not be above onset")
    by_file = Window.partitionBy("file").orderBy("frame")
    rows = averages.withColumn("island", F.col("frame") - F.row_number().over(by_file)).withColumn("sp", speaker_probs(F.col("probs")))
    each = rows.select("file", "frame", "island", F.posexplode("sp").alias("s", "prob"))
    track = Window.partitionBy("file", "s", "island").orderBy("frame")
    switch = F.when(F.col("prob") >= onset, 1).when(F.coalesce(F.col("prob") < offset, F.lit(True)), 0)
    each = each.withColumn("on", F.coalesce(F.last(switch, ignorenulls=True).over(track), F.lit(0)) == 1)
    on = runs(each.where("on").select("file", "s", "island", "frame"), min_off, ("file", "s", "island")).groupBy("file", "s", "island", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).where(F.col("b") - F.col("a") + 1 >= min_on)
    marks = on.select("file", "s", F.explode(F.sequence("a", "b")).alias("frame")).groupBy(F.col("file").alias("mf"), F.col("frame").alias("mg")).agg(F.sort_array(F.collect_list(F.col("s").cast("int"))).alias("on"))
    out = rows.join(marks, (F.col("file") == F.col("mf")) & (F.col("frame") == F.col("mg")), "left").withColumn("on", F.coalesce("on", F.array().cast("array<int>")))
    ranked = F.transform(F.slice(F.array_sort(F.transform("on", lambda s: F.struct((-F.get("sp", s)).alias("less"), s.alias("s")))), F.lit(1), F.lit(2)), lambda x: x["s"])
    out = out.withColumn("on", F.sort_array(ranked))
    mean = F.aggregate("on", F.lit(0.0), lambda t, s: t + F.get("sp", s)) / F.greatest(F.lit(1), F.size("on"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.size("on") == 0, F.get("probs", F.lit(0))).otherwise(mean)))
    return out.select("file", "frame", class_of_speakers(F.col("on")).alias("cls"), p.alias("p"))


def segments_of_frames(classes: DataFrame, start: float, stride: float, min_seconds: float) -> DataFrame:
    """file, local, is_overlap, start, end, confidence: stretches of frames with one speaker, split where overlap begins or ends."""
    each = classes.select("file", "frame", "p", (F.size(speakers_of_class(F.col("cls"))) > 1).alias("is_overlap"), F.explode(speakers_of_class(F.col("cls"))).alias("local"))
    marked = runs(each, 1, ("file", "local", "is_overlap"))
    out = marked.groupBy("file", "local", "is_overlap", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.avg("p").alias("m"))
    at = lambda c: F.lit(start) + c * F.lit(stride)
    out = out.select("file", "local", "is_overlap", at(F.col("a")).alias("start"), at(F.col("b") + 1).alias("end"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "m")).alias("confidence"))
    return out.where(F.col("end") - F.col("start") >= min_seconds)


def stitch(frames: DataFrame, stride: float, min_seconds: float, gate: tuple[float, float, int, int] | None = None) -> DataFrame:
    """Segments of overlapping windows (file, win, start, frame, logits): decoded, numbered alike, averaged, classed, run-length encoded."""
    decoded = decode_windows(frames)
    averages = overlap_add(decoded, stride, window_permutations(decoded, stride))
    classes = binarize(averages, *gate) if gate else argmax_classes(averages)
    return segments_of_frames(classes, 0.0, stride, min_seconds)


def window_units(decoded: DataFrame, stride: float, least: float = 0.2, clean: float = 2.0) -> DataFrame:
    """file, win, local, seconds, is_clean: a window's speakers of at least 0.2 s, by their frames alone where those make 2 s."""
    each = decoded.select("file", "win", F.size(speakers_of_class(F.col("cls"))).alias("n"), F.explode(speakers_of_class(F.col("cls"))).alias("local"))
    found = each.groupBy("file", "win", "local").agg((F.count(F.lit(1)) * F.lit(stride)).alias("raw"), (F.count_if(F.col("n") == 1) * F.lit(stride)).alias("alone"))
    held = found.where(F.col("raw") >= least)
    return held.select("file", "win", "local", F.when(F.col("alone") >= clean, F.col("alone")).otherwise(F.col("raw")).alias("seconds"), (F.col("alone") >= clean).alias("is_clean"))


def reconstruct(decoded: DataFrame, labels: DataFrame, stride: float, lengths: DataFrame, min_seconds: float, max_gap: float) -> DataFrame:
    """file, speaker, start, end from windows' classes and their units' labels (file, win, local, label): at each frame the number of speakers
    is the rounded mean over the windows, and those speak whose units are on most often (ties to the smaller label)."""
    u = labels.select(F.col("file").alias("uf"), F.col("win").alias("uw"), F.col("local").alias("ul"), "label")
    n = lengths.select(F.col("file").alias("lf"), "length", F.greatest(F.lit(1), F.ceil(F.col("length") / stride)).alias("n"))
    g = F.least(F.floor((F.col("start") + (F.col("frame") + 0.5) * stride) / stride), F.col("n") - 1)
    rows = decoded.join(n, F.col("file") == F.col("lf")).select("file", "win", "cls", g.alias("g"))
    count = rows.groupBy(F.col("file").alias("cf"), F.col("g").alias("cg")).agg(F.avg(F.size(speakers_of_class(F.col("cls")))).alias("mean"))
    on = rows.select("file", "win", "g", F.explode(speakers_of_class(F.col("cls"))).alias("local"))
    on = on.join(u, (F.col("file") == F.col("uf")) & (F.col("win") == F.col("uw")) & (F.col("local") == F.col("ul"))).groupBy("file", "g", "label").agg(F.count(F.lit(1)).alias("hits"))
    rank = F.row_number().over(Window.partitionBy("file", "g").orderBy(F.desc("hits"), "label"))
    kept = on.join(count, (F.col("file") == F.col("cf")) & (F.col("g") == F.col("cg"))).withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("mean") + 0.5))
    tracks = runs(kept.select("file", "label", F.col("g").alias("frame")), 1, ("file", "label")).groupBy("file", "label", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    turns = tracks.join(n, F.col("file") == F.col("lf")).select("file", F.col("label").alias("speaker"), (F.col("a") * F.lit(stride)).alias("start"), F.least((F.col("b") + 1) * F.lit(stride), F.col("length")).alias("end"))
    turns = turns.where(F.col("end") - F.col("start") >= min_seconds)
    if max_gap <= 0:
        return turns
    from voxframe.operators.intervals import merge_by_speaker

    return merge_by_speaker(turns, max_gap)


def resegment(primary: DataFrame, overlaps: DataFrame, centroids: DataFrame, threshold: float, min_seconds: float = 0.1) -> DataFrame:
    """file, start, end, speaker: the primary turns, and in overlaps of at least 0.1 s the second speaker.

    overlaps: file, r_id, start, end, speaker (the primary one), second (a trusted pair's other, or null), embedding. Without a trusted
    second the nearest centroid (file, label, centroid) of another speaker is taken, if its cosine is over the threshold; a file with
    under two centroids has none.
    """
    from voxframe.functions.turns import cosine

    held = overlaps.where(F.col("end") - F.col("start") >= min_seconds)
    c = centroids.groupBy(F.col("file").alias("cf")).agg(F.collect_list(F.struct("label", "centroid")).alias("c")).where(F.size("c") >= 2)
    scored = F.transform(F.filter("c", lambda x: x["label"] != F.col("speaker")), lambda x: F.struct(cosine(F.col("embedding"), x["centroid"]).alias("s"), (-x["label"]).alias("less")))
    near = held.join(c, F.col("file") == F.col("cf"), "left").withColumn("m", F.array_max(scored))
    other = F.coalesce("second", F.when(F.col("m.s") > threshold, -F.col("m.less")))
    both = near.select("file", "start", "end", F.explode(F.array("speaker", other)).alias("speaker")).where("speaker is not null")
    return primary.select("file", "start", "end", "speaker").unionAll(both)


def filter_bank(samples: np.ndarray, rate: int = 16000, mels: int = 80, width: int = 512) -> np.ndarray:
    """Logarithms of mel energies of 25 ms frames every 10 ms; empty for samples shorter than a frame."""
    size, hop = round(0.025 * rate), round(0.010 * rate)
    if len(samples) < size:
        return np.zeros((0, mels), dtype=np.float32)
    x = np.r_[samples[:1], samples[1:] - 0.97 * samples[:-1]]
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, width)) ** 2
    return np.log(np.maximum(power @ mel_filters(rate, mels, width).T, 1e-10)).astype(np.float32)


def mel_filters(rate: int, mels: int, width: int, low: float = 20.0) -> np.ndarray:
    """Triangles between equal steps of the mel scale."""
    mel = lambda hz: 2595.0 * np.log10(1 + hz / 700.0)
    edges = 700.0 * (10 ** (np.linspace(mel(low), mel(rate / 2), mels + 2) / 2595.0) - 1)
    hz = np.arange(width // 2 + 1) * rate / width
    up = (hz - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mean_normalize(features: DataFrame) -> DataFrame:
    """file, frame, values (an array of bins) less the mean of each bin over the file."""
    bins = features.select("file", "frame", F.posexplode("values").alias("b", "v"))
    less = F.col("v") - F.avg("v").over(Window.partitionBy("file", "b"))
    return bins.withColumn("v", less).groupBy("file", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("values"))


def mask_samples(samples: np.ndarray, mask: np.ndarray, rate: int, seconds: float) -> np.ndarray:
    """Samples with zeros where the frame of a sample is off; the frames share the window's seconds."""
    if not len(mask) or not len(samples):
        return samples.copy()
    frame = np.minimum(np.floor(np.arange(len(samples)) / rate / (seconds / len(mask))).astype(int), len(mask) - 1)
    return np.where(mask[frame], samples, 0).astype(samples.dtype)


def crop_masked(samples: np.ndarray, mask: np.ndarray, rate: int, seconds: float) -> np.ndarray:
    """The samples from the first to the last frame that is on, with zeros where frames between are off; empty without any."""
    on = np.flatnonzero(mask)
    if not len(on) or not len(samples):
        return samples[:0]
    step = seconds / len(mask)
    a, b = int(np.floor(on[0] * step * rate)), min(int(np.ceil((on[-1] + 1) * step * rate)), len(samples))
    return mask_samples(samples[a:b], mask[on[0] : on[-1] + 1], rate, (b - a) / rate) if b > a else samples[:0]
