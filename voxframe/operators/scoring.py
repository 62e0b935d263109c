"""Scoring operators: speaker errors in frames, assignment, word errors, equal error rate, aggregates.

Turns have file, ord, speaker, start, end and the frames sf, ef of ``voxframe.functions.turns``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.turns import FRAME_S, MOST_FRAMES
from voxframe.operators.spans import cells, first_centre, meeting, union_of

#: Seconds: nearer midpoints are compared by their distances in double precision, as these may be equal.
CLOSE = 1e-6


def spans_of(turns: DataFrame) -> DataFrame:
    """file, speaker, a, b: when each speaker speaks, overlaps of a speaker with itself counted once."""
    return union_of(turns.select("file", "speaker", F.col("sf").alias("a"), F.col("ef").alias("b")), "speaker")


def valid_files(ref: DataFrame, hyp: DataFrame, collar: float) -> DataFrame:
    """vf, frames: the files that can be scored, with their number of frames: those with a reference and finite ends."""
    ends = ref.select("file", "end", F.lit(1).alias("r")).unionAll(hyp.select("file", "end", F.lit(0).alias("r")))
    # A NaN end is passed over, an infinite one makes the file invalid; no end at all counts as 0.
    most = F.coalesce(F.max(F.when(~F.isnan("end"), F.col("end"))), F.lit(0.0))
    found = ends.groupBy(F.col("file").alias("vf")).agg(F.sum("r").alias("refs"), F.greatest(F.lit(0.0), most).alias("most"))
    usable = (F.col("refs") > 0) & (F.col("most") < float("inf")) & F.lit(bool(np.isfinite(collar)) and collar >= 0)
    return found.where(usable).select("vf", F.least(F.ceil(F.least("most", F.lit(1e9)) / F.lit(FRAME_S)) + 1, F.lit(MOST_FRAMES)).cast("long").alias("frames"))


def collar_spans(ref: DataFrame, collar: float) -> DataFrame:
    """file, a, b: the frames around the reference's boundaries that are not scored."""
    edge = F.explode(F.array("start", "end"))
    first = F.floor(F.greatest(F.col("x") - collar, F.lit(0.0)) / F.lit(FRAME_S))
    return ref.select("file", edge.alias("x")).select("file", first.cast("long").alias("a"), F.ceil((F.col("x") + collar) / F.lit(FRAME_S)).cast("long").alias("b"))


def region_spans(uem: DataFrame) -> DataFrame:
    """file, a, b: the frames whose centre lies in a scored region."""
    return uem.select("file", first_centre(F.col("start")).alias("a"), first_centre(F.col("end")).alias("b"))


def counted_cells(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, uem: DataFrame | None = None) -> DataFrame:
    """file, a, b, nr, nh of all scored stretches: how many speakers the reference and the hypothesis have there."""
    layers = {"nr": spans_of(ref), "nh": spans_of(hyp)}
    if collar > 0:
        layers["masked"] = collar_spans(ref, collar)
    if uem is not None:
        layers["scored"] = region_spans(uem)
    found = cells({n: s.select("file", "a", "b") for n, s in layers.items()})
    if collar > 0:
        found = found.where("masked = 0")
    return (found.where("scored > 0") if uem is not None else found).select("file", "a", "b", "nr", "nh")


def region_of(region: str) -> Column:
    if region not in ("all", "single", "overlap"):
        raise ValueError("region must be all, single or overlap")
    return {"all": F.lit(True), "single": F.col("nr") < 2, "overlap": F.col("nr") >= 2}[region]


def sums(found: DataFrame) -> DataFrame:
    """file, ref_frames, miss, fa, both from counted cells."""
    w = F.col("b") - F.col("a")
    return found.groupBy("file").agg(
        F.sum(w * F.col("nr")).alias("ref_frames"), F.sum(w * F.greatest(F.lit(0), F.col("nr") - F.col("nh"))).alias("miss"),
        F.sum(w * F.greatest(F.lit(0), F.col("nh") - F.col("nr"))).alias("fa"), F.sum(w * F.least("nr", "nh")).alias("both"),
    )


def frame_counts(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, uem: DataFrame | None = None, region: str = "all") -> DataFrame:
    """file, ref_frames, miss, fa, both: counts that need no mapping between the speakers."""
    return sums(counted_cells(ref, hyp, collar, uem).where(region_of(region)))


def co_occurrence(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, uem: DataFrame | None = None, region: str = "all") -> DataFrame:
    """file, ref_speaker, hyp_speaker, frames that both speak in."""
    r, h = spans_of(ref).withColumnRenamed("speaker", "ref_speaker"), spans_of(hyp).withColumnRenamed("speaker", "hyp_speaker")
    both = meeting(r, h)
    if collar > 0 or uem is not None or region != "all":
        scored = counted_cells(ref, hyp, collar, uem).where(region_of(region)).where("nr > 0 and nh > 0")
        both = meeting(both, scored.select("file", "a", "b"))
    return both.groupBy("file", "ref_speaker", "hyp_speaker").agg(F.sum(F.col("b") - F.col("a")).alias("frames"))


def best_assignment(gain: np.ndarray) -> list[int]:
    """For each row the column (or -1) of a one-to-one assignment of greatest total gain; rows without gain get none.

    Rows enter one by one. Each looks for the chain of exchanges that adds most: it may take a free
    column, or an owned one whose owner moves on. best[c] is the most that a chain ending at column c
    can add; it settles after at most one pass for each column, as no chain needs a column twice.
    """
    rows, cols = gain.shape
    owner = np.full(cols, -1)
    for row in range(rows):
        best, came = gain[row].astype(float).copy(), np.full(cols, -1)
        for _ in range(cols):
            owned = np.flatnonzero(owner >= 0)
            if not len(owned):
                break
            # A chain through an owned column goes on with that column's owner to any other column.
            onward = best[owned, None] - gain[owner[owned], owned][:, None] + gain[owner[owned]]
            onward[np.arange(len(owned)), owned] = -np.inf
            via = onward.argmax(axis=0)
            value = onward[via, np.arange(cols)]
            better = value > best + 1e-12 * (1 + np.abs(best))
            if not better.any():
                break
            best[better], came[better] = value[better], owned[via[better]]
        # The chain may end at a free column, or leave an owner without one.
        ends = np.where(owner < 0, best, best - np.where(owner >= 0, gain[owner, np.arange(cols)], 0))
        at = int(ends.argmax()) if cols else -1
        if cols == 0 or ends[at] <= 0:
            continue
        while came[at] >= 0:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[at] = row
    out = [-1] * rows
    for col, row in enumerate(owner.tolist()):
        if row >= 0 and gain[row, col] > 0:
            out[row] = col
    return out


def speaker_map(pairs: DataFrame) -> DataFrame:
    """file, hyp_speaker, ref_speaker, frames: the one-to-one mapping of most shared frames (columns of co_occurrence)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="hyp_speaker", columns="ref_speaker", values="frames", aggfunc="sum", fill_value=0)
        gain = table.to_numpy(dtype=float)
        got = [(table.index[i], table.columns[j], int(gain[i, j])) for i, j in enumerate(best_assignment(gain)) if j >= 0]
        return pd.DataFrame(got, columns=["hyp_speaker", "ref_speaker", "frames"]).assign(file=pdf["file"].iloc[0])[["file", "hyp_speaker", "ref_speaker", "frames"]]

    return pairs.groupBy("file").applyInPandas(run, "file string, hyp_speaker long, ref_speaker long, frames long")


def der(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, uem: DataFrame | None = None, region: str = "all") -> DataFrame:
    """file, ref_frames, miss, fa, confusion, der; a file without a scored reference, or with an end or collar that is not finite, has zeros."""
    counts = frame_counts(ref, hyp, max(collar, 0.0) if np.isfinite(collar) else 0.0, uem, region)
    right = speaker_map(co_occurrence(ref, hyp, max(collar, 0.0) if np.isfinite(collar) else 0.0, uem, region)).groupBy(F.col("file").alias("cf")).agg(F.sum("frames").alias("correct"))
    files = ref.select("file").unionAll(hyp.select("file")).distinct()
    out = files.join(valid_files(ref, hyp, collar).select("vf"), F.col("file") == F.col("vf"), "left").join(counts.withColumnRenamed("file", "nf"), F.col("vf") == F.col("nf"), "left").join(right, F.col("vf") == F.col("cf"), "left")
    scored = F.coalesce(F.col("ref_frames") > 0, F.lit(False))
    n = lambda c: F.when(scored, c).otherwise(F.lit(0)).cast("long")
    out = out.select("file", n(F.col("ref_frames")).alias("ref_frames"), n(F.col("miss")).alias("miss"), n(F.col("fa")).alias("fa"), n(F.col("both") - F.coalesce("correct", F.lit(0))).alias("confusion"))
    return out.withColumn("der", F.when(F.col("ref_frames") > 0, (F.col("miss") + F.col("fa") + F.col("confusion")) / F.col("ref_frames")).otherwise(0.0))


def decomposition(ref: DataFrame, hyp: DataFrame, collar: float = 0.0) -> DataFrame:
    """file, region (total, single, overlap), ref_frames, miss, fa, confusion, der."""
    parts = [der(ref, hyp, collar, None, r).withColumn("region", F.lit(n)) for n, r in (("total", "all"), ("single", "single"), ("overlap", "overlap"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("file", "region", "ref_frames", "miss", "fa", "confusion", "der")


def speaker_recall(ref: DataFrame, hyp: DataFrame, collar: float = 0.0) -> DataFrame:
    """file, speaker, ref_frames, recalled, recall: of each reference speaker's scored frames, those that its mapped hypothesis speaker has."""
    r = spans_of(ref)
    if collar > 0:
        r = meeting(r, counted_cells(ref, hyp, collar).select("file", "a", "b"))
    own = r.groupBy("file", "speaker").agg(F.sum(F.col("b") - F.col("a")).alias("ref_frames"))
    got = speaker_map(co_occurrence(ref, hyp, collar)).select(F.col("file").alias("gf"), F.col("ref_speaker").alias("gs"), F.col("frames").alias("recalled"))
    out = own.join(got, (F.col("file") == F.col("gf")) & (F.col("speaker") == F.col("gs")), "left").withColumn("recalled", F.coalesce("recalled", F.lit(0)).cast("long"))
    return out.select("file", "speaker", "ref_frames", "recalled", (F.col("recalled") / F.col("ref_frames")).alias("recall"))


def micro_macro(scores: DataFrame) -> DataFrame:
    """One row: percent of summed error frames in summed reference frames, and the mean of the files' ratios; 0 without any."""
    err = F.col("miss") + F.col("fa") + F.col("confusion")
    frames = F.coalesce(F.sum("ref_frames"), F.lit(0))
    micro = F.when(frames > 0, 100.0 * F.sum(err) / frames).otherwise(0.0)
    return scores.agg(F.count(F.lit(1)).alias("files"), micro.alias("micro"), F.coalesce(100.0 * F.avg("der"), F.lit(0.0)).alias("macro"))


def rounded_counts(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, skip_overlap: bool = False) -> DataFrame:
    """file, ref_s, miss_s, fa_s, both_s: the other scorer's seconds, on frames rounded half to even, with a collar whose ends both count."""

    def grid(x: Column) -> Column:
        return F.rint(x / F.lit(FRAME_S)).cast("long")

    def framed(turns: DataFrame) -> DataFrame:
        return turns.where(F.col("end") > F.col("start")).withColumn("sf", grid(F.col("start"))).withColumn("ef", grid(F.col("end")))

    layers = {"nr": spans_of(framed(ref)), "nh": spans_of(framed(hyp))}
    if collar > 0:
        edges = framed(ref).select("file", F.explode(F.array("sf", "ef")).alias("x"))
        c = F.rint(F.lit(collar / FRAME_S)).cast("long")
        layers["masked"] = edges.select("file", F.greatest(F.lit(0), F.col("x") - c).alias("a"), (F.col("x") + c + 1).alias("b"))
    found = cells({n: s.select("file", "a", "b") for n, s in layers.items()})
    found = found.where("masked = 0") if collar > 0 else found
    found = sums(found.where("nr < 2") if skip_overlap else found)
    return found.select("file", *[(F.col(c) * F.lit(FRAME_S)).alias(n) for c, n in (("ref_frames", "ref_s"), ("miss", "miss_s"), ("fa", "fa_s"), ("both", "both_s"))])


def numbered_labels(turns: DataFrame, first: int = 1000) -> DataFrame:
    """turns whose speaker is a text -> numbers from ``first`` in the order of first appearance in the file."""
    seen = turns.groupBy(F.col("file").alias("lf"), F.col("speaker").alias("ls")).agg(F.min("ord").alias("at"))
    ids = seen.withColumn("id", F.row_number().over(Window.partitionBy("lf").orderBy("at")) - 1 + first).drop("at")
    return turns.join(ids, (F.col("file") == F.col("lf")) & (F.col("speaker") == F.col("ls"))).withColumn("speaker", F.col("id").cast("long")).drop("lf", "ls", "id")


def word_pairs(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """file, word_ord, ref_speaker, hyp_speaker of the labelled reference words (file, word_ord, word, start, end, speaker).

    Files with equally many words pair by place; in others a word meets the one of equal text (ASCII case
    aside) whose midpoint is nearest, the first of several.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    place = F.row_number().over(Window.partitionBy("file").orderBy("word_ord"))
    rows = [w.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file"))).withColumn("key", F.translate("word", upper, lower)).withColumn("mid", (F.col("start") + F.col("end")) / 2) for w in (ref, hyp)]
    r = rows[0].where("speaker is not null").select("file", "word_ord", F.col("speaker").alias("ref_speaker"), "place", "n", "key", "mid")
    h = rows[1].select(F.col("file").alias("hf"), F.col("speaker").alias("hyp_speaker"), F.col("place").alias("hp"), F.col("n").alias("hn"), F.col("key").alias("hk"), F.col("mid").alias("hm"))
    sizes = h.groupBy(F.col("hf").alias("sf_")).agg(F.max("hn").alias("size"))
    r = r.join(sizes, F.col("file") == F.col("sf_"), "left").withColumn("even", F.coalesce(F.col("n") == F.col("size"), F.lit(False))).drop("sf_", "size")
    by_place = r.where("even").join(h, (F.col("file") == F.col("hf")) & (F.col("place") == F.col("hp")), "left").select("file", "word_ord", "ref_speaker", "hyp_speaker")
    # Nearest of equal text, from one ordered pass over both sides. Midpoints within CLOSE are one group: the distances to them may be equal
    # in double precision although the midpoints are not, and then the first place counts.
    other = h.select(F.col("hf").alias("file"), F.col("hk").alias("key"), F.col("hm").alias("mid"), F.struct(F.col("hp").cast("int").alias("p"), F.col("hyp_speaker").cast("long").alias("s")).alias("w"))
    up = Window.partitionBy("file", "key").orderBy("mid")
    other = other.withColumn("fresh", F.when(F.col("mid") - F.lag("mid").over(up) <= CLOSE, 0).otherwise(1)).withColumn("near", F.sum("fresh").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    other = other.groupBy("file", "key", "near", "mid").agg(F.min("w").alias("w")).groupBy("file", "key", "near").agg(F.min("mid").alias("mid"), F.collect_list(F.struct(F.col("mid").alias("m"), "w.p", "w.s")).alias("w"))
    kind = "array<struct<m:double,p:int,s:bigint>>"
    side = r.where("not even").select("file", "key", "mid", F.lit(1).alias("side"), "word_ord", "ref_speaker", F.lit(None).cast(kind).alias("w"))
    both = side.unionAll(other.select("file", "key", "mid", F.lit(0).alias("side"), F.lit(None).cast("long").alias("word_ord"), F.lit(None).cast("long").alias("ref_speaker"), F.col("w").cast(kind).alias("w")))
    # Two passes, up and down: a frame that ends with the partition would be read anew for each row.
    upward, downward = Window.partitionBy("file", "key").orderBy("mid", "side"), Window.partitionBy("file", "key").orderBy(F.desc("mid"), F.desc("side"))
    both = both.withColumn("before", F.last("w", ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.last("w", ignorenulls=True).over(downward.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.array().cast(kind)
    far = F.transform(F.concat(F.coalesce("before", none), F.coalesce("after", none)), lambda x: F.struct(F.coalesce(F.abs(F.col("mid") - x["m"]), F.lit(float("inf"))).alias("d"), x["p"].alias("p"), x["s"].alias("s")))
    near = both.where("side = 1").select("file", "word_ord", "ref_speaker", F.array_min(far)["s"].alias("hyp_speaker"))
    return by_place.unionAll(near)


def wder(pairs: DataFrame) -> DataFrame:
    """file, total_words, speaker_errors, wder from word pairs, under the best one-to-one mapping of speakers."""
    met = pairs.where("hyp_speaker is not null").groupBy("file", "ref_speaker", "hyp_speaker").agg(F.count(F.lit(1)).alias("frames"))
    right = speaker_map(met).groupBy(F.col("file").alias("rf")).agg(F.sum("frames").alias("right"))
    total = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("total_words"))
    out = total.join(right, F.col("file") == F.col("rf"), "left").withColumn("speaker_errors", (F.col("total_words") - F.coalesce("right", F.lit(0))).cast("long"))
    return out.select("file", "total_words", "speaker_errors", (F.col("speaker_errors") / F.col("total_words")).alias("wder"))


def equal_error_rate(scores: DataFrame, slices: int = 4096) -> DataFrame:
    """One row, eer in percent: (far + frr) / 2 at the score where they differ least, the lowest of several; 1.0 if empty or of one class.

    Counts are summed over ``slices`` equal parts of the range first, and only the distinct scores of a part are then put in order together.
    """
    steps = scores.groupBy("score").agg(F.sum(F.col("same").cast("long")).alias("pos"), F.sum((~F.col("same")).cast("long")).alias("neg"))
    whole = F.broadcast(steps.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))  # one row
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (slices - 1))).otherwise(0)
    steps = steps.join(whole, F.lit(True)).withColumn("part", part.cast("int"))
    above = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.groupBy(F.col("part").alias("p")).agg(F.sum("pos").alias("pp"), F.sum("neg").alias("pn"))  # ``slices`` rows at most
    parts = parts.select("p", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("neg_above"))
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    swept = steps.join(F.broadcast(parts), F.col("part") == F.col("p"))
    far = (F.col("neg_above") + F.sum("neg").over(down)) / F.nullif(F.col("all_neg"), F.lit(0))
    frr = (F.col("all_pos") - F.col("pos_above") - F.sum("pos").over(down)) / F.nullif(F.col("all_pos"), F.lit(0))
    swept = swept.select("score", far.alias("far"), frr.alias("frr"))
    least = swept.agg(F.min(F.when(F.col("far").isNotNull() & F.col("frr").isNotNull(), F.struct(F.abs(F.col("far") - F.col("frr")).alias("gap"), "score", "far", "frr"))).alias("m"))
    return least.select(F.coalesce(100.0 * ((F.col("m.far") + F.col("m.frr")) / 2), F.lit(1.0)).alias("eer"))


def speaker_rollup(turns: DataFrame) -> DataFrame:
    """file, speaker, label, seconds, n_turns."""
    from voxframe.functions.turns import duration, speaker_label

    out = turns.groupBy("file", "speaker").agg(F.sum(duration(F.col("start"), F.col("end"))).alias("seconds"), F.count(F.lit(1)).alias("n_turns"))
    return out.select("file", "speaker", speaker_label(F.col("speaker")).alias("label"), "seconds", "n_turns")


def speaker_count_diagnostics(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """One row: files, and how many have exactly the reference's number of speakers, are one off, and two or more."""
    n = [t.groupBy(F.col("file").alias(f)).agg(F.countDistinct("speaker").alias(c)) for t, f, c in ((ref, "file", "nr"), (hyp, "hf", "nh"))]
    off = n[0].join(n[1], F.col("file") == F.col("hf"), "left").select(F.abs(F.col("nr") - F.coalesce("nh", F.lit(0))).alias("off"))
    return off.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("off") == 0).alias("exact"), F.count_if(F.col("off") == 1).alias("one_off"), F.count_if(F.col("off") >= 2).alias("two_or_more"))


def run_report(scores: DataFrame, times: DataFrame) -> DataFrame:
    """One row of a run: files, mean rates, seconds of audio a second of work, summed and as mean (file, audio_s, runtime_s)."""
    t = times.select(F.col("file").alias("tf"), "audio_s", "runtime_s")
    both = scores.join(t, F.col("file") == F.col("tf"))
    rate = lambda c: F.avg(F.when(F.col("ref_frames") > 0, F.col(c) / F.col("ref_frames")).otherwise(0.0))
    return both.agg(
        F.count(F.lit(1)).alias("files"), rate("miss").alias("miss_rate"), rate("fa").alias("fa_rate"), rate("confusion").alias("confusion_rate"),
        F.sum("audio_s").alias("audio_s"), F.sum("runtime_s").alias("runtime_s"), F.try_divide(F.sum("audio_s"), F.sum("runtime_s")).alias("rtfx"),
    )


def dataset_score(ref: DataFrame, hyp: DataFrame, collar: float = 0.0) -> DataFrame:
    """One row over the files that both have: micro_macro and the counts' shares."""
    files = hyp.select(F.col("file").alias("kf")).distinct()
    both = der(ref.join(files, F.col("file") == F.col("kf"), "left_semi"), hyp.join(ref.select(F.col("file").alias("kf")).distinct(), F.col("file") == F.col("kf"), "left_semi"), collar)
    err = {c: F.when(F.sum("ref_frames") > 0, 100.0 * F.sum(c) / F.sum("ref_frames")).otherwise(0.0).alias(f"{c}_pct") for c in ("miss", "fa", "confusion")}
    total = F.sum("miss") + F.sum("fa") + F.sum("confusion")
    return both.agg(F.count(F.lit(1)).alias("files"), F.when(F.sum("ref_frames") > 0, 100.0 * total / F.sum("ref_frames")).otherwise(0.0).alias("micro"), (100.0 * F.avg("der")).alias("macro"), *err.values())


def head_to_head(ref: DataFrame, runs: DataFrame, collars: tuple[float, ...] = (0.0, 0.25)) -> DataFrame:
    """run, collar, files, micro, macro for every run (a column of ``runs``) and collar."""
    tagged = runs.withColumn("file", F.to_json(F.struct("run", "file")))
    names = runs.select("run").distinct()
    refs = ref.crossJoin(F.broadcast(names)).withColumn("file", F.to_json(F.struct("run", "file"))).drop("run")  # names: one row a run
    parts = []
    for c in collars:
        found = der(refs, tagged.drop("run"), c).where("ref_frames > 0").withColumn("run", F.get_json_object("file", "$.run"))
        total = F.sum("miss") + F.sum("fa") + F.sum("confusion")
        parts.append(found.groupBy("run").agg(F.count(F.lit(1)).alias("files"), (100.0 * total / F.sum("ref_frames")).alias("micro"), (100.0 * F.avg("der")).alias("macro")).withColumn("collar", F.lit(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("run", "collar", "files", "micro", "macro")


def validate_hypothesis(ref: DataFrame, hyp: DataFrame, lengths: DataFrame) -> DataFrame:
    """file, n_turns, bad_times, n_speakers, empty for every reference file: turns outside 0 <= start < end <= length + 0.1."""
    h = hyp.select(F.col("file").alias("hf"), "start", "end", "speaker")
    n = lengths.select(F.col("file").alias("lf"), "length")
    rows = ref.select("file").distinct().join(n, F.col("file") == F.col("lf"), "left").join(h, F.col("file") == F.col("hf"), "left")
    bad = F.col("hf").isNotNull() & ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length") + 0.1), F.lit(False))
    return rows.groupBy("file").agg(F.count("hf").alias("n_turns"), F.count_if(bad).alias("bad_times"), F.countDistinct("speaker").alias("n_speakers")).withColumn("empty", F.col("n_turns") == 0)


def verification_pairs(units: DataFrame, most_negatives: int = 50, cap: int = 1000) -> DataFrame:
    """file, a, b, same: pairs of a file's units (file, ord, speaker) by neighbours: each unit with its speaker's next,
    and with the next unit of the file's next speaker, up to ``cap`` of a kind and file; negatives across files up to ``most_negatives``."""
    by_speaker, by_file = Window.partitionBy("file", "speaker").orderBy("ord"), Window.partitionBy("file").orderBy("speaker", "ord")
    place = units.withColumn("place", F.row_number().over(by_speaker)).withColumn("rank", F.dense_rank().over(Window.partitionBy("file").orderBy("speaker")))
    same = place.select("file", F.col("ord").alias("a"), F.lead("ord").over(by_speaker).alias("b"), F.lit(True).alias("same")).where("b is not null")
    nxt = place.select(F.col("file").alias("nf"), F.col("place").alias("np"), F.col("rank").alias("nr"), F.col("ord").alias("b"))
    other = place.join(nxt, (F.col("file") == F.col("nf")) & (F.col("place") == F.col("np")) & (F.col("nr") == F.col("rank") + 1)).select("file", F.col("ord").alias("a"), "b", F.lit(False).alias("same"))
    capped = same.unionAll(other).withColumn("n", F.row_number().over(Window.partitionBy("file", "same").orderBy("a", "b"))).where(F.col("n") <= cap).drop("n")
    firsts = units.groupBy("file").agg(F.min("ord").alias("a")).orderBy("file").limit(most_negatives + 1)  # a bounded report
    across = firsts.select("file", "a", F.lead("a").over(Window.orderBy("file")).alias("b"), F.lit(False).alias("same")).where("b is not null")
    return capped.unionAll(across)


class Congruential:
    """A 64-bit linear congruential sequence, of which the high half is used. Fixed values, so that samples agree."""

    MULTIPLIER, ADDEND, SEED = 6364136223846793005, 1, 123456789

    def __init__(self, seed: int):
        self.state = seed & (1 << 64) - 1

    def below(self, n: int) -> int:
        self.state = (self.state * self.MULTIPLIER + self.ADDEND) & (1 << 64) - 1
        return (self.state >> 32) % n


def bootstrap_interval(scores: DataFrame, rounds: int = 1000, seed: int = Congruential.SEED, ratio: bool = True) -> DataFrame:
    """One row: low and high, the 2.5 and 97.5 % order statistics over resampled files (ratio of sums, or mean of ratios).

    One row for each file reaches one task: a resample needs them all, ``rounds`` times.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file", kind="stable")
        err, ref, draw, n = (pdf["miss"] + pdf["fa"] + pdf["confusion"]).to_numpy(float), pdf["ref_frames"].to_numpy(float), Congruential(seed), len(pdf)
        values = []
        for _ in range(rounds):
            at = [draw.below(n) for _ in range(n)]
            values.append(err[at].sum() / max(ref[at].sum(), 1.0) if ratio else float(np.mean(err[at] / np.maximum(ref[at], 1.0))))
        values.sort()
        return pd.DataFrame({"low": [100 * values[rounds * 25 // 1000]], "high": [100 * values[rounds * 975 // 1000]]})

    return scores.select("file", "ref_frames", "miss", "fa", "confusion").groupBy(F.lit(0).alias("all")).applyInPandas(run, "low double, high double")


def sample_files(names: list[str], size: int, seed: int = 1) -> list[str]:
    """Names drawn without replacement from a sorted list, in order; all, if ``size`` is 0 or not below their number."""
    left, draw = sorted(names), Congruential(seed)
    return sorted(left.pop(draw.below(len(left))) for _ in range(size)) if 0 < size < len(left) else left


def shards(files: DataFrame, n: int) -> DataFrame:
    """file, shard: files in order of name, dealt round-robin."""
    return files.select("file", ((F.row_number().over(Window.orderBy("file")) - 1) % n).cast("int").alias("shard"))


def gate(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, value, limit, passed: every metric of the baseline (metric, value, tolerance), a missing or NaN value failing."""
    limits = baseline.select("metric", (F.col("value") + F.col("tolerance")).alias("limit"))
    got = report.select(F.col("metric").alias("m"), "value")
    out = limits.join(got, F.col("metric") == F.col("m"), "left")
    ok = F.coalesce(~F.isnan("value") & (F.col("value") <= F.col("limit")), F.lit(False))
    return out.select("metric", "value", "limit", ok.alias("passed"))
