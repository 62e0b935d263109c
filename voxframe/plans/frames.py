"""Registered queries of windows, speech detection and segmentation, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxframe.functions import vectors as fv
from voxframe.functions.turns import rounded
from voxframe.operators import intervals, segmentation, sequences
from voxframe.plans import derived
from voxframe.plans.base import in_parts, query

STRIDE = 0.125
#: Ten frames a window, five of them shared with the next; logits of a frame from two places of an embedding, by turns.
LOGITS = """, lf AS (SELECT (vec_id // 50)::VARCHAR AS file, w AS win, w * 0.625::DOUBLE AS start, vec_id % 50 - 5 * w AS frame, list_transform(embedding[1 + w % 2 * 7 : 7 + w % 2 * 7], lambda v: v::DOUBLE * 12) AS z FROM embeddings, unnest(range(0, 9)) AS t(w) WHERE vec_id % 50 >= 5 * w AND vec_id % 50 < 5 * w + 10),
ex AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM lf),
pr AS (SELECT file, win, start, frame, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM ex) """
DECODED = LOGITS + ", de AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS cls, list_max(probs) AS p FROM pr) "
SETS = ", sets AS (SELECT * FROM (VALUES (1, 0), (2, 1), (3, 2), (4, 0), (4, 1), (5, 0), (5, 2), (6, 1), (6, 2)) AS t(cls, local)) "
AVERAGE = LOGITS + """, ap AS (SELECT file, 5 * win + frame AS frame, i, avg(probs[i]) AS v FROM pr, unnest(range(1, 8)) AS t(i) GROUP BY ALL),
av AS (SELECT file, frame, list(v ORDER BY i) AS probs FROM ap GROUP BY ALL) """


def logits(spark, d):
    derived.importable(spark)
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("at", F.col("vec_id") % 50)
    w = e.withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(8)))).where("at >= 5 * win and at < 5 * win + 10")
    z = F.transform(F.slice("embedding", F.col("win") % 2 * 7 + 1, F.lit(7)), lambda v: v.cast("double") * 12)
    return w.select(F.expr("vec_id div 50").cast("string").alias("file"), F.col("win").cast("long").alias("win"), (F.col("win") * 0.625).alias("start"), (F.col("at") - 5 * F.col("win")).alias("frame"), z.alias("logits"))


def averages(spark, d):
    return segmentation.overlap_add(segmentation.decode_windows(logits(spark, d)), STRIDE)


@query("p16_softmax", LOGITS + "SELECT file, win, frame, list_transform(probs, lambda v: round(v, 6)) AS probs FROM pr")
def p16(spark, d):
    return logits(spark, d).select("file", "win", "frame", F.transform(fv.softmax(F.col("logits")), lambda v: rounded(v, 6)).alias("probs"))


@query("p17_powerset", "SELECT event_id, CAST(event_id % 7 AS INTEGER) AS cls, [[], [0], [1], [2], [0, 1], [0, 2], [1, 2]][event_id % 7 + 1]::INTEGER[] AS speakers, CAST(event_id % 7 AS INTEGER) AS again FROM events")
def p17(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 7).cast("int").alias("cls"))
    s = fv.speakers_of_class(F.col("cls"))
    return ev.select("event_id", "cls", s.alias("speakers"), fv.class_of_speakers(F.reverse(s)).alias("again"))


@query("p18_frame_class", DECODED + "SELECT file, win, frame, cls, round(p, 6) AS p FROM de")
def p18(spark, d):
    return segmentation.decode_windows(logits(spark, d)).select("file", "win", "frame", "cls", rounded("p", 6).alias("p"))


@query("q1_energy_probs", "SELECT vec_id::VARCHAR AS file, k AS frame, round(least(1, sqrt(list_sum(list_transform(embedding[16 * k + 1 : 16 * k + 16], lambda v: v::DOUBLE * v::DOUBLE))) / 10.0::DOUBLE ** (-6.0::DOUBLE / 20)), 6) AS prob FROM embeddings, unnest(range(0, 4)) AS t(k)")
def q1(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("file"), F.lit(0).alias("block"), F.col("embedding").alias("samples"))
    return segmentation.energy_probs(e, 16, -6.0).select("file", "frame", rounded("prob", 6).alias("prob"))


SPEECH = """, f AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS frame, {prob} AS prob FROM ev),
n AS (SELECT file, max(frame) + 1 AS n FROM f GROUP BY file), g AS (SELECT * FROM f WHERE {held}),
m AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY file ORDER BY frame) - 1 < 2 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY frame) AS run FROM m),
x AS (SELECT file, min(CASE WHEN prob >= 0.6 THEN frame END) AS first, max(frame) AS last FROM r GROUP BY file, run)
SELECT x.file, first, {end} AS "end" FROM x JOIN n ON x.file = n.file WHERE first IS NOT NULL AND {end} - first >= 3"""
PROB = "((event_id * 37 + user_id * 11) % 100) / 100.0::DOUBLE"


def speech_frames(spark, d, holes=False):
    from pyspark.sql import Window

    ev = derived._events(spark, d)
    prob = ((F.col("event_id") * 37 + F.col("user_id") * 11) % 100) / 100.0
    prob = F.when(F.col("event_id") % 9 == 4, float("nan")).otherwise(prob) if holes else prob
    return ev.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("event_id")) - 1).cast("long").alias("frame"), prob.alias("prob"))


@query("q4_regions_keep", SPEECH.format(prob=PROB, held="prob >= 0.6", end="least(last + 3, n)"))
def q4_keep(spark, d):
    return segmentation.speech_regions(speech_frames(spark, d), 0.6, 2, 3)


@query("q4_regions_trim", SPEECH.format(prob=PROB, held="prob >= 0.6", end="(last + 1)"))
def q4_trim(spark, d):
    return segmentation.speech_regions(speech_frames(spark, d), 0.6, 2, 3, False)


@query("q5_speech_with_gaps", SPEECH.format(prob=f"CASE WHEN event_id % 9 = 4 THEN NULL ELSE {PROB} END", held="prob IS NULL OR prob >= 0.6", end="least(last + 3, n)"))
def q5(spark, d):
    return segmentation.speech_regions(speech_frames(spark, d, True), 0.6, 2, 3)


@query("q6_segment_speech", """, f AS (SELECT (vec_id // 50)::VARCHAR AS file, vec_id % 50 * 4 + k AS frame, least(1, sqrt(list_sum(list_transform(embedding[16 * k + 1 : 16 * k + 16], lambda v: v::DOUBLE * v::DOUBLE))) / 10.0::DOUBLE ** (-6.0::DOUBLE / 20)) AS prob FROM embeddings, unnest(range(0, 4)) AS t(k)),
n AS (SELECT file, max(frame) + 1 AS n FROM f GROUP BY file),
m AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY file ORDER BY frame) - 1 < 2 THEN 0 ELSE 1 END AS fresh FROM f WHERE prob >= 0.98),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY frame) AS run FROM m), x AS (SELECT file, min(frame) AS first, max(frame) AS last FROM r GROUP BY file, run)
SELECT x.file, first * 16 AS first, least(last + 3, n) * 16 AS "end" FROM x JOIN n ON x.file = n.file WHERE least(last + 3, n) - first >= 4""")
def q6(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 50").cast("string").alias("file"), (F.col("vec_id") % 50).alias("block"), F.col("embedding").alias("samples"))
    return segmentation.segment_speech(e, 16, 16000, -6.0, 0.98, 2.0, 0.004)


@query("q8_decode_windows", DECODED + "SELECT file, win, cls, count(*) AS frames FROM de GROUP BY ALL")
def q8(spark, d):
    return segmentation.decode_windows(logits(spark, d)).groupBy("file", "win", "cls").agg(F.count(F.lit(1)).alias("frames"))


@query("q9_window_permutations")
def q9(spark, d):
    return segmentation.window_permutations(segmentation.decode_windows(logits(spark, d)), STRIDE)


@query("q10_overlap_add", AVERAGE + "SELECT file, frame, list_transform(probs, lambda v: round(v, 6)) AS probs FROM av")
def q10(spark, d):
    return averages(spark, d).select("file", "frame", F.transform("probs", lambda v: rounded(v, 6)).alias("probs"))


@query("q11_argmax_classes", AVERAGE + "SELECT file, frame, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS cls, round(list_max(probs), 6) AS p FROM av")
def q11(spark, d):
    return segmentation.argmax_classes(averages(spark, d)).select("file", "frame", "cls", rounded("p", 6).alias("p"))


BINARIZED = AVERAGE + SETS + """, sp AS (SELECT file, frame, local AS s, sum(probs[cls + 1]) AS prob FROM av JOIN sets ON true GROUP BY ALL),
ga AS (SELECT *, coalesce(last_value(CASE WHEN prob >= 0.4 THEN 1 WHEN prob < 0.2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY file, s ORDER BY frame), 0) = 1 AS active FROM sp),
mm AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY file, s ORDER BY frame) - 1 < 2 THEN 0 ELSE 1 END AS fresh FROM ga WHERE active),
rr AS (SELECT *, sum(fresh) OVER (PARTITION BY file, s ORDER BY frame) AS run FROM mm),
re AS (SELECT file, s, min(frame) AS a, max(frame) AS b FROM rr GROUP BY file, s, run HAVING max(frame) - min(frame) + 1 >= 2),
act AS (SELECT p.file, p.frame, p.s, p.prob FROM sp p JOIN re ON p.file = re.file AND p.s = re.s AND p.frame BETWEEN re.a AND re.b QUALIFY row_number() OVER (PARTITION BY p.file, p.frame ORDER BY p.prob DESC, p.s) <= 2),
who AS (SELECT file, frame, list(s ORDER BY s) AS ss, avg(prob) AS p FROM act GROUP BY ALL),
bi AS (SELECT av.file, av.frame, CAST(CASE WHEN ss IS NULL THEN 0 WHEN len(ss) = 1 THEN ss[1] + 1 ELSE 3 + ss[1] + ss[2] END AS INTEGER) AS cls, CASE WHEN ss IS NULL THEN probs[1] ELSE least(1, who.p) END AS p FROM av LEFT JOIN who ON av.file = who.file AND av.frame = who.frame) """


def binarized(spark, d):
    return segmentation.binarize(averages(spark, d), 0.4, 0.2, 2, 2)


@query("q12_binarize", BINARIZED + "SELECT file, frame, cls, round(p, 6) AS p FROM bi")
def q12(spark, d):
    return binarized(spark, d).select("file", "frame", "cls", rounded("p", 6).alias("p"))


@query("q13_run_lengths", BINARIZED + """, ea AS (SELECT bi.file, frame, p, local, bi.cls >= 4 AS is_overlap FROM bi JOIN sets ON bi.cls = sets.cls),
m2 AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY file, local, is_overlap ORDER BY frame) = 1 THEN 0 ELSE 1 END AS fresh FROM ea),
r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY file, local, is_overlap ORDER BY frame) AS run FROM m2)
SELECT file, local, is_overlap, min(frame) * 0.125::DOUBLE AS start, (max(frame) + 1) * 0.125::DOUBLE AS "end", round(avg(p), 6) AS confidence FROM r2 GROUP BY file, local, is_overlap, run HAVING count(*) >= 2""")
def q13(spark, d):
    return segmentation.segments_of_frames(binarized(spark, d), 0.0, STRIDE, 0.25).withColumn("confidence", rounded("confidence", 6))


@query("q14_stitch")
def q14(spark, d):
    return segmentation.stitch(logits(spark, d), STRIDE, 0.25, (0.4, 0.2, 2, 2))


@query("q15_window_units", DECODED + SETS + """, u AS (SELECT file, win, local, count(*) * 0.125::DOUBLE AS raw, count(*) FILTER (de.cls < 4) * 0.125::DOUBLE AS alone FROM de JOIN sets ON de.cls = sets.cls GROUP BY ALL)
SELECT file, win, local, CASE WHEN alone >= 0.5 THEN alone ELSE raw END AS seconds, alone >= 0.5 AS is_clean FROM u WHERE raw >= 0.2""")
def q15(spark, d):
    return segmentation.window_units(segmentation.decode_windows(logits(spark, d)), STRIDE, 0.2, 0.5)


@query("q16_reconstruct", DECODED + SETS + """, ro AS (SELECT file, win, cls, least(5 * win + frame, 47) AS g FROM de), cn AS (SELECT file, g, avg(CASE WHEN cls = 0 THEN 0 WHEN cls < 4 THEN 1 ELSE 2 END) AS mean FROM ro GROUP BY ALL),
hi AS (SELECT ro.file, g, (local + win) % 4 AS label, count(*) AS hits FROM ro JOIN sets ON ro.cls = sets.cls GROUP BY ALL),
ke AS (SELECT hi.file, hi.g, label FROM hi JOIN cn ON hi.file = cn.file AND hi.g = cn.g QUALIFY row_number() OVER (PARTITION BY hi.file, hi.g ORDER BY hits DESC, label) <= floor(mean + 0.5)),
m2 AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY file, label ORDER BY g) = 1 THEN 0 ELSE 1 END AS fresh FROM ke), r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY file, label ORDER BY g) AS run FROM m2),
tu AS (SELECT file, label AS speaker, min(g) * 0.125::DOUBLE AS start, least((max(g) + 1) * 0.125::DOUBLE, 5.9::DOUBLE) AS "end" FROM r2 GROUP BY file, label, run),
m3 AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY file, speaker ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.25 THEN 0 ELSE 1 END AS fresh FROM tu WHERE "end" - start >= 0.125), r3 AS (SELECT *, sum(fresh) OVER (PARTITION BY file, speaker ORDER BY start) AS run FROM m3)
SELECT file, speaker, min(start) AS start, max("end") AS "end" FROM r3 GROUP BY file, speaker, run""")
def q16(spark, d):
    dec = segmentation.decode_windows(logits(spark, d))
    labels = dec.select("file", "win").distinct().withColumn("local", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("label", (F.col("local") + F.col("win")) % 4)
    lengths = dec.select("file").distinct().withColumn("length", F.lit(5.9))
    return segmentation.reconstruct(dec, labels, STRIDE, lengths, 0.125, 0.25)


@query("q17_filter_bank")
def q17(spark, d):
    def run(batches):
        for b in in_parts(batches):
            rows = []
            for file, seed in zip(b["file"], b["seed"]):
                t = np.arange(1600) / 16000
                bank = segmentation.filter_bank(np.sin(2 * np.pi * (200 + 10 * seed) * t))
                rows += [(file, i, v.round(5).astype(np.float64)) for i, v in enumerate(bank)]
            yield pd.DataFrame(rows, columns=["file", "frame", "values"])

    seeds = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("file"), F.col("label").alias("seed"))
    return seeds.mapInPandas(run, "file string, frame long, values array<double>")


@query("q18_mean_normalize", "SELECT file, frame, list(round(v - m, 6) ORDER BY b) AS values FROM (SELECT (vec_id // 50)::VARCHAR AS file, vec_id AS frame, b, embedding[b]::DOUBLE AS v, avg(embedding[b]::DOUBLE) OVER (PARTITION BY vec_id // 50, b) AS m FROM embeddings, unnest(range(1, 9)) AS t(b)) GROUP BY ALL")
def q18(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 50").cast("string").alias("file"), F.col("vec_id").alias("frame"), F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("values"))
    return segmentation.mean_normalize(e).select("file", "frame", F.transform("values", lambda v: rounded(v, 6)).alias("values"))


@query("q19_resegment")
def q19(spark, d):
    from voxframe.operators import vectors
    from voxframe.plans.voices import emb

    e = emb(spark, d)
    over = e.where("ord % 3 = 0").select("file", F.col("ord").alias("r_id"), "start", "end", F.col("label").alias("speaker"), F.when(F.col("ord") % 2 == 0, (F.col("label") + 1) % 4).alias("second"), "embedding")
    return segmentation.resegment(e.withColumnRenamed("label", "speaker"), over, vectors.centroids(e, "file", "label"), 0.2)


@query("w5_dense_windows", """, RECURSIVE_ AS (SELECT 1), dw AS (SELECT file, ord, start, "end" AS till, start AS s, 0 AS win FROM turns UNION ALL SELECT file, ord, start, till, s + 15.0::DOUBLE, win + 1 FROM dw WHERE till - start > 30 AND s + 30.0::DOUBLE < till)
SELECT file, ord, win, round(s, 6) AS start, round(least(s + 30.0::DOUBLE, till), 6) AS "end" FROM dw""".replace("RECURSIVE_ AS (SELECT 1), ", ""))
def w5(spark, d):
    w = intervals.dense_windows(derived.turns(spark, d), 30.0)
    return w.select("file", "ord", "win", rounded("start", 6).alias("start"), rounded("end", 6).alias("end"))


@query("w6_padded_windows", ', l AS (SELECT file, max("end") AS length FROM cturns GROUP BY file) SELECT file, w::INTEGER AS win, w * 2.0::DOUBLE AS start, w * 2.0::DOUBLE + 10 AS "end" FROM l, unnest(range(0, CAST(ceil(length / 2) AS BIGINT))) AS t(w)')
def w6(spark, d):
    return intervals.padded_windows(derived.spoken_turns(spark, d).groupBy("file").agg(F.max("end").alias("length")))


@query("w7_chunks", ', l AS (SELECT file, CAST(max("end") * 16000 AS BIGINT) AS length FROM cturns GROUP BY file) SELECT file, c::INTEGER AS chunk, c * 80000 AS start, least(c * 80000 + 160000, length) AS "end" FROM l, unnest(range(0, 1 + CASE WHEN length <= 160000 THEN 0 ELSE CAST(ceil((length - 160000) / 80000.0::DOUBLE) AS BIGINT) END)) AS t(c) WHERE length > 0')
def w7(spark, d):
    return intervals.chunks(derived.spoken_turns(spark, d).groupBy("file").agg(F.round(F.max("end") * 16000).cast("long").alias("length")), 160000, 80000)


@query("w8_region_windows", """, r AS (SELECT file, ord, start_ms AS a, start_ms + dur_ms AS b FROM ev) SELECT file, ord, CAST((s - a) // 15000 AS INTEGER) AS win, s AS start, least(s + 30000, b) AS "end", 30000 - (least(s + 30000, b) - s) AS padding
FROM (SELECT *, event_id AS ord0 FROM (SELECT file, event_id, event_id AS ord, start_ms AS a, start_ms + dur_ms AS b FROM ev)) q, unnest(range(a, CASE WHEN b - a >= 30000 THEN b - 29999 ELSE a + 1 END, 15000)) AS t(s)""".replace(", r AS (SELECT file, ord, start_ms AS a, start_ms + dur_ms AS b FROM ev) SELECT", "SELECT"))
def w8(spark, d):
    ev = derived._events(spark, d).select("file", F.col("event_id").alias("ord"), F.col("start_ms").alias("start"), (F.col("start_ms") + F.col("dur_ms")).alias("end"))
    return intervals.region_windows(ev, 30000, 15000)


@query("q2_frame_geometry", "SELECT 63 AS min_off, 8 AS min_on")
def q2(spark, d):
    off, on = segmentation.frame_geometry(512, 16000, 2000.0, 0.25)
    return spark.createDataFrame([(off, on)], "min_off int, min_on int")


@query("t8_sessions", SPEECH.format(prob=PROB, held="prob >= 0.6", end="least(last + 3, n)"))
def t8(spark, d):
    return segmentation.speech_regions(sequences.hysteresis(speech_frames(spark, d), 0.6, 0.6).withColumn("prob", F.when(F.col("active"), 1.0).otherwise(0.0)), 0.6, 2, 3)
