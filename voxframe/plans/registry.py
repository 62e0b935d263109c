"""Every registered query of the turn-analytics operators, with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions import turns as fn
from voxframe.functions.turns import rounded
from voxframe.operators import intervals, sequences
from voxframe.plans import derived, frames, scores, speech, streams, voices  # noqa: F401  (register their queries)
from voxframe.plans.base import FLAGSHIP, LABEL, ORACLES, QUERIES, query  # noqa: F401
from voxframe.sources import text_formats


@query("p1_turn_scalars", 'SELECT file, ord, greatest("end" - start, 0) AS dur, (start + "end") / 2 AS mid, ' + LABEL + " AS label, sf, ef FROM turns")
def p1(spark, d):
    return derived.turns(spark, d).select("file", "ord", fn.duration(F.col("start"), F.col("end")).alias("dur"), ((F.col("start") + F.col("end")) / 2).alias("mid"), fn.speaker_label(F.col("speaker")).alias("label"), "sf", "ef")


@query("p2_gap_to_previous", 'SELECT file, ord, greatest(0, start - lag("end") OVER (PARTITION BY file ORDER BY start, ord)) AS gap FROM turns QUALIFY lag(ord) OVER (PARTITION BY file ORDER BY start, ord) IS NOT NULL')
def p2(spark, d):
    return intervals.nearest_gap(derived.turns(spark, d)).where("gap is not null").select("file", "ord", "gap")


@query("p3_cosine_to_next", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def p3(spark, d):
    a = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("before"), F.col("embedding").alias("other"))
    return a.join(b, F.col("vec_id") == F.col("before")).select("vec_id", rounded(fn.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query("p7_confidence", "SELECT event_id, round(1 / (1 + exp(-10 * (least(1, value / 100) - 0.5))), 9) AS conf FROM events")
def p7(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", rounded(fn.confidence(F.col("value") / 100), 9).alias("conf"))


@query("i1_merge_segments", """, m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start - lag("end") OVER w <= 60 THEN 0 ELSE 1 END AS fresh FROM turns WINDOW w AS (PARTITION BY file ORDER BY ord)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) AS run FROM m)
SELECT file, min(speaker) AS speaker, arg_min(start, ord) AS start, arg_max("end", ord) AS "end", count(*) AS n_merged FROM r GROUP BY file, run""")
def i1(spark, d):
    return intervals.merge_adjacent(derived.turns(spark, d), 60.0)


UNION_SQL = """, m AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w + {gap} THEN 1 ELSE 0 END AS fresh FROM turns WINDOW w AS (PARTITION BY file, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file, speaker ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT file, speaker, run, min(start) AS start, max("end") AS "end" FROM r GROUP BY ALL) """


@query("i2_merge_by_speaker", UNION_SQL.format(gap="30") + 'SELECT file, speaker, start, "end" FROM u')
def i2(spark, d):
    return intervals.merge_by_speaker(derived.turns(spark, d), 30.0)


@query("i3_union_duration", UNION_SQL.format(gap="0") + 'SELECT file, speaker, CAST(sum(CAST(round(("end" - start) * 1000) AS BIGINT)) AS BIGINT) AS union_ms FROM u GROUP BY ALL')
def i3(spark, d):
    return intervals.merge_by_speaker(derived.turns(spark, d)).groupBy("file", "speaker").agg(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")).alias("union_ms"))


@query("a20_num_speakers", "SELECT file, max(speaker) + 1 AS by_label, count(DISTINCT speaker) AS by_turn FROM turns GROUP BY file")
def a20(spark, d):
    return derived.turns(spark, d).groupBy("file").agg((F.max("speaker") + 1).alias("by_label"), F.countDistinct("speaker").alias("by_turn"))


@query("s4_speaker_ids", """, f AS (SELECT file, speaker, row_number() OVER (PARTITION BY file ORDER BY min(ord)) - 1 AS speaker_id FROM turns GROUP BY file, speaker)
SELECT file, ord, speaker, speaker_id FROM turns JOIN f USING (file, speaker)""")
def s4(spark, d):
    return text_formats.dense_speaker_ids(derived.turns(spark, d).select("file", "ord", "speaker"))


RTTM_SQL = "SELECT file, ord, 'SPEAKER ' || file || ' 1 ' || printf('%.3f', start) || ' ' || printf('%.3f', \"end\" - start) || ' <NA> <NA> ' || " + LABEL + " || ' <NA> <NA>' AS line FROM turns"


@query("s5_rttm_write", RTTM_SQL)
def s5(spark, d):
    return text_formats.rttm_lines(derived.turns(spark, d))


@query("s1_rttm_parse", ", l AS (" + RTTM_SQL + ") SELECT ord AS line_no, split_part(line, ' ', 2) AS file, CAST(split_part(line, ' ', 4) AS DOUBLE) AS start, CAST(split_part(line, ' ', 5) AS DOUBLE) AS duration, split_part(line, ' ', 8) AS speaker FROM l")
def s1(spark, d):
    return text_formats.parse_rttm(text_formats.rttm_lines(derived.turns(spark, d)).select(F.col("ord").alias("line_no"), "line"))


@query("s6_uem_parse", "SELECT file, CAST(ord AS DOUBLE) AS start, CAST(ord + speaker AS DOUBLE) AS \"end\" FROM turns WHERE speaker > 0")
def s6(spark, d):
    t = derived.turns(spark, d)
    return text_formats.parse_uem(t.select(F.concat_ws(" ", "file", F.lit("1"), F.col("ord").cast("string"), (F.col("ord") + F.col("speaker")).cast("string")).alias("line")))


def _frames(spark, d):
    return derived.turns(spark, d).select("file", F.col("ord").alias("frame"), ((F.col("ord") * 37 % 100) / 100.0).alias("prob"))


GATE = """, f AS (SELECT file, ord AS frame, (ord * 37 % 100) / 100.0::DOUBLE AS prob FROM turns),
g AS (SELECT *, coalesce(last_value(CASE WHEN prob >= 0.7 THEN 1 WHEN prob < 0.4 THEN 0 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY frame), 0) = 1 AS active FROM f) """


@query("q3_hysteresis", GATE + "SELECT file, frame, active FROM g")
def q3(spark, d):
    return sequences.hysteresis(_frames(spark, d), 0.7, 0.4).select("file", "frame", "active")


@query("q4_regions", GATE + """, m AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY file ORDER BY frame) - 1 < 2 THEN 0 ELSE 1 END AS fresh FROM g WHERE active),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY frame) AS run FROM m)
SELECT file, min(frame) AS first, max(frame) AS last FROM r GROUP BY file, run HAVING max(frame) - min(frame) + 1 >= 3""")
def q4(spark, d):
    return sequences.regions(sequences.hysteresis(_frames(spark, d), 0.7, 0.4), 2, 3)


@query("i6_exclusive_timeline", """, cuts AS (SELECT file, sf AS a FROM turns UNION SELECT file, ef FROM turns),
cells AS (SELECT file, a, lead(a) OVER (PARTITION BY file ORDER BY a) AS b FROM cuts QUALIFY b IS NOT NULL),
best AS (SELECT c.file, c.a, c.b, t.speaker FROM cells c JOIN turns t ON c.file = t.file AND t.sf <= c.a AND c.b <= t.ef AND t."end" > t.start QUALIFY row_number() OVER (PARTITION BY c.file, c.a ORDER BY t."end" - t.start DESC, t.speaker, t.ord) = 1),
m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND lag(b) OVER w = a THEN 0 ELSE 1 END AS fresh FROM best WINDOW w AS (PARTITION BY file ORDER BY a)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY a) AS run FROM m)
SELECT file, min(speaker) AS speaker, min(a) AS a, max(b) AS b FROM r GROUP BY file, run""")
def i6(spark, d):
    return sequences.exclusive_timeline(derived.turns(spark, d))


@query("c6_canonical_labels", """, z AS (SELECT file, speaker, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, min(ord)) - 1 AS canon FROM turns GROUP BY file, speaker)
SELECT file, ord, speaker AS label, canon FROM turns JOIN z USING (file, speaker)""")
def c6(spark, d):
    return sequences.canonical_labels(derived.turns(spark, d).select("file", "ord", F.col("speaker").alias("label")))


@query("c29_majority_map", """, p AS (SELECT file, speaker AS local, ord % 3 AS global_id, sum(ef - sf) AS seconds FROM turns GROUP BY ALL)
SELECT file, local, global_id FROM p WHERE seconds > 0 QUALIFY row_number() OVER (PARTITION BY file, local ORDER BY seconds DESC, global_id) = 1""")
def c29(spark, d):
    return sequences.majority_map(derived.turns(spark, d).select("file", F.col("speaker").alias("local"), (F.col("ord") % 3).alias("global_id"), (F.col("ef") - F.col("sf")).alias("seconds")))


@query("a21_label_flip_rate", "SELECT file, avg((t.speaker <> h.speaker)::INT::DOUBLE) AS rate FROM turns t JOIN hyp h USING (file, ord) GROUP BY file")
def a21(spark, d):
    pick = lambda df: df.select("file", F.col("ord").alias("place"), F.col("speaker").alias("label"))
    return sequences.label_flip_rate(pick(derived.turns(spark, d)), pick(derived.hypothesis(spark, d)))


for _name, _partial in (("w1_windows", False), ("w2_windows_partial", True)):
    query(_name, f""", t AS (SELECT file, max(ef) AS total FROM turns GROUP BY file)
SELECT file, CAST(s // 200 AS INTEGER) AS win, s AS start, least(s + 500, total) AS "end" FROM t, unnest(range(0, total {'' if _partial else '- 499'}, 200)) AS x(s)""")(
        lambda spark, d, partial=_partial: intervals.sliding_windows(derived.totals(spark, d), 500, 200, partial)
    )


@query("i7b_turn_overlaps", 'SELECT a.file, a.ord, b.ord AS ord2, least(a."end", b."end") - greatest(a.start, b.start) AS shared FROM turns a JOIN turns b ON a.file = b.file AND a.ord < b.ord AND a.speaker <> b.speaker AND a.start < b."end" AND b.start < a."end"')
def i7b(spark, d):
    return intervals.overlapping_pairs(derived.turns(spark, d))
