"""Registered queries of the scoring operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions.turns import rounded, simple_upper
from voxframe.operators import scoring
from voxframe.plans import derived
from voxframe.plans.base import query


def cells_sql(collar: float = 0.0, uem: bool = False, region: str = "all") -> str:
    """CTEs: r and h (speakers of each scored cell), n (cell, width, counts), counts, co."""
    marks = f', marks AS (SELECT file, CAST(floor(greatest(x - {collar}, 0::DOUBLE) / 0.01::DOUBLE) AS BIGINT) AS a, CAST(ceil((x + {collar}) / 0.01::DOUBLE) AS BIGINT) AS b FROM (SELECT file, unnest([start, "end"]) AS x FROM turns))' if collar else ""
    frames = ', regions AS (SELECT file, (SELECT min(i) FROM range(CAST(start * 100 AS BIGINT) - 2 + 2 * (start < 0.02)::INT, CAST(start * 100 AS BIGINT) + 3) AS t(i) WHERE (i + 0.5::DOUBLE) * 0.01::DOUBLE >= start) AS a, (SELECT min(i) FROM range(CAST("end" * 100 AS BIGINT) - 2, CAST("end" * 100 AS BIGINT) + 3) AS t(i) WHERE (i + 0.5::DOUBLE) * 0.01::DOUBLE >= "end") AS b FROM uem)' if uem else ""
    cuts = "SELECT file, sf AS a FROM turns UNION SELECT file, ef FROM turns UNION SELECT file, sf FROM hyp UNION SELECT file, ef FROM hyp" + (" UNION SELECT file, a FROM marks UNION SELECT file, b FROM marks" if collar else "") + (" UNION SELECT file, a FROM regions UNION SELECT file, b FROM regions" if uem else "")
    kept = ("AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.file = c.file AND m.a <= c.a AND c.b <= m.b) " if collar else "") + ("AND EXISTS (SELECT 1 FROM regions m WHERE m.file = c.file AND m.a <= c.a AND c.b <= m.b) " if uem else "")
    where = {"all": "true", "single": "nr < 2", "overlap": "nr >= 2"}[region]
    return f"""{marks}{frames}, cuts AS ({cuts}),
c0 AS (SELECT file, a, lead(a) OVER (PARTITION BY file ORDER BY a) AS b FROM cuts),
cells AS (SELECT * FROM c0 c WHERE b IS NOT NULL {kept}),
r AS (SELECT DISTINCT c.file, c.a, c.b, t.speaker FROM cells c JOIN turns t ON c.file = t.file AND t.sf <= c.a AND c.b <= t.ef),
h AS (SELECT DISTINCT c.file, c.a, c.b, t.speaker FROM cells c JOIN hyp t ON c.file = t.file AND t.sf <= c.a AND c.b <= t.ef),
rn AS (SELECT file, a, count(*) AS k FROM r GROUP BY ALL), hn AS (SELECT file, a, count(*) AS k FROM h GROUP BY ALL),
n AS (SELECT * FROM (SELECT c.file, c.a, c.b - c.a AS w, coalesce(rn.k, 0) AS nr, coalesce(hn.k, 0) AS nh FROM cells c LEFT JOIN rn ON c.file = rn.file AND c.a = rn.a LEFT JOIN hn ON c.file = hn.file AND c.a = hn.a) WHERE {where}),
counts AS (SELECT file, CAST(sum(w * nr) AS BIGINT) AS ref_frames, CAST(sum(w * greatest(0, nr - nh)) AS BIGINT) AS miss, CAST(sum(w * greatest(0, nh - nr)) AS BIGINT) AS fa, CAST(sum(w * least(nr, nh)) AS BIGINT) AS "both" FROM n GROUP BY file),
co AS (SELECT r.file, r.speaker AS ref_speaker, h.speaker AS hyp_speaker, CAST(sum(n.w) AS BIGINT) AS frames FROM r JOIN h ON r.file = h.file AND r.a = h.a JOIN n ON n.file = r.file AND n.a = r.a GROUP BY ALL) """


#: From co: the best one-to-one mapping, by trying all: reference speakers in turn take a free hypothesis speaker or none.
BEST = """, opts AS (SELECT file, ref_speaker, hyp_speaker, frames FROM co UNION ALL SELECT file, i, -1, 0 FROM (SELECT DISTINCT file FROM turns), unnest(range(0, 8)) AS x(i)),
dp AS (SELECT DISTINCT file, 0::BIGINT AS i, 0::BIGINT AS taken, 0::BIGINT AS total, []::BIGINT[] AS path FROM turns
       UNION ALL SELECT d.file, d.i + 1, CASE WHEN o.hyp_speaker < 0 THEN d.taken ELSE d.taken | (1::BIGINT << o.hyp_speaker) END, d.total + o.frames, list_append(d.path, o.hyp_speaker)
       FROM dp d JOIN opts o ON o.file = d.file AND o.ref_speaker = d.i WHERE o.hyp_speaker < 0 OR d.taken & (1::BIGINT << o.hyp_speaker) = 0),
best AS (SELECT file, max(total) AS correct, arg_max(path, total) AS path FROM dp WHERE i = 8 GROUP BY file),
der AS (SELECT b.file, coalesce(ref_frames, 0) AS ref_frames, coalesce(miss, 0) AS miss, coalesce(fa, 0) AS fa, coalesce("both" - correct, 0) AS confusion FROM best b LEFT JOIN counts c ON b.file = c.file),
der2 AS (SELECT file, ref_frames, CASE WHEN ref_frames > 0 THEN miss ELSE 0 END AS miss, CASE WHEN ref_frames > 0 THEN fa ELSE 0 END AS fa, CASE WHEN ref_frames > 0 THEN confusion ELSE 0 END AS confusion FROM der),
ders AS (SELECT *, CASE WHEN ref_frames > 0 THEN (miss + fa + confusion)::DOUBLE / ref_frames ELSE 0::DOUBLE END AS der FROM der2) """


def pair(spark, d):
    return derived.turns(spark, d), derived.hypothesis(spark, d)


@query("a1_der", cells_sql() + BEST + "SELECT * FROM ders")
def a1(spark, d):
    return scoring.der(*pair(spark, d))


@query("a2_der_collar", cells_sql(0.25) + BEST + "SELECT * FROM ders")
def a2(spark, d):
    return scoring.der(*pair(spark, d), 0.25)


@query("a3_frame_counts", cells_sql() + "SELECT * FROM counts")
def a3(spark, d):
    return scoring.frame_counts(*pair(spark, d))


@query("a4_co_occurrence", cells_sql() + "SELECT * FROM co")
def a4(spark, d):
    return scoring.co_occurrence(*pair(spark, d))


@query("a4_co_occurrence_masked", cells_sql(0.25, True) + "SELECT * FROM co")
def a4_masked(spark, d):
    return scoring.co_occurrence(*pair(spark, d), 0.25, derived.scored_regions(spark, d))


@query("a6_speaker_totals", cells_sql() + BEST + "SELECT file, correct FROM best")
def a6(spark, d):
    return scoring.speaker_map(scoring.co_occurrence(*pair(spark, d))).groupBy("file").agg(F.sum("frames").alias("correct"))


@query("a7_der_single", cells_sql(0.25, False, "single") + BEST + "SELECT * FROM ders")
def a7_single(spark, d):
    return scoring.der(*pair(spark, d), 0.25, None, "single")


@query("a7_der_overlap", cells_sql(0.0, False, "overlap") + BEST + "SELECT * FROM ders")
def a7_overlap(spark, d):
    return scoring.der(*pair(spark, d), 0.0, None, "overlap")


@query("a7_der_uem", cells_sql(0.0, True) + BEST + "SELECT * FROM ders")
def a7_uem(spark, d):
    return scoring.der(*pair(spark, d), 0.0, derived.scored_regions(spark, d))


@query("a8_decomposition")
def a8(spark, d):
    return scoring.decomposition(*pair(spark, d), 0.25)


@query("a8_speaker_recall", cells_sql(0.25) + BEST + """, own AS (SELECT r.file, r.speaker, CAST(sum(n.w) AS BIGINT) AS ref_frames FROM r JOIN n ON r.file = n.file AND r.a = n.a GROUP BY ALL)
SELECT o.file, o.speaker, o.ref_frames, coalesce(c.frames, 0) AS recalled, coalesce(c.frames, 0)::DOUBLE / o.ref_frames AS recall
FROM own o JOIN best b ON o.file = b.file LEFT JOIN co c ON c.file = o.file AND c.ref_speaker = o.speaker AND c.hyp_speaker = b.path[o.speaker + 1]""")
def a8_recall(spark, d):
    return scoring.speaker_recall(*pair(spark, d), 0.25)


@query("a9_der_from_labels", cells_sql() + BEST + "SELECT * FROM ders")
def a9(spark, d):
    ref, hyp = pair(spark, d)
    return scoring.der(scoring.numbered_labels(ref.withColumn("speaker", F.concat(F.lit("spk"), F.col("speaker").cast("string")))), hyp)


WORDS = """, rw AS (SELECT *, CASE WHEN word_ord % 17 = 3 THEN NULL ELSE speaker END AS ref_speaker FROM cwords),
hw AS (SELECT file, word_ord, upper(word) AS word, start + 0.004::DOUBLE * (word_ord % 5) AS start, "end" + 0.004::DOUBLE * (word_ord % 5) AS "end", CASE WHEN word_ord % 7 = 2 THEN 2 - speaker WHEN word_ord % 11 = 5 THEN NULL ELSE speaker + 1 END AS speaker
       FROM cwords WHERE CAST(file AS BIGINT) % 2 = 0 OR word_ord % 9 <> 4),
sizes AS (SELECT file, (SELECT count(*) FROM rw x WHERE x.file = f.file) AS nr, (SELECT count(*) FROM hw x WHERE x.file = f.file) AS nh FROM (SELECT DISTINCT file FROM rw) f),
rp AS (SELECT r.*, row_number() OVER (PARTITION BY r.file ORDER BY word_ord) AS place, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, (start + "end") / 2 AS mid, nr = nh AS even FROM rw r JOIN sizes s ON r.file = s.file),
hp AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY word_ord) AS place, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, (start + "end") / 2 AS mid FROM hw),
pairs AS (SELECT r.file, r.word_ord, r.ref_speaker, h.speaker AS hyp_speaker FROM rp r LEFT JOIN hp h ON r.file = h.file AND r.place = h.place WHERE even AND ref_speaker IS NOT NULL
          UNION ALL SELECT r.file, r.word_ord, any_value(r.ref_speaker), arg_min(struct_pack(s := h.speaker), struct_pack(d := abs(r.mid - h.mid), p := h.place)).s FROM rp r LEFT JOIN hp h ON r.file = h.file AND r.key = h.key WHERE NOT even AND ref_speaker IS NOT NULL GROUP BY r.file, r.word_ord) """


def spoken_pair(spark, d):
    w = derived.spoken_words(spark, d)
    ref = w.withColumn("speaker", F.when(F.col("word_ord") % 17 == 3, None).otherwise(F.col("speaker")))
    speaker = F.when(F.col("word_ord") % 7 == 2, 2 - F.col("speaker")).when(F.col("word_ord") % 11 == 5, None).otherwise(F.col("speaker") + 1)
    shift = F.lit(0.004) * (F.col("word_ord") % 5)
    hyp = w.where((F.col("file").cast("long") % 2 == 0) | (F.col("word_ord") % 9 != 4)).select("file", "word_ord", simple_upper(F.col("word")).alias("word"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), speaker.alias("speaker"))
    return ref, hyp


@query("a10_word_pairs", WORDS + "SELECT * FROM pairs")
def a10_pairs(spark, d):
    return scoring.word_pairs(*spoken_pair(spark, d))


@query("a10_wder", WORDS + """, co AS (SELECT file, ref_speaker, hyp_speaker, count(*) AS frames FROM pairs WHERE hyp_speaker IS NOT NULL GROUP BY ALL),
opts AS (SELECT * FROM co UNION ALL SELECT file, i, -1, 0 FROM (SELECT DISTINCT file FROM pairs), unnest(range(0, 3)) AS x(i)),
dp AS (SELECT DISTINCT file, 0::BIGINT AS i, 0::BIGINT AS taken, 0::BIGINT AS total FROM pairs
       UNION ALL SELECT d.file, d.i + 1, CASE WHEN o.hyp_speaker < 0 THEN d.taken ELSE d.taken | (1::BIGINT << o.hyp_speaker) END, d.total + o.frames
       FROM dp d JOIN opts o ON o.file = d.file AND o.ref_speaker = d.i WHERE o.hyp_speaker < 0 OR d.taken & (1::BIGINT << o.hyp_speaker) = 0),
b AS (SELECT file, max(total) AS hits FROM dp WHERE i = 3 GROUP BY file), n AS (SELECT file, count(*) AS total_words FROM pairs GROUP BY file)
SELECT n.file, total_words, total_words - hits AS speaker_errors, (total_words - hits)::DOUBLE / total_words AS wder FROM n JOIN b ON n.file = b.file""")
def a10(spark, d):
    return scoring.wder(scoring.word_pairs(*spoken_pair(spark, d)))


@query("a11_micro_macro", cells_sql() + BEST + "SELECT count(*) AS files, 100.0::DOUBLE * sum(miss + fa + confusion)::DOUBLE / sum(ref_frames)::DOUBLE AS micro, round(100.0::DOUBLE * avg(der), 9) AS macro FROM ders")
def a11(spark, d):
    return scoring.micro_macro(scoring.der(*pair(spark, d))).withColumn("macro", rounded("macro", 9))


@query("a12_speaker_counts", """, o AS (SELECT abs(nr - coalesce(nh, 0)) AS off FROM (SELECT file, count(DISTINCT speaker) AS nr FROM turns WHERE speaker < 5 GROUP BY file) r LEFT JOIN (SELECT file, count(DISTINCT speaker) AS nh FROM hyp GROUP BY file) h USING (file))
SELECT count(*) AS files, count(*) FILTER (off = 0) AS exact, count(*) FILTER (off = 1) AS one_off, count(*) FILTER (off >= 2) AS two_or_more FROM o""")
def a12(spark, d):
    ref, hyp = pair(spark, d)
    return scoring.speaker_count_diagnostics(ref.where("speaker < 5"), hyp)


@query("a13_run_report", cells_sql() + BEST + """, t AS (SELECT file, sum("end" - start)::DOUBLE AS audio_s, count(*)::DOUBLE / 100 AS runtime_s FROM (SELECT * FROM turns ORDER BY ord) GROUP BY file)
SELECT count(*) AS files, round(avg(CASE WHEN ref_frames > 0 THEN miss::DOUBLE / ref_frames ELSE 0 END), 6) AS miss_rate, round(avg(CASE WHEN ref_frames > 0 THEN fa::DOUBLE / ref_frames ELSE 0 END), 6) AS fa_rate,
       round(avg(CASE WHEN ref_frames > 0 THEN confusion::DOUBLE / ref_frames ELSE 0 END), 6) AS confusion_rate, round(sum(audio_s), 3) AS audio_s, round(sum(runtime_s), 3) AS runtime_s, round(sum(audio_s) / sum(runtime_s), 3) AS rtfx FROM ders JOIN t USING (file)""")
def a13(spark, d):
    ref, hyp = pair(spark, d)
    times = ref.groupBy("file").agg(F.sum(F.col("end") - F.col("start")).alias("audio_s"), (F.count(F.lit(1)) / 100.0).alias("runtime_s"))
    r = scoring.run_report(scoring.der(ref, hyp), times)
    return r.select("files", *[rounded(c, 6).alias(c) for c in ("miss_rate", "fa_rate", "confusion_rate")], *[rounded(c, 3).alias(c) for c in ("audio_s", "runtime_s", "rtfx")])


ROUNDED = """, tr AS (SELECT file, speaker, CAST(round_even(start / 0.01::DOUBLE, 0) AS BIGINT) AS sf, CAST(round_even("end" / 0.01::DOUBLE, 0) AS BIGINT) AS ef FROM turns WHERE "end" > start),
th AS (SELECT file, speaker, CAST(round_even(start / 0.01::DOUBLE, 0) AS BIGINT) AS sf, CAST(round_even("end" / 0.01::DOUBLE, 0) AS BIGINT) AS ef FROM hyp WHERE "end" > start),
marks AS (SELECT file, greatest(0, x - 25) AS a, x + 26 AS b FROM (SELECT file, unnest([sf, ef]) AS x FROM tr)),
cuts AS (SELECT file, sf AS a FROM tr UNION SELECT file, ef FROM tr UNION SELECT file, sf FROM th UNION SELECT file, ef FROM th UNION SELECT file, a FROM marks UNION SELECT file, b FROM marks),
c0 AS (SELECT file, a, lead(a) OVER (PARTITION BY file ORDER BY a) AS b FROM cuts),
cells AS (SELECT * FROM c0 c WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.file = c.file AND m.a <= c.a AND c.b <= m.b)),
rn AS (SELECT c.file, c.a, count(DISTINCT t.speaker) AS k FROM cells c JOIN tr t ON c.file = t.file AND t.sf <= c.a AND c.b <= t.ef GROUP BY ALL),
hn AS (SELECT c.file, c.a, count(DISTINCT t.speaker) AS k FROM cells c JOIN th t ON c.file = t.file AND t.sf <= c.a AND c.b <= t.ef GROUP BY ALL),
n AS (SELECT c.file, c.b - c.a AS w, coalesce(rn.k, 0) AS nr, coalesce(hn.k, 0) AS nh FROM cells c LEFT JOIN rn ON c.file = rn.file AND c.a = rn.a LEFT JOIN hn ON c.file = hn.file AND c.a = hn.a)
SELECT file, CAST(sum(w * nr) AS BIGINT) * 0.01::DOUBLE AS ref_s, CAST(sum(w * greatest(0, nr - nh)) AS BIGINT) * 0.01::DOUBLE AS miss_s, CAST(sum(w * greatest(0, nh - nr)) AS BIGINT) * 0.01::DOUBLE AS fa_s, CAST(sum(w * least(nr, nh)) AS BIGINT) * 0.01::DOUBLE AS both_s FROM n {} GROUP BY file"""


@query("a14_rounded_grid", ROUNDED.format(""))
def a14(spark, d):
    return scoring.rounded_counts(*pair(spark, d), 0.25)


@query("a14_rounded_no_overlap", ROUNDED.format("WHERE nr < 2"))
def a14_single(spark, d):
    return scoring.rounded_counts(*pair(spark, d), 0.25, True)


@query("a15_dataset_score", cells_sql().replace("cuts AS (", "keep AS (SELECT DISTINCT file FROM turns WHERE CAST(right(file, 2) AS BIGINT) % 3 <> 0), cuts AS (") + BEST + """, k AS (SELECT * FROM ders WHERE file IN (SELECT file FROM keep))
SELECT count(*) AS files, 100.0::DOUBLE * sum(miss + fa + confusion)::DOUBLE / sum(ref_frames)::DOUBLE AS micro, round(100.0::DOUBLE * avg(der), 9) AS macro, 100.0::DOUBLE * sum(miss)::DOUBLE / sum(ref_frames)::DOUBLE AS miss_pct, 100.0::DOUBLE * sum(fa)::DOUBLE / sum(ref_frames)::DOUBLE AS fa_pct, 100.0::DOUBLE * sum(confusion)::DOUBLE / sum(ref_frames)::DOUBLE AS confusion_pct FROM k""")
def a15(spark, d):
    ref, hyp = pair(spark, d)
    return scoring.dataset_score(ref, hyp.where(F.substring("file", -2, 2).cast("long") % 3 != 0)).withColumn("macro", rounded("macro", 9))


@query("a16_bootstrap")
def a16(spark, d):
    return scoring.bootstrap_interval(scoring.der(*pair(spark, d)))


@query("a17_equal_error_rate", """, s AS (SELECT value AS score, user_id % 2 = 0 AS same FROM events),
g AS (SELECT score, sum(same::INT) AS pos, sum((NOT same)::INT) AS neg FROM s GROUP BY score),
e AS (SELECT score, sum(neg) OVER w::DOUBLE / sum(neg) OVER () AS far, (sum(pos) OVER () - sum(pos) OVER w)::DOUBLE / sum(pos) OVER () AS frr FROM g WINDOW w AS (ORDER BY score DESC))
SELECT 100.0::DOUBLE * ((far + frr) / 2) AS eer FROM e ORDER BY abs(far - frr), score LIMIT 1""".replace("sum(neg) OVER w::DOUBLE", "(sum(neg) OVER w)::DOUBLE"))
def a17(spark, d):
    return scoring.equal_error_rate(spark.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("score"), (F.col("user_id") % 2 == 0).alias("same")))


@query("a18_verification_pairs", """, u AS (SELECT file, ord, speaker, row_number() OVER (PARTITION BY file, speaker ORDER BY ord) AS place, dense_rank() OVER (PARTITION BY file ORDER BY speaker) AS rank, lead(ord) OVER (PARTITION BY file, speaker ORDER BY ord) AS next FROM turns),
p AS (SELECT file, ord AS a, next AS b, true AS same FROM u WHERE next IS NOT NULL UNION ALL SELECT u.file, u.ord, v.ord, false FROM u JOIN u v ON u.file = v.file AND u.place = v.place AND v.rank = u.rank + 1),
c AS (SELECT file, a, b, same FROM p QUALIFY row_number() OVER (PARTITION BY file, same ORDER BY a, b) <= 200),
f AS (SELECT file, min(ord) AS a FROM turns GROUP BY file ORDER BY file LIMIT 11)
SELECT * FROM c UNION ALL SELECT * FROM (SELECT file, a, lead(a) OVER (ORDER BY file) AS b, false AS same FROM f) WHERE b IS NOT NULL""")
def a18(spark, d):
    return scoring.verification_pairs(derived.turns(spark, d).select("file", "ord", "speaker"), 10, 200)


@query("a19_speaker_rollup", """SELECT file, speaker, 'SPEAKER_' || lpad(CAST(speaker AS VARCHAR), 2, '0') AS label, round(sum(greatest("end" - start, 0)), 6) AS seconds, count(*) AS n_turns FROM turns GROUP BY ALL""")
def a19(spark, d):
    return scoring.speaker_rollup(derived.turns(spark, d)).withColumn("seconds", rounded("seconds", 6))


@query("a22_gates", """, g AS (SELECT file AS metric, count(*)::DOUBLE AS value FROM hyp GROUP BY file), b AS (SELECT file AS metric, count(*)::DOUBLE * 0.9::DOUBLE + 3 AS "limit" FROM turns GROUP BY file)
SELECT b.metric, value, "limit", coalesce(value <= "limit", false) AS passed FROM b LEFT JOIN g USING (metric)""")
def a22(spark, d):
    ref, hyp = pair(spark, d)
    return scoring.gate(hyp.groupBy(F.col("file").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")), ref.groupBy(F.col("file").alias("metric")).agg((F.count(F.lit(1)).cast("double") * 0.9).alias("value"), F.lit(3.0).alias("tolerance")))


@query("a23_head_to_head")
def a23(spark, d):
    ref, hyp = pair(spark, d)
    runs = hyp.withColumn("run", F.lit("shifted")).unionByName(ref.withColumn("run", F.lit("same")))
    return scoring.head_to_head(ref, runs)


@query("a24_shards", ", f AS (SELECT DISTINCT file FROM turns) SELECT file, CAST((row_number() OVER (ORDER BY file) - 1) % 4 AS INTEGER) AS shard FROM f")
def a24(spark, d):
    return scoring.shards(derived.turns(spark, d).select("file").distinct(), 4)


@query("a25_validate", """, l AS (SELECT file, max("end") - 40 AS length FROM turns GROUP BY file), f AS (SELECT DISTINCT file FROM turns)
SELECT f.file, count(h.file) AS n_turns, count(*) FILTER (h.file IS NOT NULL AND NOT (h.start >= 0 AND h.start < h."end" AND h."end" <= length + 0.1::DOUBLE)) AS bad_times, count(DISTINCT h.speaker) AS n_speakers, count(h.file) = 0 AS empty
FROM f JOIN l ON f.file = l.file LEFT JOIN hyp h ON f.file = h.file AND h.speaker <> 3 AND h.file < '2024-01-20' GROUP BY f.file""")
def a25(spark, d):
    ref, hyp = pair(spark, d)
    return scoring.validate_hypothesis(ref, hyp.where("speaker <> 3 and file < '2024-01-20'"), ref.groupBy("file").agg((F.max("end") - 40).alias("length")))
