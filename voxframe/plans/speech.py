"""Registered queries of words, turns, overlaps and text formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions import turns as fn
from voxframe.functions.turns import rounded
from voxframe.operators import attribution, intervals
from voxframe.plans import derived
from voxframe.plans.base import LABEL, query
from voxframe.sources import text_formats as tf

#: Turns with gaps: of the conversations' turns, those with an odd number of the rest shortened, and some without a speaker change.
GAPPY = """, gt AS (SELECT file, ord, speaker, start, CASE WHEN ord % 2 = 1 THEN start + ("end" - start) * 0.25::DOUBLE ELSE "end" END AS "end", ord % 3 <> 1 AS stable FROM cturns),
gw AS (SELECT file, word_ord, word, start, "end", ((word_ord * 37) % 100) / 100.0::DOUBLE AS confidence FROM cwords)"""


def gappy(spark, d):
    t = derived.spoken_turns(spark, d)
    return t.withColumn("end", F.when(F.col("ord") % 2 == 1, F.col("start") + (F.col("end") - F.col("start")) * 0.25).otherwise(F.col("end"))).withColumn("stable", F.col("ord") % 3 != 1)


def spoken(spark, d):
    return derived.spoken_words(spark, d).drop("speaker").withColumn("confidence", (F.col("word_ord") * 37 % 100) / 100.0)


@query("p1_contains", """SELECT file, ord, (start <= 43200 AND 43200 <= "end") AS inside, (start <= "end" AND "end" <= "end") AS at_end FROM turns""")
def p1_contains(spark, d):
    s, e = F.col("start"), F.col("end")
    return derived.turns(spark, d).select("file", "ord", fn.contains(s, e, F.lit(43200.0)).alias("inside"), fn.contains(s, e, e).alias("at_end"))


@query("p10_cue_text", """SELECT event_id, replace(replace(replace(replace(t, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' '), '-->', '-- >') AS cue,
replace(replace(replace(replace(replace(replace(t, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' '), '-->', '-- >'), '&', '&amp;'), '<', '&lt;') AS vtt
FROM (SELECT event_id, event_type || chr(13) || chr(10) || chr(10) || 'a --> b & <' || chr(13) || user_id AS t FROM events)""")
def p10(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat("event_type", F.lit("\r\n\na --> b & <\r"), F.col("user_id").cast("string")).alias("t"))
    return ev.select("event_id", fn.cue_text(F.col("t")).alias("cue"), fn.vtt_text(F.col("t")).alias("vtt"))


@query("p13_ends_sentence", """SELECT file, word_ord, regexp_matches(regexp_replace(word, '["'')\\]}]+$', ''), '[.?!]$') AS ends FROM cwords""")
def p13(spark, d):
    return spoken(spark, d).select("file", "word_ord", fn.ends_sentence(F.col("word")).alias("ends"))


@query("p14_needs_repair", 'SELECT file, word_ord, NOT ("end" > start) AS bad FROM cwords')
def p14(spark, d):
    return spoken(spark, d).select("file", "word_ord", fn.needs_repair(F.col("start"), F.col("end")).alias("bad"))


@query("p15_word_anchor", 'SELECT file, word_ord, start AS at_start, (start + "end") / 2 AS at_mid, "end" AS at_end FROM cwords')
def p15(spark, d):
    return spoken(spark, d).select("file", "word_ord", *[fn.anchor(F.col("start"), F.col("end"), a).alias(f"at_{a}") for a in ("start", "mid", "end")])


@query("p8_distance_confidence", "SELECT event_id, round(1 / (1 + exp(-10 * (greatest(-1, least(1, 1 - value / 100)) - 0.5))), 9) AS conf FROM events")
def p8(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", rounded(fn.distance_confidence(F.col("value") / 100), 9).alias("conf"))


@query("p12_remap", "SELECT file, ord, CASE speaker WHEN 1 THEN 7 WHEN 7 THEN 1 ELSE speaker END AS speaker FROM turns")
def p12(spark, d):
    return tf.remap_speakers(derived.turns(spark, d), spark.createDataFrame([(1, 7), (7, 1)], "old long, new long")).select("file", "ord", "speaker")


@query("i1_merge_confidence", """, c AS (SELECT *, CASE WHEN ord % 3 = 0 THEN NULL ELSE (ord % 8) / 8.0::DOUBLE END AS confidence FROM turns),
m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start - lag("end") OVER w <= 60 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY file ORDER BY ord)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) AS run FROM m)
SELECT file, min(speaker) AS speaker, arg_min(start, ord) AS start, arg_max("end", ord) AS "end", round(avg(confidence), 9) AS confidence FROM r GROUP BY file, run""")
def i1_confidence(spark, d):
    t = derived.turns(spark, d).withColumn("confidence", F.when(F.col("ord") % 3 != 0, (F.col("ord") % 8) / 8.0))
    return intervals.merge_adjacent(t, 60.0).select("file", "speaker", "start", "end", rounded("confidence", 9).alias("confidence"))


@query("i4_clean_duration", """, o AS (SELECT file, start, "end" FROM turns WHERE ord % 4 = 0), s AS (SELECT * FROM turns WHERE ord % 4 <> 0),
p AS (SELECT s.file, s.ord, greatest(s.start, o.start) AS a, least(s."end", o."end") AS b FROM s JOIN o ON s.file = o.file AND o.start < s."end" AND s.start < o."end"),
n AS (SELECT *, max(b) OVER (PARTITION BY file, ord ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p WHERE b > a),
c AS (SELECT file, ord, sum(greatest(0, b - greatest(a, coalesce(before, a)))) AS covered FROM n GROUP BY ALL)
SELECT s.file, s.ord, round(greatest(0, s."end" - s.start - coalesce(covered, 0)), 6) AS clean FROM s LEFT JOIN c ON s.file = c.file AND s.ord = c.ord""")
def i4(spark, d):
    t = derived.turns(spark, d)
    return attribution.clean_seconds(t.where("ord % 4 <> 0"), t.where("ord % 4 = 0")).select("file", "ord", rounded("clean", 6).alias("clean"))


@query("i5_overlap_regions", """, cuts AS (SELECT file, start AS a FROM u5 UNION SELECT file, "end" FROM u5),
cells AS (SELECT file, a, lead(a) OVER (PARTITION BY file ORDER BY a) AS b FROM cuts QUALIFY b IS NOT NULL),
x AS (SELECT c.file, c.a, c.b, list_sort(list(u.speaker)) AS speakers FROM cells c JOIN u5 u ON c.file = u.file AND u.start <= c.a AND c.b <= u."end" GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT *, CASE WHEN lag(speakers) OVER w = speakers AND abs(a - lag(b) OVER w) < 1e-3 THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY file ORDER BY a)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY a) AS run FROM m)
SELECT file, min(a) AS start, max(b) AS "end", any_value(speakers) AS speakers FROM r GROUP BY file, run""".replace(", cuts AS", """, m5 AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM turns WINDOW w AS (PARTITION BY file, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r5 AS (SELECT *, sum(fresh) OVER (PARTITION BY file, speaker ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m5),
u5 AS (SELECT file, speaker, run, min(start) AS start, max("end") AS "end" FROM r5 GROUP BY ALL), cuts AS""", 1))
def i5(spark, d):
    u = intervals.merge_by_speaker(derived.turns(spark, d)).withColumn("ord", F.col("speaker"))
    return attribution.overlap_regions(u).withColumn("speakers", F.array_sort("speakers"))


@query("i7_overlap_pairs", """, s AS (SELECT file, ord, start, "end", speaker % 3 AS local, ord % 2 = 0 AS is_overlap FROM turns WHERE ord % 4 < 3 UNION ALL SELECT file, ord + 1000000, start, "end" + 0.0000004::DOUBLE, (speaker + 1) % 3, ord % 4 = 0 FROM turns WHERE ord % 2 = 0)
SELECT a.file, a.start, a."end", least(a.local, b.local) AS lo, greatest(a.local, b.local) AS hi FROM s a JOIN s b ON a.file = b.file AND a.ord < b.ord AND a.local <> b.local AND a.is_overlap AND b.is_overlap AND abs(a.start - b.start) < 1e-6 AND abs(a."end" - b."end") < 1e-6""")
def i7(spark, d):
    t = derived.turns(spark, d)
    a = t.where("ord % 4 < 3").select("file", "ord", "start", "end", (F.col("speaker") % 3).alias("local"), (F.col("ord") % 2 == 0).alias("is_overlap"))
    b = t.where("ord % 2 = 0").select("file", (F.col("ord") + 1000000).alias("ord"), "start", (F.col("end") + 0.0000004).alias("end"), ((F.col("speaker") + 1) % 3).alias("local"), (F.col("ord") % 4 == 0).alias("is_overlap"))
    return attribution.overlap_pairs(a.unionAll(b))


COVER = """(SELECT arg_min(t.speaker, t.ord) FROM gt t WHERE t.file = w.file AND {} t.start <= (w.start + w."end") / 2 AND (w.start + w."end") / 2 <= t."end")"""


@query("i8_speaker_at", GAPPY + "SELECT w.file, w.word_ord, " + COVER.format("") + " AS speaker, " + COVER.format("t.stable AND") + " AS stable_speaker FROM gw w")
def i8(spark, d):
    t, w = gappy(spark, d), spoken(spark, d).select("file", "word_ord", ((F.col("start") + F.col("end")) / 2).alias("at"))
    a = attribution.speaker_at(w, t)
    b = attribution.speaker_at(w, t, True).select(F.col("file").alias("f2"), F.col("word_ord").alias("o2"), F.col("speaker").alias("stable_speaker"))
    return a.join(b, (F.col("file") == F.col("f2")) & (F.col("word_ord") == F.col("o2"))).select("file", "word_ord", "speaker", "stable_speaker")


@query("i9_label_words", GAPPY + "SELECT w.file, w.word_ord, w.word, coalesce(" + COVER.format("") + ", (SELECT arg_max(t.speaker, t.ord) FROM gt t WHERE t.file = w.file)) AS speaker, 1.0::DOUBLE AS confidence FROM gw w")
def i9(spark, d):
    return intervals.label_words(spoken(spark, d).drop("confidence"), gappy(spark, d), True).select("file", "word_ord", "word", "speaker", "confidence")


@query("i10_label_words_none", GAPPY + ", x AS (SELECT w.file, w.word_ord, w.word, " + COVER.format("") + " AS speaker FROM gw w) SELECT *, CASE WHEN speaker IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM x")
def i10(spark, d):
    return intervals.label_words(spoken(spark, d).drop("confidence"), gappy(spark, d), False).select("file", "word_ord", "word", "speaker", "confidence")


INTERPOLATED = """, n AS (SELECT *, NOT ("end" > start) AS bad FROM gw),
p AS (SELECT *, last_value(CASE WHEN NOT bad THEN "end" END IGNORE NULLS) OVER (PARTITION BY file ORDER BY word_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
                first_value(CASE WHEN NOT bad THEN start END IGNORE NULLS) OVER (PARTITION BY file ORDER BY word_ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM n),
x AS (SELECT *, CASE WHEN pe IS NOT NULL THEN pe WHEN ns IS NOT NULL THEN greatest(ns - 0.001::DOUBLE, 0) ELSE 0 END AS s2, CASE WHEN ns IS NOT NULL THEN ns WHEN pe IS NOT NULL THEN pe + 0.001::DOUBLE ELSE 0.001::DOUBLE END AS e2 FROM p),
iw AS (SELECT file, word_ord, word, confidence, CASE WHEN NOT bad THEN start WHEN e2 > s2 THEN s2 ELSE greatest(s2, 0) END AS start, CASE WHEN NOT bad THEN "end" WHEN e2 > s2 THEN e2 ELSE greatest(s2, 0) + 0.001::DOUBLE END AS "end", bad AS interpolated FROM x)"""

ATTRIBUTED = """, ov AS (SELECT w.file, w.word_ord, t.speaker, t.ord, greatest(0, least(w."end", t."end") - greatest(w.start, t.start)) AS shared, greatest(0, greatest(w.start, t.start) - least(w."end", t."end")) AS gap FROM iw w JOIN gt t ON w.file = t.file),
b AS (SELECT file, word_ord, speaker, shared FROM ov QUALIFY row_number() OVER (PARTITION BY file, word_ord ORDER BY shared DESC, gap, speaker, ord) = 1),
aw AS (SELECT w.file, w.word_ord, w.word, w.start, w."end", w.interpolated, b.speaker, CASE WHEN b.shared > 0 AND w."end" > w.start THEN w.confidence * least(1.0::DOUBLE, b.shared / (w."end" - w.start)) ELSE w.confidence END AS confidence FROM iw w LEFT JOIN b ON w.file = b.file AND w.word_ord = b.word_ord)"""

SMOOTHED = """, sn AS (SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(regexp_replace(word, '["'')\\]}]+$', ''), '[.?!]$') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY word_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM aw),
sc AS (SELECT file, sentence, speaker, count(*) AS n FROM sn WHERE speaker IS NOT NULL GROUP BY ALL),
sm AS (SELECT file, sentence, speaker AS main, n, sum(n) OVER (PARTITION BY file, sentence) AS al FROM sc QUALIFY row_number() OVER (PARTITION BY file, sentence ORDER BY n DESC, speaker) = 1),
sw AS (SELECT s.* EXCLUDE (speaker), CASE WHEN s.speaker IS NULL THEN NULL WHEN (m.n::DOUBLE / m.al)::FLOAT > 0.6::FLOAT THEN m.main ELSE s.speaker END AS speaker FROM sn s LEFT JOIN sm m ON s.file = m.file AND s.sentence = m.sentence)"""


@query("i11_interpolate_times", GAPPY + INTERPOLATED + 'SELECT file, word_ord, start, "end", interpolated FROM iw')
def i11(spark, d):
    from voxframe.operators.sequences import interpolate_times

    return interpolate_times(spoken(spark, d).select("file", "word_ord", "start", "end"))


@query("i12_attribute_words", GAPPY + INTERPOLATED.replace("SELECT *, NOT (\"end\" > start) AS bad FROM gw", "SELECT *, false AS bad FROM gw") + ATTRIBUTED + "SELECT file, word_ord, speaker, round(confidence, 9) AS confidence FROM aw")
def i12(spark, d):
    return attribution.attribute_words(spoken(spark, d), gappy(spark, d)).select("file", "word_ord", "speaker", rounded("confidence", 9).alias("confidence"))


@query("i13_sentence_smoothing", GAPPY + INTERPOLATED + ATTRIBUTED + SMOOTHED + "SELECT file, word_ord, sentence, speaker FROM sw")
def i13(spark, d):
    from voxframe.operators.sequences import interpolate_times

    return attribution.smooth_sentences(attribution.attribute_words(interpolate_times(spoken(spark, d)), gappy(spark, d)), 0.6).select("file", "word_ord", "sentence", "speaker")


@query("i14_fill_turn_text", """SELECT t.file, t.ord, t.speaker, string_agg(w.word, ' ' ORDER BY w.start, w.word_ord) AS text FROM cturns t LEFT JOIN cwords w ON w.file = t.file AND w.speaker = t.speaker AND (w.start + w."end") / 2 >= t.start AND (w.start + w."end") / 2 < t."end" GROUP BY t.file, t.ord, t.speaker""")
def i14(spark, d):
    return attribution.fill_turn_text(derived.spoken_turns(spark, d), derived.spoken_words(spark, d)).select("file", "ord", "speaker", "text")


@query("i15_who_said_what", GAPPY + INTERPOLATED + ATTRIBUTED + SMOOTHED + """SELECT t.file, t.ord, t.speaker, string_agg(w.word, ' ' ORDER BY w.start, w.word_ord) AS text FROM gt t LEFT JOIN sw w ON w.file = t.file AND w.speaker = t.speaker AND (w.start + w."end") / 2 >= t.start AND (w.start + w."end") / 2 < t."end" GROUP BY t.file, t.ord, t.speaker""")
def i15(spark, d):
    return attribution.attribute_and_fill(spoken(spark, d), gappy(spark, d), 0.6)[1].select("file", "ord", "speaker", "text")


CHUNKS = """, cl AS (SELECT file, max("end") AS total FROM cwords GROUP BY file), ck AS (SELECT file, k AS chunk, k * 10.0::DOUBLE AS at, CASE WHEN k > 0 THEN k * 10.0::DOUBLE + 2.5::DOUBLE END AS seam FROM cl, unnest(range(0, CAST(floor(total / 10) AS BIGINT) + 1)) AS x(k)),
said AS (SELECT w.file, c.chunk, w.word_ord, w.word, w.start, w."end" FROM cwords w JOIN ck c ON w.file = c.file AND w.start >= c.at AND w.start < c.at + 15)"""


@query("i16_seam_stitch", CHUNKS + """, b AS (SELECT file, chunk, seam, min(seam) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM ck)
SELECT s.file, s.chunk, s.word_ord, s.word FROM said s JOIN b ON s.file = b.file AND s.chunk = b.chunk WHERE (seam IS NULL OR (s.start + s."end") / 2 >= seam) AND (until IS NULL OR (s.start + s."end") / 2 < until)""")
def i16(spark, d):
    w = derived.spoken_words(spark, d)
    n = w.groupBy("file").agg(F.max("end").alias("total"))
    chunks = n.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 10))).alias("chunk"))
    chunks = chunks.select("file", "chunk", F.when(F.col("chunk") > 0, F.col("chunk") * 10.0 + 2.5).alias("seam"))
    heard = w.withColumn("chunk", F.explode(F.array_distinct(F.array(F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - 5) / 10)), F.floor(F.col("start") / 10)))))
    heard = heard.where((F.col("start") >= F.col("chunk") * 10.0) & (F.col("start") < F.col("chunk") * 10.0 + 15))
    return attribution.stitch_chunks(heard, chunks).select("file", "chunk", "word_ord", "word")


@query("i17_primary_turn", GAPPY + """, r AS (SELECT file, word_ord, start, "end" + 0.5::DOUBLE AS "end" FROM cwords WHERE word_ord % 5 = 0),
x AS (SELECT r.file, r.word_ord, t.speaker, t.ord, t.start <= r.start AND r."end" <= t."end" AS inside, abs((t.start + t."end") / 2 - (r.start + r."end") / 2) AS away FROM r JOIN gt t ON r.file = t.file)
SELECT file, word_ord AS r_id, speaker FROM x QUALIFY row_number() OVER (PARTITION BY file, word_ord ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE away END, ord) = 1""")
def i17(spark, d):
    r = spoken(spark, d).where("word_ord % 5 = 0").select("file", F.col("word_ord").alias("r_id"), "start", (F.col("end") + 0.5).alias("end"))
    return attribution.primary_turn(r, gappy(spark, d)).select("file", "r_id", "speaker")


@query("i18_turn_confidence", """SELECT t.file, t.ord, round(avg(w.confidence), 9) AS confidence FROM cturns t LEFT JOIN (SELECT *, (word_ord * 37 % 100) / 100.0::DOUBLE AS confidence FROM cwords) w ON w.file = t.file AND w.speaker = t.speaker AND (w.start + w."end") / 2 >= t.start AND (w.start + w."end") / 2 < t."end" GROUP BY t.file, t.ord""")
def i18(spark, d):
    w = derived.spoken_words(spark, d).withColumn("confidence", (F.col("word_ord") * 37 % 100) / 100.0)
    return attribution.turn_confidence(derived.spoken_turns(spark, d), w).select("file", "ord", rounded("confidence", 9).alias("confidence"))


@query("i19_min_duration", 'SELECT file, ord FROM turns WHERE "end" - start >= 20')
def i19(spark, d):
    return attribution.filter_segments(derived.turns(spark, d), 20.0).select("file", "ord")


TOKENS = """, tk AS (SELECT file, word_ord * 2 + k AS ord, CASE WHEN word_ord % 19 = 4 AND k = 0 THEN '<|en|>' WHEN word_ord % 23 = 5 THEN '語' WHEN k = 0 THEN chr(9601) || left(word, 2) ELSE substr(word, 3) END AS token, start + k * 0.03125::DOUBLE AS start FROM cwords, unnest([0, 1]) AS x(k))"""


@query("i20_token_words", TOKENS + """, l AS (SELECT file, max("end") AS length FROM cwords GROUP BY file), b AS (SELECT *, ltrim(token, chr(9601)) AS bare FROM tk WHERE token <> '' AND NOT starts_with(token, '<|')),
f AS (SELECT *, CASE WHEN starts_with(token, chr(9601)) OR bare = '語' OR lag(bare) OVER w IS NULL OR lag(bare) OVER w = '語' THEN 1 ELSE 0 END AS fresh FROM b WHERE bare <> '' WINDOW w AS (PARTITION BY file ORDER BY ord)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) - 1 AS n FROM f),
g AS (SELECT file, CAST(n AS BIGINT) AS word_ord, string_agg(bare, '' ORDER BY ord) AS word, arg_min(start, ord) AS start FROM r GROUP BY file, n)
SELECT g.file, word_ord, word, start, greatest(coalesce(lead(start) OVER (PARTITION BY g.file ORDER BY word_ord), greatest(length, start)), start + 0.05::DOUBLE) AS "end" FROM g JOIN l ON g.file = l.file""")
def i20(spark, d):
    w = spoken(spark, d)
    t = w.select("file", "word_ord", "word", "start", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    token = F.when((F.col("word_ord") % 19 == 4) & (F.col("k") == 0), "<|en|>").when(F.col("word_ord") % 23 == 5, "語").when(F.col("k") == 0, F.concat(F.lit("▁"), F.substring("word", 1, 2))).otherwise(F.substring("word", 3, 100000))
    tokens = t.select("file", (F.col("word_ord") * 2 + F.col("k")).alias("ord"), token.alias("token"), (F.col("start") + F.col("k") * 0.03125).alias("start"))
    return attribution.words_of_tokens(tokens, w.groupBy("file").agg(F.max("end").alias("length")))


def _timecode(x: str, mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', CAST(round({x}*1000) AS BIGINT) // 3600000, CAST(round({x}*1000) AS BIGINT) // 60000 % 60, CAST(round({x}*1000) AS BIGINT) // 1000 % 60, CAST(round({x}*1000) AS BIGINT) % 1000)"


def titled(spark, d):
    t = derived.turns(spark, d)
    return t.withColumn("text", F.when(F.col("ord") % 4 == 0, None).when(F.col("ord") % 4 == 1, "").otherwise(F.concat(F.lit("a < b & c\n--> turn "), F.col("ord").cast("string"))))


SAID = """, said AS (SELECT *, CASE WHEN ord % 4 IN (0, 1) THEN '' ELSE 'a < b & c -- > turn ' || ord END AS t FROM turns)"""


@query("s17_srt", SAID + f"""SELECT file, ord, row_number() OVER (PARTITION BY file ORDER BY ord) || chr(10) || {_timecode('start', ',')} || ' --> ' || {_timecode('"end"', ',')} || chr(10) || {LABEL} || CASE WHEN t <> '' THEN ': ' || t ELSE '' END AS cue FROM said""")
def s17(spark, d):
    return tf.srt_cues(titled(spark, d))


@query("s18_vtt", SAID + f"""SELECT file, ord, {_timecode('start', '.')} || ' --> ' || {_timecode('"end"', '.')} || chr(10) || CASE WHEN t <> '' THEN '<v ' || {LABEL} || '>' || replace(replace(t, '&', '&amp;'), '<', '&lt;') || '</v>' ELSE {LABEL} END AS cue FROM said""")
def s18(spark, d):
    return tf.vtt_cues(titled(spark, d))


@query("s18_vtt_file", SAID + f"""SELECT file, 'WEBVTT' || chr(10) || chr(10) || string_agg({_timecode('start', '.')} || ' --> ' || {_timecode('"end"', '.')} || chr(10) || CASE WHEN t <> '' THEN '<v ' || {LABEL} || '>' || replace(replace(t, '&', '&amp;'), '<', '&lt;') || '</v>' ELSE {LABEL} END || chr(10) || chr(10), '' ORDER BY ord) AS content FROM said GROUP BY file""")
def s18_file(spark, d):
    return tf.documents_of(tf.vtt_cues(titled(spark, d)), "vtt")


@query("s19_txt", SAID + f"""SELECT file, ord, '[' || printf('%.2f', greatest(0, start)) || ' - ' || printf('%.2f', greatest(0, "end")) || '] ' || {LABEL} || CASE WHEN t <> '' THEN ': ' || t ELSE '' END AS line FROM said""")
def s19(spark, d):
    return tf.txt_lines(titled(spark, d))


@query("s7_strict_uem", "SELECT file, CAST(ord AS DOUBLE) AS start, CAST(ord + speaker AS DOUBLE) AS \"end\" FROM turns WHERE speaker > 0")
def s7(spark, d):
    t = derived.turns(spark, d)
    return tf.strict_uem(t.select(F.concat_ws(" ", "file", F.lit("1"), F.col("ord").cast("string"), (F.col("ord") + F.col("speaker")).cast("string")).alias("line")))


@query("s8_id_fallback", """, k AS (SELECT DISTINCT file FROM turns), w AS (SELECT file || CASE WHEN ord % 3 = 0 THEN '' WHEN ord % 3 = 1 THEN '.Mix-Headset' ELSE 'x.y' END AS stem FROM turns WHERE ord < 300)
SELECT stem, coalesce((SELECT file FROM k WHERE file = stem), (SELECT file FROM k WHERE file = split_part(stem, '.', 1))) AS file FROM w""")
def s8(spark, d):
    t = derived.turns(spark, d)
    w = t.where("ord < 300").select(F.concat("file", F.when(F.col("ord") % 3 == 0, "").when(F.col("ord") % 3 == 1, ".Mix-Headset").otherwise("x.y")).alias("stem"))
    return tf.with_fallback(w, t.select("file").distinct())


@query("s9_lenient_rttm", """SELECT file, CAST(printf('%.3f', start) AS DOUBLE) AS start, CAST(printf('%.3f', "end" - start) AS DOUBLE) AS duration, 'SPEAKER_' || lpad(CAST(speaker AS VARCHAR), 2, '0') AS speaker FROM turns WHERE ord % 5 > 1""")
def s9(spark, d):
    lines = tf.rttm_lines(derived.turns(spark, d)).select(F.col("ord").alias("line_no"), F.when(F.col("ord") % 5 == 0, F.lit("SPEAKER broken 1")).when(F.col("ord") % 5 == 1, F.regexp_replace("line", r"^(\S+ \S+ \S+ \S+) \S+", "$1 0.000")).otherwise(F.col("line")).alias("line"))
    return tf.lenient_rttm(lines).select("file", "start", "duration", "speaker")


@query("s16_result_json", """, s AS (SELECT file, string_agg('{"time":{"start":' || start_ms // 1000 || '.0,"end":' || start_ms // 1000 + 2 || '.0},"speaker":' || CASE WHEN ord % 3 = 0 THEN 'null' ELSE speaker::VARCHAR END || ',"confidence":' || CASE WHEN ord % 2 = 0 THEN 'null' ELSE '0.5' END || '}', ',' ORDER BY ord) AS s FROM cv2 GROUP BY file),
t AS (SELECT file, count(DISTINCT speaker) AS n, string_agg('{"speaker":' || speaker || ',"time":{"start":' || start_ms // 1000 || '.0,"end":' || start_ms // 1000 + 2 || '.0}' || CASE WHEN ord % 4 = 1 THEN ',"text":"say \\"x\\""' ELSE '' END || CASE WHEN ord % 3 = 2 THEN ',"stable":false' ELSE '' END || '}', ',' ORDER BY ord) AS t FROM cv2 GROUP BY file)
SELECT s.file, '{"segments":[' || s || '],"turns":[' || t || '],"num_speakers":' || n || ',"schema_version":"diarization-result-v1"}' AS json FROM s JOIN t ON s.file = t.file""")
def s16(spark, d):
    return tf.result_json(*_result_rows(spark, d))


def _result_rows(spark, d):
    t = derived.spoken_turns(spark, d).withColumn("start", F.floor("start").cast("double")).withColumn("end", F.col("start") + 2)
    segments = t.select("file", "ord", "start", "end", F.when(F.col("ord") % 3 != 0, F.col("speaker")).alias("speaker"), F.when(F.col("ord") % 2 != 0, 0.5).alias("confidence"))
    turns = t.select("file", "ord", "start", "end", "speaker", F.when(F.col("ord") % 4 == 1, 'say "x"').alias("text"), (F.col("ord") % 3 != 2).alias("stable"))
    return segments, turns


@query("s16_result_parse", """, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) - 1 AS n FROM cv2) SELECT file, n AS ord, speaker, (start_ms // 1000)::DOUBLE AS start, (start_ms // 1000 + 2)::DOUBLE AS "end", CASE WHEN ord % 4 = 1 THEN 'say "x"' END AS text, ord % 3 <> 2 AS stable FROM o""")
def s16_parse(spark, d):
    return tf.parse_result(tf.result_json(*_result_rows(spark, d)))


@query("s20_annotations", """SELECT file, start AS start_time, 'SPEAKER ' || file || ' 1 ' || printf('%.3f', start) || ' ' || printf('%.3f', "end" - start) || ' <NA> <NA> Spk_' || speaker || ' <NA> <NA>' AS line FROM turns WHERE ord % 6 <> 0""")
def s20(spark, d):
    t = derived.turns(spark, d).select("file", F.col("start").alias("start_time"), F.when(F.col("ord") % 6 == 0, F.col("start") + 0.0005).otherwise(F.col("end")).alias("end_time"), F.concat(F.lit("Spk "), F.col("speaker").cast("string")).alias("speaker_id"))
    return tf.rttm_of_annotations(t)


@query("s21_manifest", """, b AS (SELECT DISTINCT file AS id FROM turns WHERE ord % 7 = 0 INTERSECT SELECT DISTINCT file FROM hyp WHERE ord % 5 = 1) SELECT row_number() OVER (ORDER BY id) - 1 AS place, id FROM b""")
def s21(spark, d):
    return tf.manifest(derived.turns(spark, d).where("ord % 7 = 0").select(F.col("file").alias("id")), derived.hypothesis(spark, d).where("ord % 5 = 1").select(F.col("file").alias("id")))
