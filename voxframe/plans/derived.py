"""Turns, words and vectors derived from the stored tables, in whole milliseconds first."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.turns import end_frame, first_frame

#: The same derivations in DuckDB SQL, to stand before a query.
SQL = r"""
WITH RECURSIVE ev AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS file, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS start_ms,
                   greatest(250, CAST(round(value * 1000) AS BIGINT)) AS dur_ms FROM events),
turns AS (SELECT file, event_id AS ord, user_id % 8 AS speaker, start_ms / 1000.0::DOUBLE AS start, (start_ms + dur_ms) / 1000.0::DOUBLE AS "end",
                 CAST(floor(least(8640000, start_ms / 1000.0::DOUBLE / 0.01::DOUBLE)) AS BIGINT) AS sf, CAST(ceil(least(8640000, (start_ms + dur_ms) / 1000.0::DOUBLE / 0.01::DOUBLE)) AS BIGINT) AS ef FROM ev),
hyp0 AS (SELECT *, greatest(0, start_ms + (event_id % 7 - 3) * 50) AS s_ms FROM ev WHERE event_id % 11 <> 0),
hyp AS (SELECT file, event_id AS ord, ((user_id * 5 + 3) % 8) % 6 AS speaker, s_ms / 1000.0::DOUBLE AS start, (s_ms + dur_ms) / 1000.0::DOUBLE AS "end",
               CAST(floor(least(8640000, s_ms / 1000.0::DOUBLE / 0.01::DOUBLE)) AS BIGINT) AS sf, CAST(ceil(least(8640000, (s_ms + dur_ms) / 1000.0::DOUBLE / 0.01::DOUBLE)) AS BIGINT) AS ef FROM hyp0),
uem AS (SELECT file, (k * 7200)::DOUBLE AS start, (k * 7200 + 3600)::DOUBLE + 0.013 AS "end" FROM (SELECT DISTINCT file FROM turns), unnest(range(0, 12)) AS x(k)),
cv0 AS (SELECT conv_id::VARCHAR AS file, turn AS ord, role, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS texts FROM conversations),
cv1 AS (SELECT *, greatest(250, 60 * len(texts))::BIGINT AS dur_ms FROM cv0),
cv2 AS (SELECT file, ord, dense_rank() OVER (PARTITION BY file ORDER BY role) - 1 AS speaker, dur_ms, texts,
               greatest(0, coalesce(sum(dur_ms - 100) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_ms,
               coalesce(sum(len(texts)) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM cv1),
cturns AS (SELECT file, ord, speaker, start_ms / 1000.0::DOUBLE AS start, (start_ms + dur_ms) / 1000.0::DOUBLE AS "end" FROM cv2),
cwords AS (SELECT file, done + k AS word_ord, texts[k + 1] AS word, speaker, (start_ms + k * dur_ms // len(texts)) / 1000.0::DOUBLE AS start,
                  (CASE WHEN (done + k) % 13 = 12 THEN start_ms + k * dur_ms // len(texts) ELSE start_ms + (k + 1) * dur_ms // len(texts) END) / 1000.0::DOUBLE AS "end"
           FROM cv2, unnest(range(0, len(texts))) AS x(k))
"""


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    ts = F.col("ts").cast("timestamp")
    since = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(cast(to_date(ts) as timestamp))) div 1000")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.date_format(ts, "yyyy-MM-dd").alias("file"), since.alias("start_ms"), F.greatest(F.lit(250), F.round(F.col("value") * 1000).cast("long")).alias("dur_ms"))


def _framed(df: DataFrame) -> DataFrame:
    return df.withColumn("sf", first_frame(F.col("start"))).withColumn("ef", end_frame(F.col("end")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (a day), ord, speaker, start, end, sf, ef."""
    ev = _events(spark, sf_dir)
    return _framed(ev.select("file", F.col("event_id").alias("ord"), (F.col("user_id") % 8).alias("speaker"), (F.col("start_ms") / 1000.0).alias("start"), ((F.col("start_ms") + F.col("dur_ms")) / 1000.0).alias("end")))


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with some left out, some speakers confused and the times shifted."""
    ev = _events(spark, sf_dir).where("event_id % 11 <> 0").withColumn("s", F.greatest(F.lit(0), F.col("start_ms") + (F.col("event_id") % 7 - 3) * 50))
    return _framed(ev.select("file", F.col("event_id").alias("ord"), ((F.col("user_id") * 5 + 3) % 8 % 6).alias("speaker"), (F.col("s") / 1000.0).alias("start"), ((F.col("s") + F.col("dur_ms")) / 1000.0).alias("end")))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, total: the whole length of each day in frames."""
    return turns(spark, sf_dir).groupBy("file").agg(F.max("ef").alias("total"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (a conversation), ord, speaker, start_ms, dur_ms, start, end, texts (its words): 60 ms a word, 250 at least; turns overlap by 100 ms."""
    importable(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), "role", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("texts"))
    rows = rows.withColumn("dur_ms", F.greatest(F.lit(250), 60 * F.size("texts")).cast("long"))
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.lit(0), F.coalesce(F.sum(F.col("dur_ms") - 100).over(before), F.lit(0))).cast("long")
    rows = rows.withColumn("start_ms", start).withColumn("speaker", F.dense_rank().over(Window.partitionBy("file").orderBy("role")).cast("long") - 1)
    return rows.select("file", "ord", "speaker", "start_ms", "dur_ms", (F.col("start_ms") / 1000.0).alias("start"), ((F.col("start_ms") + F.col("dur_ms")) / 1000.0).alias("end"), "texts")


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, word_ord, start, end, word, speaker (who truly said it): every word of every conversation, in even slots of its turn; each 13th has no length."""
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    t = conversation_turns(spark, sf_dir).withColumn("n", F.size("texts").cast("long")).withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0)))
    w = t.select("file", "speaker", "start_ms", "dur_ms", "n", "done", F.posexplode("texts").alias("k", "word")).withColumn("word_ord", F.col("done") + F.col("k"))
    at = F.expr("start_ms + k * dur_ms div n")
    after = F.when(F.col("word_ord") % 13 == 12, at).otherwise(F.expr("start_ms + (k + 1) * dur_ms div n"))
    return w.select("file", "word_ord", (at / 1000.0).alias("start"), (after / 1000.0).alias("end"), "word", "speaker")


def scored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, start, end: the first hour of every two of each day, and 13 ms more."""
    days = turns(spark, sf_dir).select("file").distinct()
    at = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")
    return days.select("file", at).select("file", (F.col("k") * 7200).cast("double").alias("start"), ((F.col("k") * 7200 + 3600).cast("double") + 0.013).alias("end"))


def spoken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns with the file as text, and no words."""
    return _framed(conversation_turns(spark, sf_dir).drop("texts", "start_ms", "dur_ms").withColumn("file", F.col("file").cast("string")))


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' words with the file as text."""
    return conversation_words(spark, sf_dir).select(F.col("file").cast("string").alias("file"), "word_ord", "word", "start", "end", "speaker")
