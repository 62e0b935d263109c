"""Readers and writers of turn annotations as lines of text, on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.turns import cue_text, speaker_label, timecode, vtt_text

RTTM_FIELDS = 9


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), line of every text file; whole files, so that numbers are stable."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def parse_rttm(lines: DataFrame, strict: bool = True) -> DataFrame:
    """file, start, duration, speaker of SPEAKER lines (columns line_no, line). Strict: a bad line is an error; else it is left out."""
    rows = lines.where("trim(line) <> '' and not startswith(trim(line), ';')")

    def fields(f: Column) -> Column:
        return F.struct(F.size(f).alias("n"), F.get(f, F.lit(0)).alias("kind"), F.get(f, F.lit(1)).alias("file"), F.get(f, F.lit(3)).try_cast("double").alias("start"), F.get(f, F.lit(4)).try_cast("double").alias("length"), F.get(f, F.lit(7)).alias("speaker"))

    # Fields are split once for each line: what is exploded is computed before anything that uses it.
    rows = rows.select(*[c for c in lines.columns if c in ("path", "line_no")], F.explode(F.array(F.split(F.trim("line"), r"\s+"))).alias("f")).select("*", F.explode(F.array(fields(F.col("f")))).alias("x")).drop("f")
    number_ok = F.coalesce((F.col("x.start") >= 0) & (F.col("x.length") >= 0) & (F.col("x.start") + F.col("x.length") < float("inf")), F.lit(False))
    good = (F.col("x.n") >= RTTM_FIELDS) & ((F.col("x.kind") != "SPEAKER") | number_ok)
    kept = [c for c in rows.columns if c != "x"]
    if strict:
        bad = F.raise_error(F.concat(F.lit("bad RTTM line "), F.col("line_no").cast("string")))
        rows = rows.withColumn("kind", F.when(good, F.col("x.kind")).otherwise(bad.cast("string")))
    else:
        rows = rows.where(good).withColumn("kind", F.col("x.kind"))
    return rows.where("kind = 'SPEAKER'").select(*kept, "x.file", "x.start", F.col("x.length").alias("duration"), "x.speaker")


def dense_speaker_ids(segments: DataFrame) -> DataFrame:
    """file, ord, speaker -> also speaker_id: dense numbers in the order of first appearance in the file."""
    first = segments.groupBy("file", "speaker").agg(F.min("ord").alias("first_ord")).withColumn("speaker_id", F.row_number().over(Window.partitionBy("file").orderBy("first_ord")) - 1)
    f = first.select(F.col("file").alias("ff"), F.col("speaker").alias("fs"), "speaker_id")
    return segments.join(f, (F.col("file") == F.col("ff")) & (F.col("speaker") == F.col("fs"))).drop("ff", "fs")


def rttm_lines(turns: DataFrame) -> DataFrame:
    """file, ord, line in RTTM for turns (file, ord, speaker, start, end)."""
    three = lambda c: F.replace(F.call_function("format_number", c, F.lit("0.000")), F.lit(","), F.lit(""))
    line = F.concat(F.lit("SPEAKER "), F.col("file"), F.lit(" 1 "), three(F.col("start")), F.lit(" "), three(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))), F.lit(" <NA> <NA> "), speaker_label(F.col("speaker")), F.lit(" <NA> <NA>"))
    return turns.select("file", "ord", line.alias("line"))


def parse_uem(lines: DataFrame) -> DataFrame:
    """file, start, end of the scored regions; lines that don't parse are left out."""
    f = lines.where("trim(line) <> '' and substring(trim(line), 1, 1) not in (';', '#')").withColumn("f", F.split(F.trim("line"), r"\s+"))
    f = f.select(F.get("f", F.lit(0)).alias("file"), F.expr("try_cast(get(f, 2) as double)").alias("start"), F.expr("try_cast(get(f, 3) as double)").alias("end"))
    return f.where((F.col("end") > F.col("start")) & (F.abs("start") < float("inf")) & (F.abs("end") < float("inf")))


def two_or_three(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value."""
    return F.replace(F.call_function("format_number", x, F.lit("0." + "0" * digits)), F.lit(","), F.lit(""))


def cue_label(turn_text: Column, speaker: Column) -> Column:
    """SPEAKER_NN: text, or the bare label without a text."""
    label = speaker_label(speaker)
    return F.when(F.coalesce(turn_text, F.lit("")) != "", F.concat(label, F.lit(": "), cue_text(turn_text))).otherwise(label)


def srt_cues(turns: DataFrame) -> DataFrame:
    """file, ord, cue: numbered SRT cues of turns (text may be null)."""
    n = F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("string")
    return turns.select("file", "ord", F.concat(n, F.lit("\n"), timecode(F.col("start"), ","), F.lit(" --> "), timecode(F.col("end"), ","), F.lit("\n"), cue_label(F.col("text"), F.col("speaker"))).alias("cue"))


def vtt_cues(turns: DataFrame) -> DataFrame:
    """file, ord, cue: WebVTT cues with a voice span, or the bare label without a text."""
    label = speaker_label(F.col("speaker"))
    payload = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("<v "), label, F.lit(">"), vtt_text(F.col("text")), F.lit("</v>"))).otherwise(label)
    return turns.select("file", "ord", F.concat(timecode(F.col("start")), F.lit(" --> "), timecode(F.col("end")), F.lit("\n"), payload).alias("cue"))


def txt_lines(turns: DataFrame) -> DataFrame:
    """file, ord, line: [start - end] SPEAKER_NN: text."""
    at = lambda c: two_or_three(F.greatest(F.lit(0.0), F.col(c)), 2)
    return turns.select("file", "ord", F.concat(F.lit("["), at("start"), F.lit(" - "), at("end"), F.lit("] "), cue_label(F.col("text"), F.col("speaker"))).alias("line"))


def documents_of(cues: DataFrame, kind: str) -> DataFrame:
    """file, content: the whole SRT, VTT, TXT or RTTM file of each recording (columns file, ord and cue or line)."""
    if kind not in ("srt", "vtt", "txt", "rttm"):
        raise ValueError("the kind is srt, vtt, txt or rttm")
    part, mark = ("line", "\n") if kind in ("txt", "rttm") else ("cue", "\n\n")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", part))), lambda x: F.concat(x[part], F.lit(mark)))
    return cues.groupBy("file").agg(F.concat(F.lit("WEBVTT\n\n" if kind == "vtt" else ""), F.array_join(parts, "")).alias("content"))


def strict_uem(lines: DataFrame) -> DataFrame:
    """parse_uem, which fails where no line gives a region."""
    found = parse_uem(lines)
    if found.isEmpty():
        raise ValueError("the UEM has no scored region")
    return found


def with_fallback(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """stem, file: the known file (column file) of each stem, or the one named by its part before the first dot; else null."""
    exact = known.select(F.col("file").alias("exact")).distinct()
    prefix = known.select(F.col("file").alias("prefix")).distinct()
    met = wanted.join(exact, F.col("stem") == F.col("exact"), "left").join(prefix, F.substring_index("stem", ".", 1) == F.col("prefix"), "left")
    return met.select("stem", F.coalesce("exact", "prefix").alias("file"))


def lenient_rttm(lines: DataFrame) -> DataFrame:
    """parse_rttm without errors, and without rows of no length; lines may come from one file a recording or from one for all."""
    return parse_rttm(lines, strict=False).where("duration > 0")


def rttm_of_annotations(segments: DataFrame) -> DataFrame:
    """file, line in RTTM from annotations (file, start_time, end_time, speaker_id): under 1 ms left out, spaces in names underlined."""
    length = F.col("end_time") - F.col("start_time")
    line = F.concat(F.lit("SPEAKER "), F.col("file"), F.lit(" 1 "), two_or_three(F.col("start_time"), 3), F.lit(" "), two_or_three(length, 3), F.lit(" <NA> <NA> "), F.replace("speaker_id", F.lit(" "), F.lit("_")), F.lit(" <NA> <NA>"))
    return segments.where(length >= 0.001).select("file", "start_time", line.alias("line"))


def manifest(audio: DataFrame, references: DataFrame) -> DataFrame:
    """place, id of the recordings that have both, in order."""
    both = audio.select("id").intersect(references.select("id"))
    return both.select((F.row_number().over(Window.orderBy("id")) - 1).alias("place"), "id")


def audio_files(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """path, length of the WAV files of a folder, in order, the first so many of them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").load(path).select("path", "length").orderBy("path")
    return found if first is None else found.limit(first)


def remap_speakers(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """rows with the speakers (old, new) renamed; unknown ones stay. A repeated old id is an error."""
    if remap.groupBy("old").count().where("count > 1").limit(1).count():
        raise ValueError("an old id occurs twice")
    return rows.join(remap.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col("speaker") == F.col("_old"), "left").withColumn("speaker", F.coalesce("_new", "speaker")).drop("_old", "_new")


SEGMENT = "struct<time:struct<start:double,end:double>,speaker:bigint,confidence:double>"
TURN = "struct<speaker:bigint,time:struct<start:double,end:double>,text:string,stable:boolean>"
RESULT = f"struct<segments:array<{SEGMENT}>,turns:array<{TURN}>,num_speakers:int,schema_version:string,speakers:array<struct<label:string,id:bigint,total_speech_s:double,turn_count:bigint>>,exclusive_turns:array<{TURN}>>"


def result_json(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """file, json: the result of each recording. Of segments, a null speaker or confidence is written; of turns, a null text and stable = true are left out."""
    time = F.struct("start", "end")
    s = segments.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(time.alias("time"), "speaker", "confidence"), {"ignoreNullFields": "false"}).alias("j")))).alias("s"))
    turn = F.to_json(F.struct("speaker", time.alias("time"), "text", F.when(F.col("stable"), None).otherwise(F.col("stable")).alias("stable")))
    t = turns.groupBy(F.col("file").alias("tf")).agg(F.array_sort(F.collect_list(F.struct("ord", turn.alias("j")))).alias("t"), F.countDistinct("speaker").alias("n"))
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(c, lambda x: x["j"]), ","), F.lit("")), F.lit("]"))
    both = s.join(t, F.col("file") == F.col("tf"), "full")
    text = F.concat(F.lit('{"segments":'), listed(F.col("s")), F.lit(',"turns":'), listed(F.col("t")), F.lit(',"num_speakers":'), F.coalesce("n", F.lit(0)).cast("string"), F.lit(',"schema_version":"diarization-result-v1"}'))
    return both.select(F.coalesce("file", "tf").alias("file"), text.alias("json"))


def parse_result(results: DataFrame) -> DataFrame:
    """file, ord, speaker, start, end, text, stable: the turns of each result (file, json); a missing stable counts as true."""
    parsed = results.select("file", F.posexplode(F.from_json("json", RESULT)["turns"]).alias("ord", "t"))
    return parsed.select("file", F.col("ord").cast("long").alias("ord"), "t.speaker", "t.time.start", "t.time.end", "t.text", F.coalesce("t.stable", F.lit(True)).alias("stable"))
