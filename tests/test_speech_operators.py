"""Hand-computed cases of scoring, attribution and overlaps, and random ones against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxframe.functions.turns import end_frame, first_frame
from voxframe.operators import attribution, intervals, scoring, sequences
from voxframe.sources import text_formats


def turns(spark, rows):
    df = spark.createDataFrame([("f", i, s, float(a), float(b)) for i, (s, a, b) in enumerate(rows)], "file string, ord long, speaker long, start double, end double")
    return df.withColumn("sf", first_frame(F.col("start"))).withColumn("ef", end_frame(F.col("end")))


def test_odd_scores_are_zero(spark):
    ref, hyp = turns(spark, [(0, 1, 2)]), turns(spark, [(0, 1, 2)])
    for row in (scoring.der(ref, hyp, 60.0), scoring.der(ref, hyp, -1.0), scoring.der(ref, turns(spark, [(0, 0, float("inf"))])), scoring.der(ref.where("speaker > 5"), hyp)):
        assert [tuple(r)[1:] for r in row.collect()] == [(0, 0, 0, 0, 0.0)]


def test_half_of_a_file_is_scored(spark):
    uem = spark.createDataFrame([("f", 0.0, 5.0)], "file string, start double, end double")
    row = scoring.der(turns(spark, [(0, 0, 10)]), turns(spark, [(0, 0, 10)]).where("speaker > 5"), 0.0, uem).collect()[0]
    assert (row["ref_frames"], row["miss"], row["der"]) == (500, 500, 1.0)


def test_decomposition_and_recall(spark):
    ref, hyp = turns(spark, [(0, 0, 6), (1, 3, 6)]), turns(spark, [(0, 0, 6)])
    got = {r["region"]: r["der"] for r in scoring.decomposition(ref, hyp).collect()}
    assert got["total"] == pytest.approx(1 / 3) and got["single"] == 0 and got["overlap"] == 0.5
    assert {r["speaker"]: r["recall"] for r in scoring.speaker_recall(ref, hyp).collect()} == {0: 1.0, 1: 0.0}


def loop_der(ref, hyp, collar):
    """Counts frame by frame, without a mapping."""
    def grid(x, up):
        import math

        return math.ceil(x / 0.01) if up else int(max(0.0, x) / 0.01)

    n = max(grid(b, True) for _, _, b in [*ref, *hyp]) + 1
    masked, on = [False] * n, [[set() for _ in range(n)] for _ in range(2)]
    for side, rows in enumerate((ref, hyp)):
        for s, a, b in rows:
            for i in range(grid(a, False), min(n, grid(b, True))):
                on[side][i].add(s)
    for _, a, b in ref:
        for x in (a, b):
            for i in range(grid(x - collar, False), min(n, grid(x + collar, True))):
                masked[i] = masked[i] or collar > 0
    r, h = ([len(x) for x in side] for side in on)
    keep = [i for i in range(n) if not masked[i]]
    return sum(r[i] for i in keep), sum(max(0, r[i] - h[i]) for i in keep), sum(max(0, h[i] - r[i]) for i in keep)


def test_counts_equal_a_loop_over_frames(spark):
    r = random.Random(2)
    for collar in (0.0, 0.25):
        for _ in range(3):
            ref, hyp = ([(r.randrange(3), a := round(r.uniform(0, 20), 3), round(a + r.uniform(0.1, 5), 3)) for _ in range(10)] for _ in range(2))
            row = scoring.frame_counts(turns(spark, ref), turns(spark, hyp), collar).collect()[0]
            assert (row["ref_frames"], row["miss"], row["fa"]) == loop_der(ref, hyp, collar)


def test_equal_error_rate(spark):
    def eer(rows):
        return scoring.equal_error_rate(spark.createDataFrame(rows, "score double, same boolean")).collect()[0]["eer"]

    assert eer([(0.9, True), (0.8, True), (0.2, False), (0.1, False)]) == 0.0
    assert eer([(0.9, True)]) == 1.0 and eer([]) == 1.0
    assert eer([(0.1, True), (0.9, True), (0.2, False), (0.8, False)]) == 50.0


def test_overlaps_of_three(spark):
    got = attribution.overlap_regions(turns(spark, [(0, 0, 3), (1, 1, 3), (2, 2, 4)])).orderBy("start").collect()
    assert [(r["start"], r["end"], r["speakers"]) for r in got] == [(1.0, 2.0, [0, 1]), (2.0, 3.0, [0, 1, 2])]
    assert attribution.overlap_regions(turns(spark, [(0, 0, 3), (1, 1, 1)])).count() == 0


def test_attribution_equals_a_scan(spark):
    r = random.Random(4)
    t = [(r.randrange(4), a := round(r.uniform(0, 30), 2), round(a + r.uniform(0.1, 3), 2)) for _ in range(12)]
    words = [("f", i, a := round(r.uniform(0, 40), 2), round(a + r.uniform(0, 1), 2), "w", 0.5) for i in range(80)]
    rows = attribution.attribute_words(spark.createDataFrame(words, "file string, word_ord long, start double, end double, word string, confidence double"), turns(spark, t)).collect()
    for row in rows:
        _, _, a, b, _, _ = words[row["word_ord"]]
        shared = [max(0.0, min(b, e) - max(a, s)) for _, s, e in t]
        gaps = [max(0.0, max(a, s) - min(b, e)) for _, s, e in t]
        best = min(range(len(t)), key=lambda i: ((-shared[i]) if max(shared) > 0 else gaps[i], t[i][0], i))
        assert row["speaker"] == t[best][0]
        assert row["confidence"] == pytest.approx(0.5 * min(1, shared[best] / (b - a)) if max(shared) > 0 else 0.5)


def test_result_files(spark):
    t = turns(spark, [(0, 0, 1.5), (11, 2, 3)]).withColumn("text", F.when(F.col("ord") == 0, "a\r\nb --> c"))
    files = {k: text_formats.documents_of(f(t), k).collect()[0]["content"] for k, f in (("srt", text_formats.srt_cues), ("vtt", text_formats.vtt_cues), ("txt", text_formats.txt_lines))}
    assert files["srt"] == "1\n00:00:00,000 --> 00:00:01,500\nSPEAKER_00: a b -- > c\n\n2\n00:00:02,000 --> 00:00:03,000\nSPEAKER_11\n\n"
    assert files["vtt"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v SPEAKER_00>a b -- > c</v>\n\n")
    assert files["txt"] == "[0.00 - 1.50] SPEAKER_00: a b -- > c\n[2.00 - 3.00] SPEAKER_11\n"
    with pytest.raises(ValueError):
        text_formats.remap_speakers(t, spark.createDataFrame([(0, 1), (0, 2)], "old long, new long"))
    with pytest.raises(ValueError):
        text_formats.strict_uem(spark.createDataFrame([("; nothing",)], "line string"))


def test_word_pairs_with_equal_distances_take_the_first_place(spark):
    kind = "file string, word_ord long, word string, start double, end double, speaker long"
    far, near = 10.004, 10.004000000000001  # as far from 100.0 in double precision
    assert far < near and 100.0 - far == 100.0 - near
    ref = spark.createDataFrame([("f", 0, "a", 100.0, 100.0, 0)], kind)
    for words, expected in (((far, near), [7]), ((near, far), [7]), ((near, far, 190.5), [7])):
        hyp = spark.createDataFrame([("f", i, "A", m, m, 7 + i) for i, m in enumerate(words)] + [("f", 9, "b", 100.0, 100.0, 3)], kind)
        assert [r["hyp_speaker"] for r in scoring.word_pairs(ref, hyp).collect()] == expected


def test_word_pairs_equal_a_scan(spark):
    r = random.Random(8)
    kind = "file string, word_ord long, word string, start double, end double, speaker long"
    rows = [[(str(f), i, r.choice("ab"), a := r.randrange(0, 60) / 10 + 0.004 * r.randrange(3), a + r.randrange(0, 4) / 10, r.choice([0, 1, None])) for f in range(6) for i in range(n)] for n in (30, 26)]
    ref, hyp = rows
    expected = {}
    for f, i, w, a, b, s in ref:
        if s is not None:
            met = [(abs((a + b) / 2 - (c + d) / 2), j, t) for g, j, v, c, d, t in hyp if (g, v) == (f, w)]
            expected[f, i] = (s, min(met, key=lambda m: m[:2])[2] if met else None)
    got = scoring.word_pairs(spark.createDataFrame(ref, kind), spark.createDataFrame(hyp, kind)).collect()
    assert {(x["file"], x["word_ord"]): (x["ref_speaker"], x["hyp_speaker"]) for x in got} == expected and len(got) == len(expected)


def test_speaker_at_does_not_hang_on_the_order_of_rows(spark):
    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1)

    points = spark.createDataFrame([("f", float(i % 40)) for i in range(200)], "file string, at double").repartition(1).mapInPandas(shuffled, "file string, at double")
    t = turns(spark, [(i, i, i + 0.5) for i in range(0, 40, 2)])
    got = attribution.speaker_at(points, t).collect()
    assert sorted((r["at"], r["speaker"]) for r in got if r["speaker"] is not None) == sorted((float(i % 40), i % 40) for i in range(200) if i % 2 == 0) and len(got) == 200


def test_crowded_turns_equal_a_scan(spark):
    """Many turns at once: the timeline and clean seconds against loops, and rows that follow the turns, not their pairs."""
    r = random.Random(9)
    rows = [(r.randrange(5), a := r.randrange(0, 7_000_000) / 1000, a + r.randrange(250, 900_000) / 1000) for _ in range(300)]
    t = turns(spark, rows)
    frames = [(int(x[1]), int(x[2])) for x in t.orderBy("ord").select("ord", "sf", "ef").collect()]
    cuts = sorted({x for f in frames for x in f})
    expected = []
    for a, b in zip(cuts, cuts[1:]):
        on = [(s - e, who, i) for i, ((who, s, e), (x, y)) in enumerate(zip(rows, frames)) if x <= a and b <= y]
        if on and expected and expected[-1][0] == min(on)[1] and expected[-1][2] == a:
            expected[-1][2] = b
        elif on:
            expected.append([min(on)[1], a, b])
    assert sorted((x["a"], x["b"], x["speaker"]) for x in sequences.exclusive_timeline(t).collect()) == [(a, b, s) for s, a, b in expected]
    held, over = t.where("ord % 4 <> 0"), t.where("ord % 4 = 0")
    got = {x["ord"]: x["clean"] for x in attribution.clean_seconds(held, over).collect()}
    assert len(got) == 225
    for i, clean in got.items():
        _, s, e = rows[i]
        done, at = 0.0, s
        for a, b in sorted((a, b) for j, (_, a, b) in enumerate(rows) if j % 4 == 0):
            if b > at and a < e:
                done, at = done + min(b, e) - max(a, at), max(at, min(b, e))
        assert clean == pytest.approx(max(0.0, e - s - done), abs=1e-9)


def most_rows_of_joins(df):
    """The largest number of rows that a join of the executed plan gave."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
        for inner in ("executedPlan", "plan"):
            if (inner == "executedPlan" and p.nodeName() == "AdaptiveSparkPlan") or (inner == "plan" and "QueryStage" in p.nodeName()):
                todo.append(getattr(p, inner)())
    return max(found, default=0)


def test_joins_follow_the_number_of_turns(spark):
    t = turns(spark, [(i % 5, (i % 7) / 100, 40 + i / 100) for i in range(400)])
    assert most_rows_of_joins(sequences.exclusive_timeline(t)) <= 800
    assert most_rows_of_joins(attribution.clean_seconds(t.where("ord % 4 <> 0"), t.where("ord % 4 = 0"))) <= 800


def test_overlapping_pairs_shuffle_the_turns_once(spark):
    r = random.Random(10)
    rows = [(r.randrange(4), a := r.randrange(0, 400_000) / 1000, a + r.randrange(250, 150_000) / 1000) for _ in range(120)]
    df = intervals.overlapping_pairs(turns(spark, rows))
    got = {(x["ord"], x["ord2"]): x["shared"] for x in df.collect()}
    expected = {(i, j): min(rows[i][2], rows[j][2]) - max(rows[i][1], rows[j][1]) for j in range(120) for i in range(j) if rows[i][0] != rows[j][0]}
    assert got == {k: v for k, v in expected.items() if v > 0} and df.count() == len(got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = intervals.overlapping_pairs(turns(spark, rows))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan and plan.count("SortMergeJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_window_looks_ahead_to_the_end(spark):
    """Frames up to the end of a partition are read anew for each row; what comes after is found in falling order."""
    t = turns(spark, [(i % 3, i, i + 0.4) for i in range(20)])
    words = spark.createDataFrame([("f", i, "w.", i / 2, i / 2 + 0.1 * (i % 3), 0.5) for i in range(60)], "file string, word_ord long, word string, start double, end double, confidence double")
    seams = spark.createDataFrame([("f", i, i * 4.0) for i in range(5)], "file string, chunk int, seam double")
    for df in (attribution.attribute_and_fill(words, t)[1], attribution.stitch_chunks(words.withColumn("chunk", F.lit(1)), seams), scoring.word_pairs(words.withColumn("speaker", F.lit(1).cast("long")), words.withColumn("speaker", F.lit(1).cast("long")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "windowframe" in plan and not re.search(r"(?<!unboundedpreceding\$\(\), )unboundedfollowing", plan)
