"""Hand-computed cases of the sequence operators, and random gates against a plain loop."""

import random

from voxframe.operators import sequences


def test_hysteresis_equals_a_loop(spark):
    r = random.Random(3)
    rows, expected = [], {}
    for f in range(20):
        state = False
        for i in range(60):
            p = float("nan") if r.random() < 0.05 else r.random()
            state = p >= 0.4 if state else p >= 0.7
            rows.append((str(f), i, p))
            expected[str(f), i] = state
    got = sequences.hysteresis(spark.createDataFrame(rows, "file string, frame long, prob double"), 0.7, 0.4).collect()
    assert {(x["file"], x["frame"]): x["active"] for x in got} == expected


def test_interpolated_times(spark):
    rows = [("f", 0, 1.0, 1.0), ("f", 1, 2.0, 3.0), ("f", 2, 9.0, 9.0), ("f", 3, 4.0, 5.0), ("f", 4, float("nan"), 1.0), ("g", 0, 1.0, 0.0)]
    got = {(x["file"], x["word_ord"]): (round(x["start"], 6), round(x["end"], 6), x["interpolated"]) for x in sequences.interpolate_times(spark.createDataFrame(rows, "file string, word_ord long, start double, end double")).collect()}
    assert got == {("f", 0): (1.999, 2.0, True), ("f", 1): (2.0, 3.0, False), ("f", 2): (3.0, 4.0, True), ("f", 3): (4.0, 5.0, False), ("f", 4): (5.0, 5.001, True), ("g", 0): (0.0, 0.001, True)}


def test_majority_ties_go_to_the_smaller_id(spark):
    rows = [("f", 0, 2, 1.0), ("f", 0, 1, 1.0), ("f", 1, 3, 0.0), ("f", 2, 5, 0.5), ("f", 2, 4, 0.7)]
    got = sequences.majority_map(spark.createDataFrame(rows, "file string, local long, global_id long, seconds double")).collect()
    assert {(x["local"], x["global_id"]) for x in got} == {(0, 1), (2, 4)}
