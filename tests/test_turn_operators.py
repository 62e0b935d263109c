"""The turn-analytics operators on hand-computed cases, and every query against DuckDB."""

import os
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.turns import rounded, simple_upper
from voxframe.operators import intervals, scoring
from voxframe.plans.registry import ORACLES, QUERIES
from voxframe.sources import text_formats

DATA = "/root/testdata/sf0.001"


def turns(spark, rows):
    """rows: speaker, start, end; all in one file."""
    df = spark.createDataFrame([("f", i, s, float(a), float(b)) for i, (s, a, b) in enumerate(rows)], "file string, ord long, speaker long, start double, end double")
    return df.withColumn("sf", F.floor(F.col("start") * 100)).withColumn("ef", F.ceil(F.col("end") * 100))


@pytest.mark.parametrize(
    "ref, hyp, expected",
    [
        ([(0, 0, 2), (1, 2, 4)], [(5, 0, 3), (7, 3, 5)], (400, 0, 100, 100, 0.5)),
        ([(0, 0, 2)], [(0, 0, 2), (1, 0, 2)], (200, 0, 200, 0, 1.0)),
        ([(0, 0, 6), (1, 3, 6)], [(0, 0, 6)], (900, 300, 0, 0, 1 / 3)),
    ],
)
def test_der(spark, ref, hyp, expected):
    row = scoring.der(turns(spark, ref), turns(spark, hyp)).collect()[0]
    assert (row["ref_frames"], row["miss"], row["fa"], row["confusion"]) == expected[:4]
    assert row["der"] == pytest.approx(expected[4])


def test_assignment_is_best():
    assert scoring.best_assignment(np.array([[10.0, 9.0], [8.0, 0.0]])) == [1, 0]
    r = np.random.default_rng(0)
    for _ in range(100):
        gain = r.integers(0, 9, (r.integers(1, 5), r.integers(1, 5))).astype(float)
        n = max(gain.shape)
        square = np.zeros((n, n))
        square[: gain.shape[0], : gain.shape[1]] = gain
        best = max(sum(square[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        chosen = scoring.best_assignment(gain)
        assert sum(gain[i, j] for i, j in enumerate(chosen) if j >= 0) == best
        assert len([j for j in chosen if j >= 0]) == len({j for j in chosen if j >= 0})


def test_merging(spark):
    t = turns(spark, [(0, 0, 1), (1, 1, 2), (1, 2.5, 3), (1, 2, 2.2)])
    assert [(r["speaker"], r["start"], r["end"], r["n_merged"]) for r in intervals.merge_adjacent(t, 2.0).orderBy("start").collect()] == [(0, 0.0, 1.0, 1), (1, 1.0, 2.2, 3)]
    assert {(r["speaker"], r["start"], r["end"]) for r in intervals.merge_by_speaker(t).collect()} == {(0, 0.0, 1.0), (1, 1.0, 2.2), (1, 2.5, 3.0)}


def test_windows(spark):
    total = spark.createDataFrame([("f", 10)], "file string, total long")
    whole = [(r["start"], r["end"]) for r in intervals.sliding_windows(total, 3, 2, False).orderBy("win").collect()]
    assert whole == [(0, 3), (2, 5), (4, 7), (6, 9)]
    assert [(r["start"], r["end"]) for r in intervals.sliding_windows(total, 3, 2, True).orderBy("win").collect()] == [*whole, (8, 10)]
    with pytest.raises(ValueError):
        intervals.sliding_windows(total, 2, 3, True)


def test_rttm_errors(spark):
    lines = ["; note", "", "SPEAKER f 1 0.5 1.0 <NA> <NA> a <NA> <NA>", "SPEAKER f 1 x 1.0 <NA> <NA> a <NA>", "SPEAKER f 1 0.5"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")
    assert [(r["start"], r["duration"], r["speaker"]) for r in text_formats.parse_rttm(df, strict=False).collect()] == [(0.5, 1.0, "a")]
    with pytest.raises(Exception, match="bad RTTM line 4"):
        text_formats.parse_rttm(df).collect()


def test_files_round_trip(spark, tmp_path):
    text_formats.rttm_lines(turns(spark, [(0, 0.5, 1.25), (3, 1, 2)])).coalesce(1).select("line").write.text(str(tmp_path / "r"))
    rows = text_formats.parse_rttm(text_formats.read_lines(spark, str(tmp_path / "r"))).collect()
    assert {(r["file"], r["start"], r["duration"], r["speaker"]) for r in rows} == {("f", 0.5, 0.75, "SPEAKER_00"), ("f", 1.0, 1.0, "SPEAKER_03")}


TABLES = ("events", "embeddings", "conversations")
#: Too many rows to fetch: compared by their number and sums.
LARGE = ("w1_windows", "w2_windows_partial")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    if name not in ORACLES:
        assert df.limit(1).count() == 1
        return
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    if name in LARGE:
        got = df.agg(F.count(F.lit(1)), F.sum("win"), F.sum("start"), F.sum("end")).collect()[0]
        assert tuple(got) == con.sql(f'SELECT count(*), sum(win), sum(start), sum("end") FROM ({ORACLES[name]})').fetchall()[0]
        return
    got = sorted(map(plain, df.select(*[f"`{c}`" for c in names]).collect()), key=str)
    expected = con.execute(ORACLES[name])
    at = [[c[0] for c in expected.description].index(c) for c in names]
    assert got and got == sorted((plain([r[i] for i in at]) for r in expected.fetchall()), key=str)


def same_as_sql(spark, name, folder, **tables):
    """Whether the query's rows over the given tables (lists of tuples and their schema) equal its SQL's, signs of zeros included."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet/*.parquet'")
    for t in TABLES:
        if t not in tables:
            con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    expected = con.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    return sorted(map(str, map(tuple, df.select(*[f"`{c}`" for c in names]).collect()))) == sorted(map(str, expected.fetchall()))


def test_upper_case_is_that_of_sql(spark):
    letters = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000] + ["Straße", "ŉﬁx", "ΐa"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(letters)), "i int, c string").orderBy("i").select(simple_upper(F.col("c"))).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT upper(c) FROM (SELECT unnest(?) AS c)", [letters]).fetchall()]


@pytest.mark.parametrize("name", ["a10_word_pairs", "a10_wder"])
def test_a_sharp_s_is_not_two_letters(spark, tmp_path, name):
    rows = [(1, i, "ab"[i % 2], "ss x ß x ﬁ fi y z " * 3) for i in range(4)]
    assert same_as_sql(spark, name, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))


def test_rounding_is_that_of_sql(spark):
    values = [-1e-7, 1e-7, -0.0, 0.0, 0.5e-6, -0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, -0.1234565, 2.0000005, 1e15 + 0.5, -7.3, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(rounded("v", 6)).collect()]
    assert list(map(str, got)) == [str(r[0]) for r in duckdb.execute("SELECT round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]


@pytest.mark.parametrize("name", ["v2_mean_vector", "v3_centroids", "v4_speaker_embeddings", "q18_mean_normalize", "p19_pre_emphasis", "p20_hamming", "p5_l2_normalize", "s14_downmix"])
def test_small_negative_values_keep_their_sign(spark, tmp_path, name):
    # Values that are less than half a unit of the last decimal under 0, under the mean, under 0.97 of the one before, or in the mean of a pair.
    rows = [(i, [0.25 - (4e-7 if i else 0.0), -4e-7] + [0.25, 0.2425 - 3e-7] * 15 + [-2e-10, 0.0] * 16, i) for i in range(2)]
    assert same_as_sql(spark, name, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith(("voxframe.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "voxframe.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
