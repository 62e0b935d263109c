"""The pipeline's near copies: five-word shingles, similarity 0.8 or more."""

import corpus_pipeline
import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(r, words, n):
    """The words with n of them replaced, at least five places apart, so that each takes five shingles."""
    out = list(words)
    for at in r.permutation(np.arange(5, len(words) - 5, 6))[:n]:
        out[at] = f"new{r.integers(1 << 40)}"
    return out


def similarity(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_the_stage_keeps_one_of_each_group_of_similar_texts(spark):
    r = np.random.default_rng(7)
    rows, expected = [], set()
    for i in range(40):
        base = [f"w{x}" for x in r.integers(0, 1 << 40, 300)]
        near, far = edited(r, base, 5), edited(r, base, 12)
        assert similarity(base, near) >= 0.8 > similarity(base, far) and similarity(near, far) < 0.8
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
        expected |= {3 * i, 3 * i + 2}
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in [*rows, (0, rows[0][1]), (500, None), (501, ""), (502, "one two"), (503, "One  two")]], DOCS)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(expected | {500, 502})


def brute_force(texts):
    """The least number of each text's component of pairs that reach the similarity."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similarity(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return root


def test_groups_equal_brute_force(spark):
    from voxframe.llm.near_copies import groups

    r = np.random.default_rng(8)
    texts = []
    for i in range(6):
        base = [f"w{x}" for x in r.integers(0, 1 << 40, 120 + i)]
        texts += [edited(r, base, int(r.integers(0, 9))) for _ in range(25)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)], DOCS)
    expected = brute_force(texts)
    assert len(set(expected)) > 10
    assert sorted(tuple(x) for x in groups(docs).collect()) == list(enumerate(expected))


def test_bitmaps_differ_in_no_more_bits_than_sets(spark):
    from voxframe.llm.near_copies import bitmap

    r = np.random.default_rng(9)
    for _ in range(50):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, 200))
        b = np.unique(np.concatenate([a[: r.integers(1, 200)], r.integers(-(1 << 62), 1 << 62, 30)]))
        assert np.unpackbits((bitmap(a) ^ bitmap(b)).view(np.uint8)).sum() <= len(np.setxor1d(a, b))


def test_fine_bitmaps_of_any_sizes_differ_in_no_more_bits_than_sets():
    from voxframe.llm.near_copies import apart, fine_bitmap

    r = np.random.default_rng(10)
    for _ in range(50):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, r.integers(0, 3000)))
        b = np.unique(np.concatenate([a[: r.integers(0, len(a) + 1)], r.integers(-(1 << 62), 1 << 62, r.integers(0, 300))]))
        assert apart(fine_bitmap(a), fine_bitmap(b)) == apart(fine_bitmap(b), fine_bitmap(a)) <= len(np.setxor1d(a, b))
    unlike = [np.unique(r.integers(-(1 << 62), 1 << 62, 3000)) for _ in range(2)]
    assert apart(*map(fine_bitmap, unlike)) > 0.2 / 1.8 * 6000


def test_whole_sets_are_read_of_likely_pairs_only_and_spent_tables_are_deleted(spark, monkeypatch):
    import pathlib

    from voxframe.llm import common, near_copies

    r = np.random.default_rng(12)
    passage = [f"p{x}" for x in r.integers(0, 1 << 40, 900)]
    texts = [passage + [f"w{x}" for x in r.integers(0, 1 << 40, 600)] for _ in range(20)]  # similarity 0.43, and too long for 256 bits
    texts.append(edited(r, texts[0], 8))
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)], DOCS)
    read, whole = set(), near_copies.whole_sets
    monkeypatch.setattr(near_copies, "whole_sets", lambda docs, ids: (read.update(x[0] for x in ids.collect()), whole(docs, ids))[1])
    common.prepare(spark)
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.glob("*.parquet"))
    found = near_copies.groups(docs)
    assert sorted(tuple(x) for x in found.collect()) == [(i, i % 20) for i in range(21)]
    assert read == {0, 20}
    assert [spark.read.parquet(str(x)).columns for x in set(folder.glob("*.parquet")) - before] == [["doc_id", "component_id"]]
