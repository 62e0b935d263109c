"""How much the vector indexes look at, and vectors of odd sizes and magnitudes."""

import numpy as np


def grouped(n, dim, seed):
    """Vectors in 64 tight groups of directions."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((64, dim))
    return centres[r.integers(0, 64, n)] + 0.05 * r.standard_normal((n, dim))


def test_ball_tree_prunes_groups_and_stays_exact():
    from voxframe.llm.exact_topk import build_tree, scaled, searcher

    rows = grouped(4096, 32, 1)
    tree, visited = build_tree(np.arange(4096), rows), []
    queries = rows[::64]
    for place, ids, scores in searcher(10, visited)(tree, np.arange(0, 4096, 64), queries, [None] * len(queries)):
        all_scores = (scaled(rows) @ scaled(queries[place : place + 1])[0]).astype(np.int64)
        all_scores[64 * place] = -(1 << 62)
        best = np.lexsort((np.arange(4096), -all_scores))[:10]
        assert ids.tolist() == best.tolist() and scores.tolist() == all_scores[best].tolist()
    assert np.mean(visited) < 0.25 * 4096


def test_a_shared_score_prunes_more():
    from voxframe.llm.exact_topk import build_tree, scaled, searcher

    rows = grouped(8192, 32, 2)
    near, far = rows[:4096], -rows[4096:]
    queries = near[::256]
    kth = [int(np.partition((scaled(near) @ scaled(q[None])[0]).astype(np.int64), -11)[-11]) for q in queries]
    alone, shared = [], []
    tree = build_tree(np.arange(4096, 8192), far)
    list(searcher(10, alone)(tree, np.arange(len(queries)), queries, [None] * len(queries)))
    list(searcher(10, shared)(tree, np.arange(len(queries)), queries, kth))
    assert sum(shared) < 0.5 * sum(alone)


def recall(rows, gather):
    from voxframe.llm.ann_forest import build_forest, searcher

    forest, visited, hits = build_forest(np.arange(len(rows)), rows), [], 0
    own = np.arange(0, len(rows), len(rows) // 40)
    for place, ids, _ in searcher(10, gather, visited)(forest, own, rows[own], [None] * len(own)):
        distance = ((rows - rows[own[place]]) ** 2).sum(axis=1)
        distance[own[place]] = np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(distance, kind="stable")[:10].tolist()))
    return hits / (10 * len(own)), np.mean(visited) / len(rows)


def test_forest_recall_on_whole_shards():
    from voxframe.llm.ann_forest import GATHER

    found, _ = recall(np.random.default_rng(3).standard_normal((8192, 64)), GATHER)
    assert found >= 0.9
    found, share = recall(grouped(8192, 64, 4), GATHER)
    assert found >= 0.98 and share < 0.15


def test_odd_vectors(spark):
    from voxframe.llm.ann_forest import nearest
    from voxframe.llm.exact_topk import exact_topk

    rows = [(0, [1e301, 1.0]), (1, [1e308, -1e308]), (2, [1.0, 2.0]), (3, [3.0]), (100, [5.0]), (4, [0.5]), (5, [float("inf"), 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_topk(df).collect()]
    assert [(q, v, s) for q, _, v, s in sorted(got) if q == 100] == [(100, 3, 3072 * 5120), (100, 4, 512 * 5120)]
    assert [(v, s) for q, _, v, s in sorted(got) if q == 0][0] == (1, (1 << 63) - 1) and sum(q == 0 for q, *_ in got) == 2
    got = [tuple(r) for r in nearest(df).collect()]
    assert [(v, s) for q, _, v, s in sorted(got) if q == 100] == [(3, 2.0), (4, 4.5)] and sum(q == 0 for q, *_ in got) == 2
    none = df.where("vec_id < 0")
    assert exact_topk(none).count() == nearest(none).count() == 0
