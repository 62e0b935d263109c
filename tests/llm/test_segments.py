"""Operator 5's segment tables against all pairs."""

import random

import numpy as np
import pytest
from voxframe.llm.simhash import components, links


def planted(r):
    """Distinct fingerprints: random ones, chains of near ones, and many that share one segment."""
    base = [r.getrandbits(64) for _ in range(100)]
    fps = set(base)
    for x in base[:20]:
        for _ in range(12):
            y = x
            for _ in range(r.choice((1, 2, 3))):
                y ^= 1 << r.randrange(64)
            fps.add(y)
            x = r.choice((x, y))
    for _ in range(150):
        fps.add(base[0] ^ 1 << r.randrange(32) ^ 1 << r.randrange(32) ^ 1 << r.randrange(32))
        fps.add(base[0] ^ 1 << 40 ^ 1 << r.randrange(32) ^ 1 << r.randrange(64))
    return np.array(sorted(fps), dtype=np.uint64)


@pytest.mark.parametrize("most", [1, 8, 10_000])
def test_components_equal_all_pairs(spark, most):
    fps = planted(random.Random(5))
    root = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.unpackbits((fps ^ fps[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= 2
        root[np.isin(root, root[near])] = root[near].min()
    expected = {}
    for f, g in zip(fps.view(np.int64).tolist(), root.tolist()):
        expected.setdefault(g, set()).add(f)
    found = {}
    pairs = links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"), most=most)
    for x in components(pairs).collect():
        found.setdefault(x["root"], set()).add(x["node"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)
