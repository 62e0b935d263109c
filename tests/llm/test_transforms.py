"""Operator 8's shard transforms and their merge, and operator 10's subtrees, on their own."""

import numpy as np


def test_merged_interleave_is_the_order_of_suffixes():
    from voxframe.llm.suffix_array_dedup import interleaves, transforms

    r = np.random.default_rng(3)
    symbols = r.integers(1, 4, (40, 30)).astype(np.int32)
    symbols[::3, 20:] = symbols[0, 20:]  # long common ends
    symbols[5, :4] = 0  # an end
    shard = r.integers(0, 5, 40).astype(np.int16)
    transform, strings = transforms(symbols, shard)
    for s in range(5):  # a shard's stretch is the transform of the shard alone
        alone, _ = transforms(symbols[shard == s], np.zeros((shard == s).sum(), dtype=np.int16))
        assert (transform[:, np.sort(shard) == s] == alone).all()
    for p, interleave, common in interleaves(transform, np.sort(shard), 257):
        own = np.empty(40, dtype=int)
        own[np.argsort(interleave, kind="stable")] = strings[p]
        suffixes = [symbols[i, p:].tolist() for i in own]
        assert suffixes == sorted(suffixes)
        for i in range(1, 40):
            n = next((k for k, (a, b) in enumerate(zip(suffixes[i - 1], suffixes[i])) if a != b or a == 0), 30 - p)
            assert common[i] == n


def test_a_shard_has_no_part_in_the_transforms_of_others(monkeypatch):
    from voxframe.llm.suffix_array_dedup import transforms

    r = np.random.default_rng(4)
    symbols, shard = r.integers(0, 3, (20, 12)).astype(np.int32), np.repeat([0, 1], 10).astype(np.int16)
    changed = symbols.copy()
    changed[10:] = 1
    assert (transforms(symbols, shard)[0][:, :10] == transforms(changed, shard)[0][:, :10]).all()


def test_deep_nodes_are_the_repeated_suffixes():
    from voxframe.llm.substring_dedup import deep_nodes

    r = np.random.default_rng(5)
    suffixes, partition = r.integers(0, 2, (400, 6)).astype(np.uint64), r.integers(0, 8, 400)
    leaves, node = deep_nodes(suffixes, partition)
    found = {}
    for leaf, n in zip(leaves.tolist(), node.tolist()):
        found.setdefault(n, []).append(leaf)
    expected = {}
    for i, key in enumerate(zip(partition.tolist(), map(tuple, suffixes.tolist()))):
        expected.setdefault(key, []).append(i)
    assert sorted(found.values()) == sorted(x for x in expected.values() if len(x) > 1)
