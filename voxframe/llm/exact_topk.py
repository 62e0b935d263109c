"""Exact top-k by integer inner product (operator 1).

Method: a ball tree for each shard, searched by branch and bound. Nodes wait in a heap in the order
of the greatest inner product that they allow: the least of the ball's bound q.c + |q| r, that of
the cone around the node's centre, and |q| times the greatest norm. The search of a shard ends when that
bound falls below the query's current kth score. The kth score is shared: a query enters a round of
shards with the kth score that all earlier rounds have reached, and keeps raising it from leaf to leaf.

How much is pruned depends on the vectors: where they lie in groups, most nodes are; where directions are
spread evenly over many dimensions (as in the test tables), no bound of a node falls below the kth score.

Components are scaled to floor(1024 * x), held within the range of doubles. Ties go to the smaller
vec_id; a query never returns its own vec_id. Rows: vectors that are null, empty, or hold null or
non-finite components, and rows without an id, take no part; repeated rows are separate candidates and
separate queries; an empty table gives an empty result; further columns are ignored. Scores beyond 64
bits are held at the ends of the range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.vectors import search_blocks, usable

SCALE = 1024
LEAF = 64
#: Share of a node's rows that a child has at least.
LEAST_PART = 0.02
#: Below this, sums of products are exact in double precision.
EXACT = 2.0**53


def scaled(vectors: np.ndarray) -> np.ndarray:
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -most, most)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, as 64-bit integers."""
    with np.errstate(over="ignore"):
        exact = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * vectors.shape[1] < EXACT
    if exact:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(int(a) * b for a, b in zip(row, whole)))) for row in vectors], dtype=np.int64)


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Nodes as arrays: centre, radius, cone (cosine of its half angle), greatest and least norm, children (or -1), and the range of rows below."""
    vectors = scaled(vectors)
    order = np.arange(len(ids))
    centre, radius, cone, longest, shortest, child, span = [], [], [], [], [], [], []

    def add(start: int, end: int) -> int:
        own = vectors[order[start:end]]
        c = own.mean(axis=0)
        norms, length = np.sqrt((own**2).sum(axis=1)), float(np.sqrt((c**2).sum()))
        cosines = own @ c / np.maximum(norms * length, 1e-300)
        centre.append(c)
        radius.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).max())))
        cone.append(float(np.where(norms > 0, cosines, 1.0).min()) if length > 0 else -1.0)
        longest.append(float(norms.max()))
        shortest.append(float(norms.min()))
        child.append((-1, -1))
        span.append((start, end))
        return len(span) - 1

    with np.errstate(over="ignore", invalid="ignore"):  # bounds that overflow are read as infinite
        waiting = [add(0, len(ids))]
        while waiting:
            node = waiting.pop()
            start, end = span[node]
            if end - start <= LEAF or radius[node] == 0:
                continue
            own = vectors[order[start:end]]
            far = own[((own - centre[node]) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            along = own @ (other - far)
            by = np.argsort(along, kind="stable")
            order[start:end] = order[start:end][by]
            # Each row goes to the nearer of the two; where that leaves next to nothing on a side, halves.
            nearer = start + int(np.searchsorted(along[by], (other @ other - far @ far) / 2))
            middle = nearer if min(nearer - start, end - nearer) >= LEAST_PART * (end - start) else (start + end) // 2
            child[node] = (add(start, middle), add(middle, end))
            waiting += child[node]
    names = {"centre": centre, "radius": radius, "cone": cone, "longest": longest, "shortest": shortest}
    return {"ids": ids[order], "vectors": vectors[order], "child": child, "span": span} | {k: np.array(v) for k, v in names.items()}


def upper_bounds(tree: dict, q: np.ndarray) -> np.ndarray:
    """For every node, a number that no inner product of q with a row below exceeds."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((q**2).sum())
        along = tree["centre"] @ q
        ball = along + norm * tree["radius"]
        toward = np.clip(along / np.maximum(norm * np.sqrt((tree["centre"] ** 2).sum(axis=1)), 1e-300), -1, 1)
        half = np.clip(np.nan_to_num(tree["cone"], nan=-1.0), -1, 1)
        closest = np.cos(np.maximum(0.0, np.arccos(toward) - np.arccos(half))) + 1e-9
        cone = norm * closest * np.where(closest > 0, tree["longest"], tree["shortest"])
        bound = np.minimum(ball, np.minimum(cone, norm * tree["longest"]))
        slack = 1e-9 * (np.abs(along) + norm * (tree["radius"] + tree["longest"])) + 1
        return np.nan_to_num(bound + slack, nan=np.inf)


def searcher(k: int, visited: list | None = None):
    """visited: takes the number of rows scored for each query, where it is given."""

    def search(tree: dict, ids: np.ndarray, queries: np.ndarray, bounds: list) -> Iterator:
        for i, q in enumerate(scaled(queries)):
            upper = upper_bounds(tree, q).tolist()
            lowest = np.iinfo(np.int64).min
            best_ids, best, kth, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), lowest if bounds[i] is None else int(bounds[i]), 0
            heap = [(-upper[0], 0)]
            while heap and -heap[0][0] >= kth:
                node = heapq.heappop(heap)[1]
                left, right = tree["child"][node]
                if left >= 0:
                    for c in (left, right):
                        if upper[c] >= kth:
                            heapq.heappush(heap, (-upper[c], c))
                    continue
                start, end = tree["span"][node]
                rows += end - start
                scores, own = products(tree["vectors"][start:end], q), tree["ids"][start:end]
                good = (scores >= kth) & (own != ids[i])
                if good.any():
                    best, best_ids = np.r_[best, scores[good]], np.r_[best_ids, own[good]]
                    top = np.lexsort((best_ids, ~best))[:k]  # ~x falls as x rises, without overflow
                    best, best_ids = best[top], best_ids[top]
                    if len(best) == k:
                        kth = max(kth, int(best[-1]))
            if visited is not None:
                visited.append(rows)
            yield i, best_ids, best

    return search


def exact_topk(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by ``query_every``."""
    rows = usable(vectors, id_col, vector_col, drop_zero=False)
    return search_blocks(rows, rows.where(F.col("vec_id") % query_every == 0), build_tree, searcher(k), "long", k, True)
