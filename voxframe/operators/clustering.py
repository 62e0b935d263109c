"""Clustering of the speaker vectors of one recording, in numpy, and its application to every recording of a table.

A recording's vectors reach one task, as its similarities are a square matrix: ``LARGEST`` vectors at most,
more is an error. Between recordings everything is distributed. Vectors are single precision, as embedders give them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxframe.operators.scoring import best_assignment

LARGEST = 20_000
#: Below this, graphs and means say little, and agglomeration takes over.
FEW = 8


class XorShift:
    """xorshift64* (Vigna): a fixed generator, so that seeded runs agree."""

    MASK = (1 << 64) - 1

    def __init__(self, seed: int):
        self.state = seed or 0x9E3779B97F4A7C15

    def next(self) -> int:
        x = self.state
        x ^= x >> 12
        x = (x ^ x << 25) & self.MASK
        self.state = x = x ^ x >> 27
        return x * 0x2545F4914F6CDD1D & self.MASK

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def below(self, n: int) -> int:
        return self.next() * n >> 64


def normalized(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; a norm that is not finite gives zeros, one up to 1e-8 leaves the row as it is."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x**2).sum(axis=-1, keepdims=True))
        out = np.where(norm > 1e-8, x / np.where(norm > 1e-8, norm, 1), x)
    return np.where(np.isfinite(norm), out, 0).astype(x.dtype)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of rows of a and b; 0 where a squared norm is under 1e-8 or anything is not finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = (a @ b.T) / np.sqrt(np.maximum(na, 1e-30)[:, None] * np.maximum(nb, 1e-30)[None, :])
    ok = (np.isfinite(na) & (na >= 1e-8))[:, None] & (np.isfinite(nb) & (nb >= 1e-8))[None, :]
    return np.where(ok & np.isfinite(out), out, 0)


def similarity_matrix(x: np.ndarray) -> np.ndarray:
    out = cosines(x, x)
    out = (out + out.T) / 2
    np.fill_diagonal(out, 1)
    return out


def canonical(labels: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... by size, largest first, then by first member."""
    names, first, inverse, size = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
    place = np.empty(len(names), dtype=np.int64)
    place[np.lexsort((first, -size))] = np.arange(len(names))
    return place[inverse]


def centroids_of(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Unit means of the labels 0 to k - 1; a label without members has zeros, labels beyond are passed over."""
    out = np.zeros((k, x.shape[1]), dtype=x.dtype)
    held = labels < k
    np.add.at(out, labels[held], x[held])
    count = np.bincount(labels[held], minlength=k)[:, None]
    return normalized(np.where(count > 0, out / np.maximum(count, 1), 0).astype(x.dtype))


@dataclass(frozen=True)
class Agglomeration:
    """Parameters of agglomerative clustering by cosine (or score) of centroids."""

    threshold: float | None = None  # None: the largest gap among the lower half of similarities
    most: int = 0  # merge on while more clusters are left; 0: no ceiling
    members: int = 0  # never merge two clusters of so many members each
    seconds: float = 0.0  # never merge two clusters of so much speech each


def gap_threshold(sim: np.ndarray) -> float:
    n = len(sim)
    if n < 2:
        return 0.5
    low = np.sort(sim[np.triu_indices(n, 1)])
    if len(low) <= 1:
        return 0.5
    steps = np.diff(low)[: max(0, len(low) // 2 - 1)]
    at = int(steps.argmax()) if len(steps) and steps.max() > 0 else 0
    return float(np.clip(low[at + 1], 0.2, 0.7))


def _merge(sim: np.ndarray, stop: Callable[[float, int], bool], update: Callable[[int, int, np.ndarray], np.ndarray], blocked: Callable[[int], np.ndarray] | None) -> np.ndarray:
    """Merges the most similar pair (the first of equals) until stop(similarity, clusters left). update gives the merged row's similarities.

    Each row keeps its best partner to the right, so a step costs a row and not the matrix.
    """
    n = len(sim)
    sim = np.where(np.tri(n, dtype=bool), -np.inf, sim)  # row < column
    owner, alive = np.arange(n), np.ones(n, dtype=bool)
    best_at = sim.argmax(axis=1)
    best = sim[np.arange(n), best_at]
    left = n
    while left > 1:
        i = int(best.argmax())
        if best[i] == -np.inf or stop(float(best[i]), left):
            break
        j = int(best_at[i])
        alive[j], left = False, left - 1
        owner[owner == j] = i
        sim[j, :], sim[:, j] = -np.inf, -np.inf
        others = np.flatnonzero(alive)
        others = others[others != i]
        fresh = update(i, j, others)
        if blocked is not None:
            fresh = np.where(blocked(i)[others], -np.inf, fresh)
        right, above = others > i, others < i
        sim[i, others[right]] = fresh[right]
        sim[others[above], i] = fresh[above]
        best[j] = -np.inf
        again = np.flatnonzero(alive & ((best_at == j) | (best_at == i)))
        for row in {i, *again.tolist()}:
            best_at[row] = sim[row].argmax()
            best[row] = sim[row, best_at[row]]
        # A row above may have found a better partner in i; of equals the first.
        rows = others[above]
        better = (sim[rows, i] > best[rows]) | ((sim[rows, i] == best[rows]) & (i < best_at[rows]))
        best[rows[better]], best_at[rows[better]] = sim[rows[better], i], i
    return owner


def agglomerate(x: np.ndarray, p: Agglomeration = Agglomeration(), seconds: np.ndarray | None = None, score: Callable | None = None) -> np.ndarray:
    """Canonical labels. score(cosines, members, members) may turn cosines of centroids into scores, given each cluster's dominant member."""
    n = len(x)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    cent = x.astype(np.float32).copy()
    cosine = similarity_matrix(cent)
    threshold = gap_threshold(cosine) if p.threshold is None else p.threshold
    size, heavy = np.ones(n, dtype=np.int64), np.arange(n)
    spoken = np.maximum(seconds, 0).astype(float) if seconds is not None and len(seconds) == n else np.zeros(n)
    sim = score(cosine, heavy[:, None], heavy[None, :]) if score else cosine

    def established() -> np.ndarray:
        by_size = (size >= p.members) if p.members > 0 else np.zeros(n, dtype=bool)
        return by_size | ((spoken >= p.seconds) if p.seconds > 0 else np.zeros(n, dtype=bool))

    def blocked(i: int) -> np.ndarray:
        e = established()
        return e & e[i]

    def stop(best: float, left: int) -> bool:
        return not (0 < p.most < n and left > p.most) and best < threshold

    def update(i: int, j: int, others: np.ndarray) -> np.ndarray:
        total = size[i] + size[j]
        cent[i] = normalized((cent[i] * np.float32(size[i] / total) + cent[j] * np.float32(size[j] / total)).astype(np.float32))
        heavy[i] = heavy[j] if size[j] > size[i] else heavy[i]
        size[i], spoken[i] = total, spoken[i] + spoken[j]
        found = cosines(cent[i : i + 1], cent[others])[0]
        return score(found, np.full(len(others), heavy[i]), heavy[others]) if score else found

    watch = p.members > 0 or p.seconds > 0
    if watch:
        e = established()
        sim = np.where(e[:, None] & e[None, :], -np.inf, sim)
    return canonical(_merge(np.asarray(sim, dtype=float), stop, update, blocked if watch else None))


def centroid_euclidean(x: np.ndarray, threshold: float, most: int = 0) -> np.ndarray:
    """Labels by distance of unit vectors' centroids, which are not made unit again; merged up to the threshold, in order of first members."""
    n = len(x)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    cent, size = normalized(x.astype(np.float32)), np.ones(n)
    distances = lambda a, b: np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=-1), 0))

    def update(i: int, j: int, others: np.ndarray) -> np.ndarray:
        total = size[i] + size[j]
        cent[i] = cent[i] * np.float32(size[i] / total) + cent[j] * np.float32(size[j] / total)
        size[i] = total
        return -distances(cent[i : i + 1], cent[others])[0]

    first = np.concatenate([-distances(cent[a : a + 256], cent) for a in range(0, n, 256)])
    owner = _merge(first.astype(float), lambda best, left: not (0 < most < n and left > most) and -best > threshold, update, None)
    return np.unique(owner, return_inverse=True)[1]


def union_seconds(start: np.ndarray, end: np.ndarray) -> float:
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    before = np.r_[-np.inf, np.maximum.accumulate(end)[:-1]]
    return float(np.maximum(0, end - np.maximum(start, before)).sum())


def prune(x: np.ndarray, labels: np.ndarray, weight: dict[int, float], least: float) -> np.ndarray:
    """Labels of clusters under ``least`` weight go to the nearest of the others; without any, the heaviest stays (the smallest label of several)."""
    kept = sorted(c for c, w in weight.items() if w >= least) or [min(weight, key=lambda c: (-weight[c], c))]
    if len(kept) == len(weight):
        return labels
    slot = {c: i for i, c in enumerate(kept)}
    places = np.array([slot.get(c, len(kept)) for c in labels.tolist()])
    near = cosines(x, centroids_of(x, places, len(kept))).argmax(axis=1)
    return np.where(places < len(kept), places, near)


def prune_small(x: np.ndarray, labels: np.ndarray, least: int) -> np.ndarray:
    return labels if least <= 1 or not len(labels) else prune(x, labels, dict(zip(*(v.tolist() for v in np.unique(labels, return_counts=True)))), least)


def prune_short(x: np.ndarray, labels: np.ndarray, start: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
    return labels if least <= 0 or not len(labels) else prune(x, labels, {int(c): union_seconds(start[labels == c], end[labels == c]) for c in np.unique(labels)}, least)


def kmeans(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Labels of k-means by cosine distance, seeded by distance. A cluster that loses its members has a zero centroid from then on."""
    n = len(x)
    if n == 0 or k == 0:
        return np.zeros(n, dtype=np.int64)
    k, draw, rows = min(k, n), XorShift(seed), x.astype(np.float64)
    away = lambda c: np.maximum(0, 1 - cosines(x.astype(np.float32), c.astype(np.float32)))
    centres = rows[draw.below(n)][None]
    nearest = np.full(n, np.inf)
    while len(centres) < k:
        nearest = np.minimum(nearest, away(centres[-1:])[:, 0])
        total = nearest.sum()
        if not np.isfinite(total) or total <= 0:
            break
        reached = np.cumsum(nearest) >= draw.unit() * total
        centres = np.vstack([centres, rows[int(reached.argmax()) if reached.any() else 0]])
    labels = np.zeros(n, dtype=np.int64)
    for _ in range(rounds):
        after = away(centres).argmin(axis=1)
        if (after == labels).all():
            break
        labels, centres = after, np.zeros((k, x.shape[1]))
        np.add.at(centres, labels, rows)
        centres /= np.maximum(1, np.bincount(labels, minlength=k))[:, None]
    return labels


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of the members of clusters of two and more; 0 for two rows or one cluster."""
    n, k = len(labels), int(labels.max(initial=0)) + 1
    if n <= 2 or k < 2:
        return 0.0
    member = np.zeros((n, k))
    member[np.arange(n), labels] = 1
    size = member.sum(axis=0)
    to = distance @ member
    own = size[labels]
    a = to[np.arange(n), labels] / np.maximum(own - 1, 1)
    other = np.where(size > 0, to / np.maximum(size, 1), np.inf)
    other[np.arange(n), labels] = np.inf
    b = other.min(axis=1)
    use = (own > 1) & np.isfinite(b)
    if not use.any():
        return 0.0
    top = np.maximum(a, b)[use]
    return float(np.where(top > 0, (b - a)[use] / np.where(top > 0, top, 1), np.nan).mean())


def kmeans_auto(x: np.ndarray, low: int, high: int, rounds: int, trials: int) -> np.ndarray:
    """k-means with the number of clusters of best silhouette; one cluster where the mean distance is under 0.15."""
    n = len(x)
    if n <= 1:
        return np.zeros(n, dtype=np.int64)
    low = min(max(low, 2), n)
    high = min(max(high, low), n)
    distance = np.maximum(0, 1 - similarity_matrix(x))
    if distance[np.triu_indices(n, 1)].mean() < 0.15:
        return np.zeros(n, dtype=np.int64)
    best, found = -np.inf, np.zeros(n, dtype=np.int64)
    for k in range(low, high + 1):
        for t in range(max(1, trials)):
            labels = kmeans(x, k, rounds, 42 + t)
            if (score := silhouette(distance, labels)) > best:
                best, found = score, labels
    return found


MOST_CANDIDATES = 20


def laplacian(x: np.ndarray) -> np.ndarray:
    """Normalized Laplacian of the graph of each row's nearest neighbours of positive similarity."""
    n = len(x)
    k, sim = int(np.clip(n // 10, 2, 10)), similarity_matrix(x).astype(float)
    np.fill_diagonal(sim, -np.inf)
    near = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    edges = np.zeros((n, n))
    np.put_along_axis(edges, near, np.maximum(np.take_along_axis(sim, near, axis=1), 0), axis=1)
    edges = np.maximum(edges, edges.T)
    np.fill_diagonal(edges, 1)
    degree = edges.sum(axis=1)
    return np.eye(n) - edges / np.maximum(np.sqrt(degree[:, None] * degree[None, :]), 1e-10)


def eigengap(values: np.ndarray, most: int) -> int:
    """The number of clusters at the largest relative step between ascending eigenvalues, the first of equals."""
    most = min(most, len(values), MOST_CANDIDATES)
    steps = [(b - a) / abs(b) if abs(b) > 1e-10 else 0.0 for a, b in zip(values[: most - 1], values[1:most])]
    return int(np.argmax(steps)) + 1 if steps and max(steps) > 0 else 1


def spectral(x: np.ndarray, most: int) -> np.ndarray:
    """Labels by the eigengap of the neighbour graph and k-means on its eigenvectors; few rows are agglomerated."""
    n = len(x)
    if n <= 1:
        return np.zeros(n, dtype=np.int64)
    if n < FEW:
        return agglomerate(x, Agglomeration(most=most))
    try:
        values, vectors = np.linalg.eigh(laplacian(x))
    except np.linalg.LinAlgError:
        return np.zeros(n, dtype=np.int64)
    k = eigengap(values, min(most, n))
    rows = vectors[:, :k]
    norm = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return kmeans(np.where(norm > 1e-10, rows / np.maximum(norm, 1e-10), rows).astype(np.float32), k, 50)


def kmeans_clusters(x: np.ndarray, most: int, fast: bool = False, rounds: int = 100, trials: int = 3) -> np.ndarray:
    n = len(x)
    if n < FEW:
        return agglomerate(x, Agglomeration(most=most)) if n > 1 else np.zeros(n, dtype=np.int64)
    return kmeans_auto(x, 2, min(int(np.clip(n // 20, 5, 12)), most), 20, 1) if fast else kmeans_auto(x, 2, min(most, n), rounds, trials)


def cohort_stats(x: np.ndarray, cohort: np.ndarray, top: int) -> np.ndarray:
    """Mean and standard deviation of each row's best ``top`` cosines with the cohort; 0 and 1 where they hardly vary."""
    if not len(cohort):
        return np.tile([0.0, 1.0], (len(x), 1))
    best = -np.sort(-cosines(x, normalized(cohort)), axis=1)[:, : min(max(1, top), len(cohort))]
    mean, std = best.mean(axis=1), best.std(axis=1)
    return np.stack([np.where(std < 1e-6, 0, mean), np.where(std < 1e-6, 1, std)], axis=1)


def normalized_scores(stats: np.ndarray) -> Callable:
    """A score of cosines that is normalized by the cohort on both sides."""
    return lambda s, a, b: 0.5 * ((s - stats[a, 0]) / stats[a, 1] + (s - stats[b, 0]) / stats[b, 1])


def split_short(seconds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, short): places of at least ``least`` seconds, or the longest one (the first of several), and of the others."""
    long_ = np.ones(len(seconds), dtype=bool) if least <= 0 else seconds >= least
    if len(seconds) and not long_.any():
        long_[int(np.argmax(seconds))] = True
    return np.flatnonzero(long_), np.flatnonzero(~long_)


def with_short(x: np.ndarray, kept: np.ndarray, labels: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Labels of all rows: those of the kept, and for the short ones the nearest kept label's centroid."""
    out = np.zeros(len(x), dtype=np.int64)
    if not len(kept):
        return out
    out[kept] = labels
    k = int(labels.max()) + 1
    near = cosines(x[short], centroids_of(x[kept], labels, k))
    near[:, np.bincount(labels, minlength=k) == 0] = -np.inf
    out[short] = near.argmax(axis=1)
    return out


@dataclass(frozen=True)
class Plda:
    mean1: np.ndarray
    mean2: np.ndarray
    lda: np.ndarray
    mu: np.ndarray
    transform: np.ndarray
    phi: np.ndarray

    def apply(self, x: np.ndarray, dim: int | None = None) -> np.ndarray:
        """Centred, scaled to the root of the dimension, reduced, again centred and scaled, and diagonalized."""
        unit = lambda v: v * np.sqrt(v.shape[1]) / np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-12)
        y = unit(x.astype(np.float64) - self.mean1) @ self.lda
        y = (unit(y - self.mean2) - self.mu) @ self.transform.T
        return y if dim is None else y[:, :dim]


@dataclass(frozen=True)
class Vbx:
    fa: float = 0.3
    fb: float = 0.8
    loop: float = 0.9  # 0: a mixture, without an order in time
    smoothing: float = 7.0
    epsilon: float = 1e-4
    rounds: int = 20


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def variational_bayes(y: np.ndarray, phi: np.ndarray, labels: np.ndarray, p: Vbx = Vbx()) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities, priors) by variational Bayes over PLDA features (Landini et al. 2022), from smoothed starting labels."""
    t, dim, k, ratio, eps = len(y), y.shape[1], int(labels.max()) + 1, p.fa / p.fb, 1e-8
    start = np.eye(k)[labels]
    if p.smoothing >= 0:
        start = np.exp(p.smoothing * start)
        start /= start.sum(axis=1, keepdims=True)
    gamma, pi, last = start, np.full(k, 1 / k), -np.inf
    frame, rho = -0.5 * ((y**2).sum(axis=1) + dim * np.log(2 * np.pi)), y * np.sqrt(phi)
    for step in range(p.rounds):
        spread = 1 / (1 + ratio * gamma.sum(axis=0)[:, None] * phi)
        alpha = ratio * spread * (gamma.T @ rho)
        log_p = p.fa * (rho @ alpha.T - 0.5 * ((spread + alpha**2) @ phi) + frame[:, None])
        if p.loop > 0:
            move = np.log(np.eye(k) * p.loop + (1 - p.loop) * pi[None, :] + eps)
            ahead, back = np.empty((t, k)), np.zeros((t, k))
            ahead[0] = log_p[0] + np.log(pi + eps)
            for i in range(1, t):
                ahead[i] = log_p[i] + logsum(ahead[i - 1][:, None] + move, 0)
            for i in range(t - 2, -1, -1):
                back[i] = logsum(move + (log_p[i + 1] + back[i + 1])[None, :], 1)
            total = float(logsum(ahead[-1], 0))
            gamma = np.exp(ahead + back - total)
            entered = np.exp(logsum(ahead[:-1], 1)[:, None] + log_p[1:] + back[1:] - total).sum(axis=0)
            pi = gamma[0] + (1 - p.loop) * pi * entered
        else:
            joint = log_p + np.log(pi + eps)
            evidence = logsum(joint, 1)
            gamma, total = np.exp(joint - evidence[:, None]), float(evidence.sum())
            pi = gamma.sum(axis=0)
        pi = pi / pi.sum()
        bound = total + 0.5 * p.fb * float((np.log(spread) - spread - alpha**2 + 1).sum())
        if step and bound - last < p.epsilon:
            break
        last = bound
    return gamma, pi


def hard_labels(gamma: np.ndarray) -> np.ndarray:
    """The most likely speaker of each row (the last of equals), numbered as they are first seen."""
    raw = gamma.shape[1] - 1 - gamma[:, ::-1].argmax(axis=1) if gamma.size else np.zeros(len(gamma), dtype=np.int64)
    names, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(first)] = np.arange(len(names))
    return place[inverse]


def soft_labels(gamma: np.ndarray, pi: np.ndarray, kept: np.ndarray, every: np.ndarray) -> np.ndarray:
    """All rows by the nearest of the centroids that the responsibilities weigh, for speakers with a prior over 1e-7."""
    use = np.flatnonzero(pi > 1e-7)
    use = use if len(use) else np.arange(len(pi))
    weight = np.where(np.isfinite(gamma[:, use]) & (gamma[:, use] > 0), gamma[:, use], 0)
    use_, total = weight.sum(axis=0) > 0, weight.sum(axis=0)
    if not use_.any():
        return np.zeros(len(every), dtype=np.int64)
    cent = normalized((weight[:, use_].T @ kept / total[use_][:, None]).astype(np.float32))
    return cosines(every.astype(np.float32), cent).argmax(axis=1)


@dataclass(frozen=True)
class VbxClusterer:
    plda: Plda
    threshold: float = 0.6  # of the starting agglomeration, a distance of unit vectors
    scale: float = 4.88
    least_seconds: float = 1.6
    most: int = 0
    soft: bool = False
    dim: int | None = None
    vbx: Vbx = field(default_factory=Vbx)

    def __call__(self, x: np.ndarray, seconds: np.ndarray | None = None) -> np.ndarray:
        if len(x) <= 1:
            return np.zeros(len(x), dtype=np.int64)
        kept, short = split_short(seconds, self.least_seconds) if seconds is not None and len(seconds) == len(x) else (np.arange(len(x)), np.zeros(0, dtype=np.int64))
        y = self.plda.apply(x * np.float32(self.scale), self.dim)
        if len(kept) == 1:
            return np.zeros(len(x), dtype=np.int64)
        start = centroid_euclidean(x[kept], self.threshold, self.most)
        phi = self.plda.phi[: y.shape[1]]
        gamma, pi = variational_bayes(y[kept], phi, start, self.vbx)
        return soft_labels(gamma, pi, x[kept], x) if self.soft else with_short(y.astype(np.float32), kept, hard_labels(gamma), short)


#: Threshold and least seconds of a cluster for each kind of recording.
DOMAINS = {"voxconverse": (0.45, 4.0), "ami": (0.55, 5.0), "callhome": (0.5, None)}


def clusterer(kind: str, threshold: float | None = None, most: int = 0, domain: str | None = None, cohort: np.ndarray | None = None, top: int = 100, plda: Plda | None = None, windowed: bool = False, reconstruct: bool = False) -> Callable:
    """f(x, start, end) -> labels, by name: ahc, asnorm, nmesc, kmeans or vbx. A domain sets the threshold and prunes short clusters;
    windowed vectors have no order in time; reconstruction prunes under 5 s at least."""
    if domain is not None:
        if domain not in DOMAINS:
            raise ValueError(f"the domain is one of {sorted(DOMAINS)}")
        threshold = DOMAINS[domain][0]
    least = (DOMAINS[domain][1] or 0.0) if domain else 0.0
    least = max(least, 5.0) if reconstruct else least

    def inner(x: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        if kind == "ahc":
            return agglomerate(x, Agglomeration(threshold, most), seconds)
        if kind == "asnorm":
            if cohort is None:
                raise ValueError("asnorm needs a cohort")
            return agglomerate(x, Agglomeration(threshold, most), seconds, normalized_scores(cohort_stats(x, cohort, top)))
        if kind == "nmesc":
            return spectral(x, most or MOST_CANDIDATES)
        if kind == "kmeans":
            return kmeans_clusters(x, most or 12)
        if plda is None:
            raise ValueError("vbx needs a PLDA")
        return VbxClusterer(plda, most=most, vbx=Vbx(loop=0.0 if windowed else 0.9))(x, seconds)

    if kind not in ("ahc", "asnorm", "nmesc", "kmeans", "vbx"):
        raise ValueError("the clusterer is ahc, asnorm, nmesc, kmeans or vbx")
    return lambda x, start, end: prune_short(x, inner(x, end - start), start, end, least)


def min_size(f: Callable, least: int) -> Callable:
    """A clusterer whose small clusters go to the nearest of the others."""
    return lambda x, start, end: prune_small(x, f(x, start, end), least)


def cluster_files(units: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], largest: int = LARGEST) -> DataFrame:
    """units (file, ord, start, end, embedding) with label, by file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > largest:
            raise ValueError(f"{pdf['file'].iloc[0]}: {len(pdf)} vectors, over {largest}")
        pdf = pdf.sort_values("ord", kind="stable")
        x = np.stack([np.asarray(v, dtype=np.float32) for v in pdf["embedding"]])
        return pdf[["file", "ord", "start", "end"]].assign(label=np.asarray(f(x, pdf["start"].to_numpy(float), pdf["end"].to_numpy(float)), dtype=np.int64))

    return units.select("file", "ord", "start", "end", "embedding").groupBy("file").applyInPandas(run, "file string, ord long, start double, end double, label long")


def map_locals(seconds: dict[tuple[int, int], float], apart: list[tuple[int, int]] = ()) -> dict[int, int]:
    """local -> global by most shared seconds one to one. What shares nothing with its column takes a global that no other has, the
    smallest, and where none is left its own most; pairs that must differ are set apart."""
    local, glob = sorted({a for a, _ in seconds}), sorted({g for (_, g), s in seconds.items() if s > 0})
    if not glob:
        return {a: i for i, a in enumerate(local)}
    gain = np.array([[seconds.get((a, g), 0.0) for g in glob] for a in local])
    chosen = best_assignment(gain)
    unused = [j for j in range(len(glob)) if j not in chosen]
    out = {a: glob[j if j >= 0 else unused.pop(0) if unused else int(gain[i].argmax())] for i, (a, j) in enumerate(zip(local, chosen))}
    for a, b in apart:
        if a not in out or b not in out or out[a] != out[b]:
            continue
        shared = out[a]
        weak = a if seconds.get((a, shared), 0.0) <= seconds.get((b, shared), 0.0) else b
        taken = {g for x, g in out.items() if x != weak}
        choices = sorted(((-s, g) for (x, g), s in seconds.items() if x == weak and g != shared and s > 0))
        free = [g for _, g in choices if g not in taken] or [g for _, g in choices]
        if free:
            out[weak] = free[0]
    return out


def map_files(pairs: DataFrame) -> DataFrame:
    """file, local, global_id from file, local, global_id, seconds: the one-to-one mapping of each file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf.groupby(["local", "global_id"])["seconds"].sum()
        got = map_locals({(int(a), int(g)): float(s) for (a, g), s in held.items()})
        return pd.DataFrame({"file": pdf["file"].iloc[0], "local": list(got), "global_id": list(got.values())})

    return pairs.select("file", "local", "global_id", "seconds").groupBy("file").applyInPandas(run, "file string, local long, global_id long")


def repair_windows(window: np.ndarray, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels where no window has one label twice, if others are free: the one farther from its centroid moves to the nearest unused one."""
    labels = labels.copy()
    k = int(labels.max(initial=-1)) + 1
    if k <= 1 or not len(window) == len(x) == len(labels):
        return labels
    sim = cosines(x, centroids_of(x, labels, k))
    for w in np.unique(window):
        rows, holder = np.flatnonzero(window == w), {}
        for i in rows.tolist():
            g = int(labels[i])
            if g not in holder:
                holder[g] = i
                continue
            stay, move = (holder[g], i) if sim[i, g] < sim[holder[g], g] else (i, holder[g])
            holder[g] = stay
            free = np.setdiff1d(np.arange(k), labels[rows])
            if len(free):
                labels[move] = free[int(sim[move, free].argmax())]
                holder[int(labels[move])] = move
    return labels
