"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Each block of rows is projected on random lines, and the projections of each line are sorted.
A row collides with a query on a line if it lies in a window around the query's own projection.
The windows widen level by level (virtual rehashing): a level stands for a radius R and its
windows have half-width R * WIDTH; only the rings that a level adds are counted. A row at distance
d collides on a line with chance erf(R WIDTH / (d sqrt 2)), so collisions order rows by distance.
Rows are verified by their true score down to the threshold: the collisions that a row at the kth
distance found so far falls short of with a chance of some SLACK deviates only. Those that collide
most are verified first, as their kth distance raises the threshold for the others. The search ends with the first level whose radius
holds k verified rows; a query that comes with a score to reach starts at that score's radius.
Queries are counted many at a time: a window is a range of places on a sorted line, so one
comparison of places tells for all rows whether they are in it.

Inner products become distances by one extra coordinate, sqrt(M^2 - |x|^2) with M the largest norm
of the block: for a query scaled to norm M the squared distance is 2 M^2 - 2 M q.x / |q|.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
from pyspark.sql import DataFrame

from .vectors import search, usable

LINES = 64
WIDTH = 1.0
#: Rows that a query looks at to guess its first radius, the share of their least distance that it is, and the least radius.
GLANCE, SHARE, START, GROWTH = 256, 0.7, 0.05, 1.4
#: Normal deviates by which the threshold lies below the expected collisions of a row at the kth distance.
SLACK = 1.6
#: Rows of each query that are verified at first, the ones that collide most; their kth distance sets the threshold for the rest.
VERIFIED = 256
#: Queries whose windows are widened together, and the share of pairs up to which they are verified one by one.
TOGETHER, SPARSE = 128, 0.02
SEED = 20


def threshold(lines: int, radius, distance):
    """Collisions in windows of ``radius`` that a row at ``distance`` nearly always has."""
    share = radius * WIDTH / np.maximum(distance, 1e-12) / sqrt(2)
    p = _erf(share)
    return lines * p - SLACK * np.sqrt(lines * p * (1 - p))


def _erf(x):
    return np.vectorize(erf, otypes=[float])(x)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of pairs (a row of each) summed from the first component to the last, whatever their number."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[:, j]
    return total


class Lines:
    """The sorted projections of a block on each line, and each row's place among them."""

    def __init__(self, unit: np.ndarray, lines: int):
        self.n, self.lines = len(unit), lines
        self.line = np.random.default_rng(SEED).standard_normal((unit.shape[1], lines))
        at = (unit @ self.line).T
        order = np.argsort(at, axis=1, kind="stable")
        self.at = np.take_along_axis(at, order, axis=1)
        self.place = np.empty((lines, self.n), np.uint32 if self.n >= 1 << 16 else np.uint16)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=self.place.dtype)[None], axis=1)

    def window(self, centre: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in the window of each query (a line each) on each line, and the place after its last."""
        low, high = np.empty(centre.shape, np.int64), np.empty(centre.shape, np.int64)
        for j in range(self.lines):
            low[:, j] = np.searchsorted(self.at[j], centre[:, j] - half, "left")
            high[:, j] = np.searchsorted(self.at[j], centre[:, j] + half, "right")
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query the number of lines on which each row lies in its window."""
        counts = np.zeros((len(low), self.n), np.uint8)
        from_low, inside = np.empty(counts.shape, self.place.dtype), np.empty(counts.shape, bool)
        low, size = low.astype(self.place.dtype), (high - low).astype(self.place.dtype)
        for j in range(self.lines):
            # One comparison for both ends: places before the window wrap around to large numbers.
            np.subtract(self.place[j][None, :], low[:, j, None], out=from_low)
            np.less(from_low, size[:, j, None], out=inside)
            counts += inside.view(np.uint8)
        return counts


def nearest(ids, x, q_ids, q, floor, k, lines: int = LINES, verified: list | None = None):
    """One block: positions of queries and rows and their inner products, the ``k`` best found of each query.

    ``verified`` gets the number of rows whose inner product was computed for each query.
    """
    norms = np.sqrt((x * x).sum(axis=1))
    largest = norms.max()
    own = np.sqrt((q * q).sum(axis=1))
    unit = np.column_stack([x / largest, np.sqrt(np.maximum(0, 1 - (norms / largest) ** 2))])
    index = Lines(unit, lines)
    centres = np.column_stack([q / own[:, None], np.zeros(len(q))]) @ index.line
    out = [], [], []
    for start in range(0, len(q), TOGETHER):
        some = slice(start, start + TOGETHER)
        at, of, score, totals = _some(ids, x, q_ids[some], q[some], floor[some], k, index, centres[some], own[some] * largest)
        out[0].append(at + start)
        out[1].append(of)
        out[2].append(score)
        if verified is not None:
            verified.extend(totals.tolist())
    return tuple(np.concatenate(a) for a in out)


def _some(ids, x, q_ids, q, floor, k, index: Lines, centres, scale):
    """``nearest`` of a few queries, whose windows are widened level by level together."""
    n, m = len(ids), len(q)
    itself = ids[None, :] == q_ids[:, None]
    others = n - itself.sum(axis=1)
    score = np.full((m, n), -np.inf)
    known = floor > -np.inf
    distance = lambda s, which: np.sqrt(np.maximum(0.0, 2 - 2 * s / scale[which]))
    # Only rows that reach the floor are asked for: their radius is the one level needed.
    glance = np.where(itself[:, :: max(1, n // GLANCE)], -np.inf, q @ x[:: max(1, n // GLANCE)].T).max(axis=1)
    guess = SHARE * distance(np.maximum(glance, -scale), slice(None))
    radius = np.clip(np.where(known, distance(np.where(known, floor, 0.0), slice(None)) * (1 + 1e-9), guess), START, 2.0)
    seen = itself.copy()
    kth, total = floor.copy(), np.zeros(m, int)

    def verify(which: np.ndarray, chosen: np.ndarray) -> None:
        """Scores of the chosen rows (a line for each query of ``which``): pair by pair where they are few, else as one product."""
        if chosen.sum() <= SPARSE * chosen.size:
            i, j = np.nonzero(chosen)
            score[which[i], j] = np.einsum("ij,ij->i", q[which[i]], x[j])
        else:
            held = score[which]
            np.copyto(held, q[which] @ x.T, where=chosen)
            score[which] = held
        total[which] += chosen.sum(axis=1)
        seen[which] |= chosen
        full = which[total[which] >= k]
        if len(full):
            kth[full] = np.maximum(kth[full], np.partition(score[full], n - k, axis=1)[:, n - k])

    active = np.arange(m)
    while len(active):
        low, high = index.window(centres[active], radius[active])
        # A level whose windows can't hold one row often enough is passed over.
        enough = ((high - low).sum(axis=1) >= threshold(index.lines, radius[active], radius[active])) | (radius[active] >= 2)
        now = active[enough]
        if len(now):
            counts = index.collisions(low[enough], high[enough])
            counts[seen[now]] = 0
            for first in (True, False):
                reach = np.where(kth[now] > -np.inf, distance(kth[now], now), radius[now])
                least = np.maximum(threshold(index.lines, radius[now], reach), 1)
                if first and n > VERIFIED:
                    most = np.partition(counts, n - VERIFIED, axis=1)[:, n - VERIFIED]
                    least = np.maximum(least, most)
                chosen = counts >= least[:, None]
                verify(now, chosen)
                counts[chosen] = 0
            last = now[(radius[now] >= 2) & (total[now] < k) & ~known[now]]
            if len(last):  # fewer than k rows have collided often enough: the rest is verified
                verify(last, ~seen[last])
            near = np.where(total[now] >= k, distance(kth[now], now), np.inf)
            ended = known[now] | (total[now] >= others[now]) | (near <= radius[now]) | (radius[now] >= 2)
            active = np.setdiff1d(active, now[ended])
        radius[active] = np.minimum(2.0, radius[active] * GROWTH)
    least = floor.copy()
    if n > k:
        least = np.maximum(least, np.partition(score, n - k, axis=1)[:, n - k])
    slack = np.where(least > -np.inf, 1e-9 * np.maximum(1.0, np.abs(least)), 0.0)
    i, j = np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))
    exact = _exact(x[j], q[i])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return i[best], j[best], exact[best], total


def approximate_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score (inner product) of the ``k`` nearest rows found for each query.

    Queries are the rows whose vec_id ``every`` divides. Rows with a null id, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part. Ties go to the smaller
    vec_id; rows that repeat an id with equal vectors count once, and an id with different vectors is
    a row for each. Of an empty table the result is empty; other columns are left out.
    """
    return search(usable(embeddings, zero_too=False), nearest, "double", k=k, every=every)
