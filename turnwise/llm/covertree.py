"""Exact top-k by inner product: a dual-tree search on two cover trees.

A node stands for a set of rows: a centre that is one of them, and a covering radius. Its children
have centres further apart than a share of that radius, and each of its rows lies within that
share of its child's centre. Queries and rows get a tree each. For a query node (centre p, radius
a) and a row node (centre c, radius b) ``vectors.upper`` bounds the inner products of p with the
row node; those of the other queries differ by no more than a times the longest row. If that
lies below the worst kth score among the queries of the node, the pair is pruned with all below.
A query's kth score is known from the start: from the block that it visited first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import ROUNDING, distances, search, upper, usable

SCALE = 64
#: Sets of rows and groups of queries up to these sizes are not divided further.
LEAF, GROUP = 32, 16
#: Reach of a child's centre as a share of its parent's radius.
SHRINK = 0.75
#: A set is not divided if more than this share of a bounded sample of it would be centres: its rows lie apart from each other.
APART, LOOKED_AT = 0.4, 512
#: Queries without close neighbours among each other that are handled together.
LOOSE = 64
#: Row nodes that a group of queries opens or scores at first.
BATCH = 8


class Tree:
    """Nodes in arrays: centre (a row's position), radius, longest row, children, and for leaves their rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.centre, self.radius, self.largest, self.children, self.rows = [], [], [], [], []
        self._grow()
        self.centre, self.radius, self.largest = np.array(self.centre), np.array(self.radius), np.array(self.largest)

    def _node(self, rows: np.ndarray, centre: int) -> int:
        gap = self.x[rows] - self.x[centre]
        self.centre.append(centre)
        self.radius.append(float(np.sqrt((gap * gap).sum(axis=1).max())))
        self.largest.append(float(self.norm[rows].max()))
        self.children.append(None)
        self.rows.append(rows)
        return len(self.centre) - 1

    def _grow(self) -> None:
        todo = [self._node(np.arange(len(self.x)), 0)]
        while todo:
            at = todo.pop()
            rows = self.rows[at]
            if len(rows) <= self.leaf or self.radius[at] == 0:
                continue
            if self._apart(rows, self.radius[at] * SHRINK):
                continue
            children = [self._node(part, centre) for part, centre in self._net(rows, self.centre[at], self.radius[at] * SHRINK)]
            self.children[at], self.rows[at] = np.array(children), None
            todo += children

    def _apart(self, rows: np.ndarray, reach: float) -> bool:
        """Whether hardly any rows lie within ``reach`` of each other, so that children would hold little more than their centres."""
        some = self.x[rows[:: max(1, len(rows) // LOOKED_AT)][:LOOKED_AT]]
        near = distances(some, some) <= reach
        free, centres = np.ones(len(some), bool), 0
        for i in range(len(some)):
            if free[i]:
                centres += 1
                free &= ~near[i]
                free[i] = False
        return centres > APART * len(some)

    def _net(self, rows: np.ndarray, centre: int, reach: float) -> list[tuple[np.ndarray, int]]:
        """Centres further apart than ``reach`` such that each row has one within it, and the rows nearest to each."""
        x = self.x[rows]
        pick = int(np.flatnonzero(rows == centre)[0])
        far, owner, centres = np.full(len(rows), np.inf), np.zeros(len(rows), int), []
        while True:
            d = distances(x, x[pick : pick + 1])[:, 0]
            d[pick] = 0
            closer = d < far
            owner[closer] = len(centres)
            far[closer] = d[closer]
            centres.append(rows[pick])
            pick = int(far.argmax())
            if far[pick] <= reach:
                break
        order = np.argsort(owner, kind="stable")
        return list(zip(np.split(rows[order], np.searchsorted(owner[order], np.arange(1, len(centres)))), centres, strict=True))

    def below(self) -> list[np.ndarray]:
        """The rows below each node."""
        out = list(self.rows)
        for at in reversed(range(len(out))):
            if out[at] is None:
                out[at] = np.concatenate([out[c] for c in self.children[at]])
        return out


_NO_ID = np.iinfo(np.int64).max


class _Best:
    """The k best of each query so far, as one array of scores and one of positions, worst last."""

    def __init__(self, floor: np.ndarray, k: int, ids: np.ndarray, kind: type):
        self.k, self.ids, self.floor = k, ids, floor
        self.score = np.full((len(floor), k), -np.inf, kind)
        self.row = np.full((len(floor), k), -1)

    def worst(self, queries: np.ndarray) -> np.ndarray:
        """What a row must reach to count, for each query."""
        return np.maximum(self.score[queries, self.k - 1], self.floor[queries])

    def offer(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """scores: a line for each query, a column for each row; -inf where a pair doesn't count."""
        # Only what reaches a query's kth score so far is sorted in; equal scores too, for their ids.
        reach = (scores >= self.worst(queries)[:, None]) & (scores > -np.inf)
        for i in np.flatnonzero(reach.any(axis=1)):
            at, q = np.flatnonzero(reach[i]), queries[i]
            new = scores[i, at]
            if len(new) > self.k:
                top = new >= np.partition(new, len(new) - self.k)[len(new) - self.k]
                at, new = at[top], new[top]
            both, row = np.concatenate([self.score[q], new]), np.concatenate([self.row[q], rows[at]])
            ident = np.where(row >= 0, self.ids[row], _NO_ID)
            if both.dtype == object:
                keep = sorted(range(len(both)), key=lambda j, s=both, d=ident: (-s[j], d[j]))[: self.k]
            else:
                keep = np.lexsort((ident, -both))[: self.k]
            self.score[q], self.row[q] = both[keep], row[keep]


def top(ids, x, q_ids, q, floor, k, scored: list | None = None):
    """One block of whole-numbered vectors: positions of queries and rows and their integer scores.

    ``scored`` gets the number of pairs whose inner product was computed, those for bounds
    included. Where components are so large that doubles would round, scores are whole numbers
    of any size, held to a long's range, in the same search.
    """
    wide = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] >= 2.0**53
    exact_x, exact_q = x, q
    if wide:
        whole = np.frompyfunc(int, 1, 1)
        exact_x, exact_q = whole(x), whole(q)
        floor = np.where(np.isfinite(floor), floor - np.abs(floor) * 1e-9, floor)
    data, asks = Tree(x), Tree(q, GROUP)
    under = asks.below()
    # A set whose children are single queries for the most part isn't divided: nothing would be known of a child that isn't of it.
    ends = [c is None or 2 * len(c) > len(u) for c, u in zip(asks.children, under, strict=True)]
    best = _Best(floor, k, ids, object if wide else float)
    count = 0

    def prune(node: int, nodes: np.ndarray) -> np.ndarray:
        """Of ``nodes``, those that may hold a row for a query of the query node."""
        nonlocal count
        count += len(nodes)
        p, c = asks.centre[node], data.centre[nodes]
        bound = upper(x[c] @ q[p], asks.norm[p], data.norm[c], data.radius[nodes], data.largest[nodes])
        return nodes[bound + asks.radius[node] * data.largest[nodes] * (1 + ROUNDING) >= best.worst(under[node]).min()]

    def visit(node: int, nodes: np.ndarray) -> None:
        """Both trees are descended together until a group of queries is no longer divided."""
        while len(nodes := prune(node, nodes)):
            if ends[node]:
                for at in range(0, len(under[node]), LOOSE):
                    group(under[node][at : at + LOOSE], nodes)
                return
            inner = np.array([data.children[m] is not None for m in nodes])
            if not inner.any() or asks.radius[node] > 2 * data.radius[nodes].max():
                break
            nodes = np.concatenate([nodes[~inner], *(data.children[m] for m in nodes[inner])])
        if len(nodes):
            for child in asks.children[node]:
                visit(child, nodes)

    def group(members: np.ndarray, fresh: np.ndarray) -> None:
        """Most promising nodes first, a few to begin with, then more at a time."""
        nonlocal count
        own, batch = asks.norm[members][:, None], BATCH
        nodes, bounds = np.empty(0, int), np.empty((len(members), 0))
        while len(nodes) or len(fresh):
            if len(fresh):
                count += len(fresh) * len(members)
                c = data.centre[fresh]
                more = upper(q[members] @ x[c].T, own, data.norm[c], data.radius[fresh], data.largest[fresh])
                nodes, bounds, fresh = np.concatenate([nodes, fresh]), np.hstack([bounds, more]), np.empty(0, int)
            worst = best.worst(members)[:, None]
            alive = (bounds >= worst).any(axis=0)
            nodes, bounds = nodes[alive], bounds[:, alive]
            gain = (bounds - np.maximum(worst.astype(float), -1e300)).max(axis=0, initial=-np.inf)
            order = np.argsort(-gain, kind="stable")
            now, nodes, bounds = nodes[order[:batch]], nodes[order[batch:]], bounds[:, order[batch:]]
            batch *= 4
            leaves = [data.rows[m] for m in now if data.children[m] is None]
            if leaves:
                rows = np.concatenate(leaves)
                score(members, rows)
            opened = [data.children[m] for m in now if data.children[m] is not None]
            if opened:
                fresh = np.concatenate(opened)

    def score(members: np.ndarray, rows: np.ndarray) -> None:
        nonlocal count
        count += len(rows) * len(members)
        scores = exact_q[members] @ exact_x[rows].T
        if wide:
            scores = np.minimum(np.maximum(scores, -(2**63)), 2**63 - 1)
        scores[q_ids[members][:, None] == ids[rows][None, :]] = -np.inf
        best.offer(members, rows, scores)

    def seed(members: np.ndarray, centre: int) -> None:
        """A first kth score for each query of a group that lies together: from the rows about its centre."""
        nonlocal count
        nodes, rows = [0], []
        while nodes and sum(map(len, rows)) <= 2 * k:
            m = nodes.pop()
            if data.children[m] is None:
                if len(data.rows[m]) > 8 * data.leaf:
                    return  # undivided: it is scored as a whole anyway
                rows.append(data.rows[m])
            else:
                c = data.children[m]
                count += len(c)
                nodes += c[np.argsort(x[data.centre[c]] @ q[centre], kind="stable")[-4 * k :]].tolist()
        score(members, np.concatenate(rows))

    for node in range(len(asks.centre)):
        if asks.children[node] is None and len(under[node]) > 1 and not np.isfinite(floor[under[node]]).all():
            seed(under[node], asks.centre[node])
    # What the seeds found counts as a score to reach only, as the search comes to those rows again.
    best = _Best(best.worst(np.arange(len(q))), k, ids, object if wide else float)
    visit(0, np.array([0]))
    if scored is not None:
        scored.append(count)
    at, place = np.nonzero(best.score > -np.inf)
    return at, best.row[at, place], best.score[at, place].astype(np.int64)


def exact_top(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of floor(64 x) for each query.

    Queries are the rows whose vec_id ``every`` divides. Rows with a null id, and vectors that are
    null, empty or hold null or non-finite components, take no part; zero vectors do. Ties go to
    the smaller vec_id; rows that repeat an id with equal vectors count once, and an id with
    different vectors is a row for each. Scores beyond a long's range are held to it. Of an empty
    table the result is empty; other columns are left out.
    """
    rows = usable(embeddings, zero_too=True).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    return search(rows, top, "long", k=k, every=every)
