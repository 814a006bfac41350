"""Idempotent requests: who leads, who gets the cached answer, who conflicts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from .folds import folded

TTL_MS, MOST = 24 * 3600 * 1000, 10_000


def decide(held: list, fingerprint: str | None, at_ms: int, ok: bool, ttl_ms: int = TTL_MS) -> str:
    """The status of a key's next request; ``held`` (fingerprint, until when) is what its answer leaves.

    created: the first of its key, or the first after the answer has expired or failed. cached:
    equal fingerprint while the answer lives. conflict: another fingerprint while it lives.
    Answers of failures aren't kept. Batch and streaming share this step.
    """
    if held[0] is not None and held[1] > at_ms:
        return "cached" if held[0] == fingerprint else "conflict"
    held[:] = (fingerprint, at_ms + ttl_ms) if ok else (None, 0)
    return "created"


def statuses(requests: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """``requests`` (key, fingerprint, at_ms, seq, ok) with key_hash and idempotency_status, in the order (at_ms, seq) of each key."""
    kinds = dict(requests.dtypes)
    names = ["at_ms", "seq", "fingerprint", "ok"]

    def one(held: list, at_ms: int, seq, fingerprint: str | None, ok: bool) -> list[tuple]:
        return [(at_ms, seq, fingerprint, ok, decide(held, fingerprint, at_ms, ok, ttl_ms))]

    outputs = ", ".join(f"{c} {kinds[c]}" for c in names) + ", idempotency_status string"
    out = folded(requests, ["key"], ["at_ms", "seq"], names, lambda: [None, 0], one, outputs)
    return out.select("key", sha256(F.col("key").cast("string")).alias("key_hash"), *names, "idempotency_status")


def loadable(records: DataFrame, now_ms: int) -> DataFrame:
    """Unexpired successes."""
    return records.where((F.col("expires_at_ms") > now_ms) & F.col("status").between(200, 299))


def cache_to_load(records: DataFrame, now_ms: int, most: int = MOST) -> DataFrame:
    """Unexpired successes, the latest expiries first, ``most`` of them."""
    return loadable(records, now_ms).orderBy(F.desc("expires_at_ms"), "key_hash").limit(most)


def files_to_delete(records: DataFrame, most: int = MOST) -> DataFrame:
    """All but the ``most`` newest."""
    newest = records.orderBy(F.desc("expires_at_ms"), "key_hash").limit(most).select("key_hash")
    return records.join(newest, "key_hash", "left_anti")


def to_evict(records: DataFrame, most: int = MOST) -> DataFrame:
    """Completed entries that expire soonest, as many as are over ``most``.

    That is all completed ones but the newest, as many as the entries in work leave room for.
    """
    newest = records.where("completed").orderBy(F.desc("expires_at_ms"), F.desc("key_hash")).limit(most)
    room = F.lit(most) - records.where("not completed").agg(F.count("*")).scalar()
    # At most ``most`` rows are numbered here.
    place = F.row_number().over(Window.orderBy(F.desc("expires_at_ms"), F.desc("key_hash")))
    kept = newest.withColumn("_place", place).where(F.col("_place") <= room).select("key_hash")
    return records.where("completed").join(kept, "key_hash", "left_anti")


def coalesced_jobs(jobs: DataFrame, running: DataFrame, key: str = "turn_id") -> DataFrame:
    """One job a key, none for keys that run already."""
    first = Window.partitionBy(key).orderBy("seq")
    return jobs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(running, key, "left_anti")


LEASE_MS = 3600 * 1000
#: A key's state: who works on which fingerprint since when, who waits, and whose answer is kept until when.
STATE = "fingerprint string, leader string, since_ms long, waiters array<string>, answered_by string, until_ms long"
RESOLVED = ["request_id", "idempotency_status", "answered_by", "ok", "resolved_ms"]
RESOLVED_KINDS = "request_id string, idempotency_status string, answered_by string, ok boolean, resolved_ms long"


@dataclass
class Key:
    """Requests of one idempotency key: at most one of them is worked on."""

    fingerprint: str | None = None
    leader: str | None = None
    since_ms: int = 0
    waiters: list[str] = field(default_factory=list)
    answered_by: str | None = None
    until_ms: int = 0

    def idle(self) -> bool:
        return self.leader is None and self.answered_by is None

    def next_ms(self, lease_ms: int) -> int | None:
        """When something ends if nothing more comes: a lease, or an answer's life."""
        return self.since_ms + lease_ms if self.leader is not None else self.until_ms if self.answered_by is not None else None

    def elapse(self, now_ms: int, lease_ms: int = LEASE_MS) -> Iterator[tuple]:
        """What ends up to ``now_ms``: expired answers are forgotten, leaders whose lease is over are aborted."""
        while (end := self.next_ms(lease_ms)) is not None and end <= now_ms:
            if self.leader is None:
                self.answered_by = self.fingerprint = None
            else:
                yield from self._aborted(end)

    def _aborted(self, at_ms: int) -> Iterator[tuple]:
        """The first that waits leads instead."""
        yield self.leader, "aborted", None, None, at_ms
        self.leader = self.waiters.pop(0) if self.waiters else None
        self.since_ms = at_ms
        if self.leader is None:
            self.fingerprint = None

    def take(self, kind: str, request: str, fingerprint: str | None, at_ms: int, ok: bool | None, ttl_ms: int = TTL_MS, lease_ms: int = LEASE_MS) -> Iterator[tuple]:
        """One event: ``begin`` of a request, or ``finish`` (with ``ok``) or ``abort`` of a leader; those of others do nothing."""
        yield from self.elapse(at_ms, lease_ms)
        if kind == "begin":
            if self.idle():
                self.fingerprint, self.leader, self.since_ms = fingerprint, request, at_ms
            elif self.fingerprint != fingerprint:
                yield request, "conflict", None, None, at_ms
            elif self.leader is None:
                yield request, "cached", self.answered_by, True, at_ms
            else:
                self.waiters.append(request)
        elif request != self.leader or self.leader is None:
            return
        elif kind == "abort":
            yield from self._aborted(at_ms)
        else:
            yield request, "created", request, bool(ok), at_ms
            for waiter in self.waiters:
                yield waiter, "coalesced", request, bool(ok), at_ms
            self.leader, self.waiters = None, []
            if ok:
                self.answered_by, self.until_ms = request, at_ms + ttl_ms
            else:
                self.fingerprint = None


def resolved(events: DataFrame, ttl_ms: int = TTL_MS, lease_ms: int = LEASE_MS) -> DataFrame:
    """key and RESOLVED of each request, from events (key, at_ms, seq, kind, request_id, fingerprint, ok) in the order (at_ms, seq) of each key.

    created: a leader's own answer; coalesced: of those that waited for it, errors too; cached: while a
    success lives; conflict: another fingerprint meanwhile; aborted: a leader that gave up, or whose lease
    ended, after which the first that waits leads. Requests still open at the end have no row.
    """
    columns = ["kind", "request_id", "fingerprint", "at_ms", "ok"]

    def one(held: Key, *values) -> list[tuple]:
        return list(held.take(*values, ttl_ms=ttl_ms, lease_ms=lease_ms))

    return folded(events, ["key"], ["at_ms", "seq"], columns, Key, one, RESOLVED_KINDS)
