"""Live previews from request to display, jobs that a bounded queue admits, and a room's status at each change."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wire
from ..functions.boundary import called
from ..streaming.stateful import confirmed
from .folds import folded
from .lifecycle import live_previews

LANGUAGES = ("vi", "en")


def published(requests: DataFrame, lane: str, build: Callable[[], Callable[[dict], dict]], utterance: Sequence[str] = ("client_id", "turn_id", "utterance_id"), **spans: int) -> DataFrame:
    """utterance, event_id and text of the previews that are shown.

    ``requests``: lane, ts_ms, event_id, is_final, utterance, pcm, language. Only what ``live_previews`` schedules (``spans`` are its own)
    is decoded; a preview that final work cancels is not. The model answers with a line (``wire.recogniser_reply``); a preview in
    another language, one that the quality rules turn away, and a failed one are dropped, as previews may be. What is left is
    shown once a second, similar preview of the same utterance confirms it, and only if it is new. Requests without a lane are never scheduled.
    """
    keys = list(utterance)
    decided = live_previews(requests.select(lane, "ts_ms", "event_id", "is_final"), lane, **spans).where("decision = 'scheduled'").select(lane, "event_id")
    asked = requests.select(lane, *keys, "ts_ms", "event_id", "pcm", "language").join(decided, [lane, "event_id"], "left_semi")
    heard = called(asked, "preview", build, ["pcm", "language"], "reply string").where("error is null")
    heard = heard.select(*keys, F.struct("ts_ms", "event_id").alias("place"), (F.octet_length("pcm") / 32).alias("duration_ms"), wire.recogniser_reply("reply").alias("r"))
    heard = heard.where(F.col("r.ok") & F.col("r.language").isin(*LANGUAGES)).select(*keys, "place", "duration_ms", F.col("r.text").alias("text")).withColumn("w", T.words("text"))
    good = heard.where(T.quality_reason(F.col("text"), F.col("w"), F.col("duration_ms")).isNull())
    return confirmed(good.select(*keys, "place", "text"), keys, "place").select(*keys, "place.event_id", F.col("confirmed").alias("text"))


#: Jobs that wait in a lane at most (fixed value).
CAPACITY = 16


@dataclass
class Queue:
    waiting: list = field(default_factory=list)
    active: set = field(default_factory=set)

    def take(self, kind: str, job, is_final: bool | None, capacity: int) -> Iterator[tuple]:
        """(job, status) of an event: a job is queued at most once while it waits or is worked on, and only if there is room."""
        if kind == "queue":
            if not is_final:
                status = "not-final"
            elif job in self.active or job in self.waiting:
                status = "coalesced"
            elif len(self.waiting) >= capacity:
                status = "queue-full"
            else:
                self.waiting.append(job)
                status = "queued"
            yield job, status
        elif kind == "take" and self.waiting:
            job = self.waiting.pop(0)
            self.active.add(job)
            yield job, "taken"
        elif kind == "done" and job in self.active:
            self.active.remove(job)
            yield job, "done"


def admitted(events: DataFrame, lane: str, order: Sequence[str], job: str = "job", capacity: int = CAPACITY) -> DataFrame:
    """lane, order, job and status (queued, coalesced, queue-full, not-final, taken, done) of each event that has an effect.

    ``events``: lane, order, kind, job, is_final. ``queue`` asks for a job, ``take`` is a worker that is free (its job is the oldest
    that waits, if any), ``done`` ends a job that runs. Other kinds have no effect. A lane's queue is its state; its key
    should be what the queue is bounded for.
    """
    kinds = dict(events.dtypes)

    def one(held: Queue, kind, wanted, is_final, *place) -> list[tuple]:
        return [(*place, *x) for x in held.take(kind, wanted, is_final, capacity)]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*order, job]) + ", status string"
    return folded(events, [lane], list(order), ["kind", job, "is_final", *order], Queue, one, schema)


def room_status(changes: DataFrame, client: str, at_ms: str, seq: str, states: Sequence[str], block_ms: int = 3_600_000) -> DataFrame:
    """room, at_ms, seq, participants and n_<state> of a room after each change of one of its clients.

    ``changes``: client, at_ms, seq (which together tell changes apart), room (null: it has left), state. A client is in one room; a move
    changes the room that it leaves and the one that it joins. Changes count as -1 and +1, and a status is their running
    sum: within blocks of time, after the sums of all blocks before, so that a busy room is many tasks.
    """
    before = Window.partitionBy(client).orderBy(at_ms, seq)
    move = F.array(F.struct(F.lag("room").over(before).alias("room"), F.lag("state").over(before).alias("state"), F.lit(-1).alias("by")), F.struct("room", "state", F.lit(1).alias("by")))
    steps = changes.select(at_ms, seq, move.alias("move")).select(at_ms, seq, F.inline("move")).where("room is not null")
    names = ["participants", *(f"n_{s}" for s in states)]
    counts = [F.sum("by").alias("participants"), *[F.sum(F.when(F.col("state") == s, F.col("by")).otherwise(0)).alias(f"n_{s}") for s in states]]
    one = steps.groupBy("room", at_ms, seq).agg(*counts).withColumn("_block", F.floor(F.col(at_ms) / block_ms))
    blocks = one.groupBy("room", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    earlier = Window.partitionBy("room").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("room", "_block", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in names])
    running = Window.partitionBy("room", "_block").orderBy(at_ms, seq).rowsBetween(Window.unboundedPreceding, 0)
    within = one.select("room", "_block", at_ms, seq, *[F.sum(c).over(running).alias(c) for c in names])
    return within.join(offsets, ["room", "_block"]).select("room", at_ms, seq, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names])
