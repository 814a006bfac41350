"""The gate before recognition: captures are held for a moment, so that those of one speech leave it together.

A capture waits until ``hold_ms`` have passed since the oldest one waiting came; then that one, the
seed, leaves with all that wait and are of the same capture window. A gate with ``capacity`` captures
lets more pass on their own. Times are event times, so batch and stream give the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded
from .intervals import END_DELTA_MS, OVERLAP, PEAK_RATIO, RMS_RATIO, START_DELTA_MS
from .sessions import stretches

HOLD_MS, CAPACITY = 500, 128
COLUMNS = ["utterance_id", "client_id", "received_ms", "started_ms", "ended_ms", "avg_rms", "peak_rms"]
OUTPUTS = ["group_id", "utterance_id", "is_dominant", "echo_suspected", "bypassed", "forwarded_ms"]


class Capture(NamedTuple):
    utterance_id: int
    client_id: int
    received_ms: int
    started_ms: int
    ended_ms: int
    avg_rms: float
    peak_rms: float


class Limits(NamedTuple):
    hold_ms: int = HOLD_MS
    capacity: int = CAPACITY
    start_delta_ms: int = START_DELTA_MS
    end_delta_ms: int = END_DELTA_MS
    overlap: float = OVERLAP
    rms_ratio: float = RMS_RATIO
    peak_ratio: float = PEAK_RATIO


LIMITS = Limits()


def same_window(a: Capture, b: Capture, limits: Limits = LIMITS) -> bool:
    """Two clients' captures that start and end together and overlap by most of the shorter one."""
    shared = min(a.ended_ms, b.ended_ms) - max(a.started_ms, b.started_ms)
    shorter = min(max(1, x.ended_ms - x.started_ms) for x in (a, b))
    near = abs(a.started_ms - b.started_ms) <= limits.start_delta_ms and abs(a.ended_ms - b.ended_ms) <= limits.end_delta_ms
    return a.client_id != b.client_id and near and max(0, shared) / shorter >= limits.overlap


def echo(loud: Capture, weak: Capture, limits: Limits = LIMITS) -> bool:
    """Whether ``weak`` is likely what another microphone heard of ``loud``."""
    heard = loud.avg_rms > 0 and weak.avg_rms > 0 and same_window(loud, weak, limits)
    return heard and loud.avg_rms / max(weak.avg_rms, 1e-9) >= limits.rms_ratio and loud.peak_rms / max(weak.peak_rms, 1e-9) >= limits.peak_ratio


def leaving(waiting: list[Capture], limits: Limits = LIMITS) -> Iterator[tuple]:
    """The group of the oldest capture that waits, taken out of ``waiting``."""
    seed = waiting[0]
    group = [seed, *(x for x in waiting[1:] if same_window(seed, x, limits))]
    waiting[:] = [x for x in waiting if x not in group]
    loud = max(group, key=lambda x: (x.avg_rms, x.peak_rms))
    for x in group:
        yield seed.utterance_id, x.utterance_id, x is loud, x is not loud and echo(loud, x, limits), False, seed.received_ms + limits.hold_ms


def due(waiting: list[Capture], now_ms: int | None, limits: Limits = LIMITS) -> Iterator[tuple]:
    """Groups whose hold is over before ``now_ms``; all of them without it."""
    while waiting and (now_ms is None or waiting[0].received_ms + limits.hold_ms < now_ms):
        yield from leaving(waiting, limits)


def arrived(waiting: list[Capture], new: Capture, limits: Limits = LIMITS) -> Iterator[tuple]:
    """What leaves as ``new`` comes: groups whose hold is over, and ``new`` itself if the gate is full."""
    yield from due(waiting, new.received_ms, limits)
    if len(waiting) >= limits.capacity:
        yield new.utterance_id, new.utterance_id, True, False, True, new.received_ms
    else:
        waiting.append(new)


def kinds(utterances: DataFrame) -> str:
    kind = dict(utterances.dtypes)["utterance_id"]
    return f"group_id {kind}, utterance_id {kind}, is_dominant boolean, echo_suspected boolean, bypassed boolean, forwarded_ms long"


def gated(utterances: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """room and OUTPUTS of each capture (room and COLUMNS), those of a room in the order (received_ms, utterance_id).

    ``group_id`` is the seed's utterance. A room is folded in stretches between pauses longer than the hold, as nothing
    waits by then; a task holds what waits at a gate only. Null rooms are a room.
    """
    cut = stretches(utterances, ["room"], F.col("received_ms"), ["received_ms", "utterance_id"], limits.hold_ms, "stretch")

    def one(waiting: list[Capture], *values) -> list[tuple]:
        return list(arrived(waiting, Capture(*values), limits))

    out = folded(cut, ["room", "stretch"], ["received_ms", "utterance_id"], COLUMNS, list, one, kinds(utterances), lambda waiting: list(due(waiting, None, limits)))
    return out.drop("stretch")
