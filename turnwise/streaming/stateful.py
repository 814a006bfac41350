"""Stateful streams: the folds of the batch operators, kept as state from batch to batch.

Each operator is one pure step; ``folds.folded`` runs it over a key's rows, and
``applyInPandasWithState`` over what has come since. States are pickled, as they hold small Python
objects of bounded size (30 frames of levels, eight vectors a speaker, one text a turn).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import match_ratio
from ..operators import idempotency, identity, turns, vad
from ..operators.folds import folded

_STATE = "state binary"


def _load(state, fresh: Callable):
    return pickle.loads(state.get[0]) if state.exists else fresh()


def vad_stream(frames: DataFrame, limits: vad.Limits = vad.LIMITS, judge: vad.Judge | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Segments of a stream of frames (client_id long, ts_ms, frame_no, rms, peak, and end: the capture's last frame).

    A frame below the newest one seen of its client is out of order; the source must deliver a
    client's frames in order, as a socket does. ``end`` is a client's leaving: what runs is flushed,
    and the client's state goes. With ``timeout_ms`` so does that of a client of which nothing has come
    for so long (by the watermark of a timestamp column, which ``frames`` must then have).
    """

    def work(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, last = _load(state, lambda: (vad.State(), 0))
        out = []
        left = state.hasTimedOut
        if left:
            out += vad.judged(now, vad.finish(now, last, limits), judge, limits)
        else:
            for f in pd.concat(list(batches)).sort_values(["ts_ms", "frame_no"]).itertuples():
                now, last, left = vad.State() if left else now, f.ts_ms, bool(f.end)
                out += vad.judged(now, vad.step(now, f.ts_ms, f.rms, f.peak, limits), judge, limits)
                if left:
                    out += vad.judged(now, vad.finish(now, f.ts_ms, limits), judge, limits)
        if left:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((now, last)),))
            if timeout_ms is not None:
                state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=vad.COLUMNS)
        frame.insert(0, "client_id", key[0])
        yield frame

    wait = "NoTimeout" if timeout_ms is None else "EventTimeTimeout"
    return frames.groupBy("client_id").applyInPandasWithState(work, f"client_id long, {vad.KINDS}", _STATE, "append", wait)


def drain(query, timeout_s: float | None = None) -> dict:
    """Stops a stream once all that has come is processed, so that nothing that waits is lost; what comes later stays
    with the source for the next start from the checkpoint. Gives the last progress. Raises what the stream failed with."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination(timeout_s) if timeout_s is not None else query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return dict(query.lastProgress or {})


def turn_stream(hypotheses: DataFrame) -> DataFrame:
    """Every revision of every turn, as recognised segments come; the steps are those of ``turns.turn_log``."""

    def work(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row = _load(state, lambda: None)
        out = []
        for h in pd.concat(list(batches)).sort_values("segment_index").to_dict("records"):
            row = turns.upsert(row, h)
            out.append(row)
        state.update((pickle.dumps(row),))
        yield pd.DataFrame(out)

    return hypotheses.groupBy(*turns.KEY).applyInPandasWithState(work, turns.UPSERTED, _STATE, "append", "NoTimeout")


def final_turns(turns_stream: DataFrame, gap_ms: int = 1500) -> DataFrame:
    """Turns (client_id, turn_id, ts timestamp) as soon as the watermark passes their last segment by the gap."""

    def work(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame([(*key, last, n)], columns=["client_id", "turn_id", "ended_ms", "segments"])
            return
        group = pd.concat(list(batches))
        last, n = state.get if state.exists else (0, 0)
        last = max(last, int(group["ts"].max().timestamp() * 1000))
        state.update((last, n + len(group)))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))

    schema = "client_id string, turn_id string, ended_ms long, segments long"
    return turns_stream.groupBy("client_id", "turn_id").applyInPandasWithState(work, schema, "last long, n long", "append", "EventTimeTimeout")


def identity_stream(voices: DataFrame, threshold: float = 0.60, single_soft: bool = False) -> DataFrame:
    """Speakers of a stream of voices (room string, id long, v array<float>); a room's voices come in order of id."""

    def work(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        room = _load(state, identity.Room)
        group = pd.concat(list(batches)).sort_values("id")
        found = [identity.assign(room, v, threshold, single_soft) for v in group["v"]]
        state.update((pickle.dumps(room),))
        yield pd.concat([group[["room", "id"]].reset_index(drop=True), pd.DataFrame(found, columns=identity.DECISION)], axis=1)

    return voices.groupBy("room").applyInPandasWithState(work, f"room string, id long, {identity.KINDS}", _STATE, "append", "NoTimeout")


def take(tokens: float, before_us: int | None, now_us: int, size: int, rate: float, burst: float) -> tuple[bool, float]:
    """(accepted, tokens left) of a bucket that refills by ``rate`` bytes a second up to ``burst``."""
    if before_us is not None:
        tokens = min(burst, tokens + max(0, now_us - before_us) / 1e6 * rate)
    return (True, tokens - size) if size <= tokens else (False, tokens)


def admitted(packets: DataFrame, rate: float = 128_000.0, burst: float = 320_000.0) -> DataFrame:
    """client_id, event_id, accepted, tokens: which packets (client_id, ts_us, event_id, size) of each client pass."""
    kind = dict(packets.dtypes)["event_id"]

    def one(held: list, now: int, event, size: int) -> list[tuple]:
        ok, held[0] = take(held[0], held[1], now, size, rate, burst)
        held[1] = now
        return [(event, ok, held[0])]

    return folded(packets, ["client_id"], ["ts_us", "event_id"], ["ts_us", "event_id", "size"], lambda: [burst, None], one, f"event_id {kind}, accepted boolean, tokens double")


def bucket_stream(packets: DataFrame, rate: float = 128_000.0, burst: float = 320_000.0) -> DataFrame:
    """``admitted`` on a stream."""

    def work(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, before = state.get if state.exists else (burst, None)
        out = []
        for p in pd.concat(list(batches)).sort_values(["ts_us", "event_id"]).itertuples():
            ok, tokens = take(tokens, before, p.ts_us, p.size, rate, burst)
            before = p.ts_us
            out.append((key[0], p.event_id, ok, tokens))
        state.update((float(tokens), int(before)))
        yield pd.DataFrame(out, columns=["client_id", "event_id", "accepted", "tokens"])

    return packets.groupBy("client_id").applyInPandasWithState(work, "client_id long, event_id long, accepted boolean, tokens double", "tokens double, before long", "append", "NoTimeout")


def confirm(candidate: str, hits: int, last: str, text: str, least: float = 0.72) -> tuple[str, int, str, str | None]:
    """(candidate, hits, last shown, text to show or None): a preview needs a second, similar one, and must be new."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.casefold())
    if not candidate or match_ratio(words(candidate), words(text)) < least:
        return text, 1, last, None
    if hits + 1 < 2 or text == last:
        return candidate, hits + 1, last, None
    return candidate, hits + 1, text, text


def confirmed(previews: DataFrame, keys: Sequence[str], order: str = "preview") -> DataFrame:
    """keys, ``order`` and confirmed: the previews (keys, ``order``, text) that a second, similar one confirms."""
    kind = dict(previews.dtypes)[order]

    def one(held: list, place, text: str | None) -> list[tuple]:
        *held[:], shown = confirm(*held, text or "")
        return [] if shown is None else [(place, shown)]

    return folded(previews, keys, [order], [order, "text"], lambda: ["", 0, ""], one, f"`{order}` {kind}, confirmed string")


def idempotent_stream(requests: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Status of a stream of requests (key string, fingerprint string, at_ms long, seq long, ok boolean)."""

    def work(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, 0]
        rows = pd.concat(list(batches)).sort_values(["at_ms", "seq"]).itertuples()
        out = [(key[0], r.seq, idempotency.decide(held, r.fingerprint, r.at_ms, r.ok, ttl_ms)) for r in rows]
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["key", "seq", "idempotency_status"])

    return requests.groupBy("key").applyInPandasWithState(work, "key string, seq long, idempotency_status string", "held string, until long", "append", "NoTimeout")
