"""Where models are called: injected callables, one instance in each Python worker, retried once.

No model is built in. Everything before and after a call is in the other modules.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize


class Postprocessor(Protocol):
    mode: str

    def process_text(self, text: str) -> str: ...


class Lower:
    mode = "clean_lower"

    def process_text(self, text: str) -> str:
        return normalize(text, True)


class Keep:
    mode = "normalize"

    def process_text(self, text: str) -> str:
        return normalize(text, False)


class Nothing:
    mode = "none"

    def process_text(self, text: str) -> str:
        return text


MODES: dict[str, Callable[[], Postprocessor]] = {"clean_lower": Lower, "normalize": Keep, "none": Nothing}


class Unavailable(Exception):
    """A call that may succeed when tried again."""


#: Instances that a Python worker keeps; the one longest unused goes first.
KEPT = 4
_models: OrderedDict[str, Any] = OrderedDict()


def builder_key(name: str, build: Callable[[], Any]) -> str:
    """What an instance is known by in workers, which Spark reuses: its builder with all that it closes over, and a name for people."""
    return f"{name}:{hashlib.sha256(cloudpickle.dumps(build)).hexdigest()}"


def single(key: str, build: Callable[[], Any]) -> Any:
    """The worker's only instance of a model, built at its first use; ``key``: from ``builder_key``, taken where the query is made."""
    if key in _models:
        _models.move_to_end(key)
    else:
        while len(_models) >= KEPT:
            _models.popitem(last=False)
        _models[key] = build()
    return _models[key]


def retried(f: Callable[..., Any], *args: Any) -> Any:
    """Once more after a call that was unavailable or late; other errors are raised at once."""
    try:
        return f(*args)
    except (Unavailable, TimeoutError):
        return f(*args)


def postprocessed(text: Column, mode: str, build: Callable[[], Postprocessor] | None = None) -> Column:
    make = build or MODES[mode]
    key = builder_key(f"post:{mode}", make)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        tool = single(key, make)
        return column.map(lambda t: retried(tool.process_text, t or ""))

    return run(text)


def combined(parts: list[str], mode: str = "normalize") -> str:
    """Texts of segments joined and normalised by mode."""
    return MODES[mode]().process_text(" ".join(p for p in parts if p))


def called(rows: DataFrame, name: str, build: Callable[[], Callable[[dict], dict]], inputs: list[str], outputs: str, where: str | None = None, error: str = "error") -> DataFrame:
    """``rows`` with what a model says of each (``outputs``: columns of the reply) and ``error`` (null if it succeeded).

    A reply lacks nothing that is in ``outputs``; an error leaves those null and does not stop the rest.
    ``where``: a column that tells which rows the model is called for; the others' replies are null.
    """
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes) + f", {outputs}, {error} string"
    names = [p.split()[0] for p in outputs.split(", ")]
    key = builder_key(name, build)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = single(key, build)
        for batch in batches:
            found = []
            wanted = [True] * len(batch) if where is None else batch[where].eq(True)
            for row, asked in zip(batch[inputs].to_dict("records"), wanted, strict=True):
                try:
                    found.append({**dict.fromkeys(names), **(retried(model, row) if asked else {}), error: None})
                except Exception as e:  # the reply of a failed call is its error
                    found.append({**dict.fromkeys(names), error: f"{type(e).__name__}: {e}"})
            # Columns of objects keep whole numbers whole beside nulls.
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=[*names, error], dtype=object)], axis=1)

    return rows.mapInPandas(work, schema)


def recognised(segments: DataFrame, build: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Segments (pcm, language, …) with text; blank texts are kept as empty."""
    return called(segments, "asr", build, ["pcm", "language"], "text string, confidence double")


def embedded(segments: DataFrame, build: Callable[[], Callable[[dict], dict]], least_ms: int = 1000) -> DataFrame:
    """Segments long enough for a voice embedding, with ``v``; eight seconds are used at most."""
    long = segments.where(F.col("audio_ms") >= least_ms).withColumn("pcm", F.substring("pcm", F.lit(1), F.lit(8 * 32_000)))
    return called(long, "embed", build, ["pcm"], "v array<float>")


def diarised(segments: DataFrame, build: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """One row a region of each segment: start, end (samples), label; sorted by the model."""
    out = called(segments, "diarise", build, ["pcm"], "regions array<struct<start:int,end:int,label:int>>")
    return out.select(*segments.columns, F.explode("regions").alias("r")).select(*segments.columns, "r.start", "r.end", "r.label")


def beam(mode: Column) -> Column:
    """Beam of a translation mode."""
    return F.when(F.lower(mode).isin(*WIDE), 2).otherwise(1)


#: Target languages by direction; models may begin their output with it and a colon.
TARGETS = {"vi-en": "en", "en-vi": "vi"}
WIDE = ("beam2", "qa", "retry", "2")


def translated(turns: DataFrame, build: Callable[[], Callable[[dict], dict]], direction: str = "en-vi") -> DataFrame:
    """Final turns with their translation: chunks, one call each, joined; quality and anchors checked; failures have a status.

    The model is given direction, text and beam, which a column ``translation_mode`` may widen (see ``beam``). The target
    language that an output begins with is taken off. The check against the turn's present revision is ``turns.not_stale``.
    """
    from ..operators.align import translation_chunks
    from .numerals import anchor_reason

    if direction not in TARGETS:
        raise ValueError(f"unsupported direction {direction}")
    prefix = re.compile(rf"\s*{TARGETS[direction]}:\s*")
    modes = ["translation_mode"] if "translation_mode" in turns.columns else []

    def make() -> Callable[[dict], dict]:
        model = build()

        def turn(row: dict) -> dict:
            wide = 2 if str(row.get("translation_mode") or "").lower() in WIDE else 1
            parts = [model({"direction": direction, "text": c, "beam": wide})["text"] for c in translation_chunks(row["translation_input_text"])]
            parts = [prefix.sub("", p, count=1) if prefix.match(p) else p for p in parts if p]
            text = " ".join(" ".join(p.split()) for p in parts if p.strip())
            reason = "empty" if not text else anchor_reason(row["translation_input_text"], text)
            return {"translation": None if reason else text, "translation_status": reason or "ok"}

        return turn

    return called(turns.where("is_final"), f"translate:{direction}", make, ["translation_input_text", *modes], "translation string, translation_status string")


def line_reply(line: str) -> dict:
    """Reply of a line protocol: one JSON object with ``ok`` and the rest."""
    try:
        reply = json.loads(line)
    except ValueError:
        raise Unavailable("no reply") from None
    if not reply.get("ok"):
        raise Unavailable(reply.get("error") or "no reply")
    return reply


class LineWorker:
    """A child process or socket that answers one JSON line with one JSON line.

    ``connect`` gives a pair (send a line, receive a line). It is called at the first request and again
    after any failure, as a late reply would otherwise be taken for the next one's; so a worker that
    hangs or dies costs one request. One request at a time: a task has its own worker.
    """

    def __init__(self, connect: Callable[[], tuple[Callable[[str], None], Callable[[], str]]]):
        self.connect, self.pair = connect, None

    def ask(self, command: str, **fields: Any) -> dict:
        try:
            if self.pair is None:
                self.pair = self.connect()
            send, receive = self.pair
            send(json.dumps({"command": command, **fields}, ensure_ascii=False))
            return line_reply(receive())
        except Exception:
            self.pair = None
            raise


class LinePostprocessor:
    """A ``Postprocessor`` behind a line worker."""

    mode = "worker"

    def __init__(self, connect: Callable[[], tuple[Callable[[str], None], Callable[[], str]]]):
        self.worker = LineWorker(connect)

    def ready(self) -> bool:
        return bool(self.worker.ask("ping").get("ok"))

    def process_text(self, text: str) -> str:
        return self.worker.ask("process_text", text=text)["text"]


def serve(line: str, tool: Postprocessor) -> str:
    """The other side: one reply line to one request line; an error is a reply too, and never ends the worker."""
    try:
        request = json.loads(line)
        if request["command"] == "ping":
            reply: dict = {"ok": True}
        elif request["command"] == "process_text":
            reply = {"ok": True, "text": tool.process_text(request["text"])}
        else:
            raise ValueError(f"unknown command {request['command']}")
    except Exception as e:  # told to whoever asked
        reply = {"ok": False, "error": f"{type(e).__name__}: {e}"}
    return json.dumps(reply, ensure_ascii=False)
