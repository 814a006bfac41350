"""Byte-level BPE by a hierarchical-bitmap rank queue.

The bytes of a pre-token form a linked list. Each neighbouring pair whose concatenation is in the
vocabulary waits in the bucket of its rank. A bitmap of 64-bit words marks the buckets in use, a
second one the words in use, a third one those of the second; find-first-set on the three gives
the lowest rank in constant time. Within a bucket the leftmost position comes first. Merging a
pair changes at most two others; entries whose pair has changed since are skipped when they come
up. So a pre-token of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .common import give_back

#: Encoded pre-tokens that a task keeps in each of two generations, and the longest kept.
KEPT, KEPT_CHARS = 250_000, 64
#: Characters of text encoded together, and bytes of results after which a task hands on a batch.
TOGETHER, BATCH = 1 << 20, 8 << 20
#: Bytes of unseen pre-tokens that go through one queue together (a longer one goes alone).
QUEUED = 1 << 20
#: Texts of these characters only are split by an equal pattern with plain ranges, three times as fast.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]*").fullmatch
_PLAIN_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+""").findall


class RankQueue:
    """Buckets of list positions by merge rank; three levels of bitmaps find the lowest rank in use."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def mark(self, rank: int) -> None:
        """Notes that the bucket of ``rank`` is in use."""
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use and its whole bucket, which leaves the queue."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] = word & (word - 1)
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class Codec:
    """Encodes and decodes by a table of ranks (bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern).findall
        self.plain = _PLAIN_PATTERN if pattern == PATTERN else None
        self.token = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.full(1 << 16, -1, np.int32)  # rank of two bytes, -1 if they don't merge
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        """From a file of base64 tokens and ranks, one a line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def split(self, text: str) -> list[str]:
        if self.plain and (text.isascii() and not _CONTROLS(text) or _PLAIN(text)):
            return self.plain(text)
        return self.pattern(text)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token. All go through one queue: no pair reaches over from one to the next."""
        get = self.ranks.get
        text = b"".join(pieces)
        n = len(text)
        starts = np.cumsum([0, *map(len, pieces)])
        first = bytearray(n + 1)  # 1 where a pre-token begins
        for at in starts.tolist():
            first[at] = 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        buckets, mark = queue.buckets, queue.mark
        # Ranks of all pairs of bytes at once, none over the end of a pre-token, and the buckets they fill.
        data = np.frombuffer(text, np.uint8).astype(np.int32)
        found = np.append(self.pairs[data[:-1] << 8 | data[1:]], -1)
        found[starts[1:] - 1] = -1
        pair = found.tolist()
        places = np.flatnonzero(found >= 0)
        places = places[np.argsort(found[places], kind="stable")]
        used, begins = np.unique(found[places], return_index=True)
        token = self.bytes[data].tolist()  # the id of the token that begins at a place
        for rank, part in zip(used.tolist(), np.split(places, begins[1:]), strict=False):
            buckets[rank] = part.tolist()
            mark(rank)

        def push(rank: int, i: int) -> None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                mark(rank)

        while (found := queue.pop()) is not None:
            rank, bucket = found
            bucket.sort()
            for done, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: merged away, or another pair by now
                j = after[i]
                end = after[i] = after[j]
                pair[j] = -1
                token[i] = rank
                lower = False
                if first[end]:
                    pair[i] = -1
                else:
                    before[end] = i
                    new = get(text[i : after[end]])
                    if new is None:
                        pair[i] = -1
                    else:
                        pair[i] = new
                        push(new, i)
                        lower = new < rank
                if end < n:
                    before[end] = i
                if not first[i]:
                    h = before[i]
                    new = get(text[h:end])
                    if new is None:
                        pair[h] = -1
                    else:
                        pair[h] = new
                        push(new, h)
                        lower = lower or new < rank
                if lower and done + 1 < len(bucket):
                    # A lower rank has come up: it goes first, the rest of this bucket waits.
                    buckets[rank] = bucket[done + 1 :]
                    mark(rank)
                    break
        out, at = [], 0
        for piece in pieces:
            stop, ids = at + len(piece), []
            while at < stop:
                ids.append(token[at])
                at = after[at]
            out.append(ids)
        return out

    def _learn(self, unseen: Iterable[str]) -> dict[str, bytes]:
        """Encodes pre-tokens that aren't kept."""
        out, names, pieces, size = {}, [], [], 0

        def flush() -> None:
            for name, ids in zip(names, self.merge(pieces), strict=True):
                out[name] = array("I", ids).tobytes()
            names.clear()
            pieces.clear()

        for name in unseen:
            piece = name.encode("utf-8")
            whole = self.ranks.get(piece)
            if whole is not None:
                out[name] = array("I", (whole,)).tobytes()
                continue
            names.append(name)
            pieces.append(piece)
            size += len(piece)
            if size >= QUEUED:
                flush()
                size = 0
        flush()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as unsigned 32-bit integers (little-endian on all machines that Spark runs on)."""
        split = [self.split(text) for text in texts]
        known, long = self.new, {}
        unseen = set().union(*split).difference(known)
        if unseen:
            old = self.old
            again = [p for p in unseen if p in old]
            unseen.difference_update(again)
            if len(known) >= KEPT:
                # The younger generation is full: it becomes the older one.
                self.old, self.new = known, {p: known[p] for x in split for p in x if p in known}
                known = self.new
            for p in again:
                known[p] = old[p]
            for p, ids in self._learn(unseen).items():
                (known if len(p) <= KEPT_CHARS else long)[p] = ids
        if long:
            return [b"".join([known[p] if p in known else long[p] for p in x]) for x in split]
        get = known.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def forget(self) -> None:
        """Drops the pre-tokens that are kept; the tables stay."""
        self.new, self.old = {}, {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_CONTROLS = re.compile(r"[\x1c-\x1f]").search


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, loaded once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: unsigned 32-bit little-endian), decoded (binary: the bytes of those ids).

    A null text counts as empty: no ids. Every document is encoded whole and on its own, repeated
    rows too; nothing is shuffled, and a task holds one batch of texts at a time. Other columns
    are left out. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def result(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
            codes = own.encode_all(texts)
            start, size, decoded = 0, 0, []
            for i, code in enumerate(codes):
                decoded.append(own.decode(code))
                size += len(code) + len(decoded[-1])
                if size >= BATCH or i + 1 == len(codes):
                    columns = [ids.slice(start, i + 1 - start), pa.array(codes[start : i + 1], pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
                    start, size, decoded = i + 1, 0, []

        try:
            for batch in batches:
                doc_ids, column = batch.column("doc_id"), batch.column("text")
                start, size, texts = 0, 0, []
                for i in range(batch.num_rows):
                    texts.append(column[i].as_py() or "")
                    size += len(texts[-1])
                    if size >= TOGETHER or i + 1 == batch.num_rows:
                        yield from result(doc_ids.slice(start, i + 1 - start), texts)
                        start, size, texts = i + 1, 0, []
                del doc_ids, column
                give_back()
        finally:
            own.forget()  # an idle worker holds the tables alone
            give_back()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids binary, decoded binary")
