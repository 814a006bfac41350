"""Secret scans: three fixed patterns, and an assignment-aware lexer that adds what they miss.

The lexer reads source and configuration syntax into pairs of a target name and a value
(``name = "x"``, ``"name": 'x'``, ``name := x``, ``name => x``, ``--name=x``, ``export NAME=x``),
where a value is a literal, another name, several joined by ``+`` or ``.``, a text in triple quotes,
or an indented block after ``|`` or ``>``, whose lines are literals each. Names that stand
for literals are followed to them (constants, through any number of steps). A literal's score is
the sensitivity of the most sensitive name it reaches, times how much it looks like a key rather
than a word, a path or a placeholder. Literals that score at least ``LEAST`` are reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "lexed")
LEAST = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("password", "passwd", "secret", "token", "api")

#: A name and the operator after it. Possessive, and begun only where a run of name characters begins: each character
#: is gone over once, however long the name.
_TARGET = re.compile(
    r"""(?<![A-Za-z0-9_$.\-])[0-9.\-]*+([A-Za-z_$][A-Za-z0-9_$.\-]*+)(?:["']|\\")?+\]?+[ \t]*+"""
    r"""(?:(?<![:=!<>+*/%&|^~-]):?=>?(?![=~])|(?<!:):(?![:=/]))""",
    re.A,
)
_TERM = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([^\s"'`,;()\[\]{}<>&|]+))""", re.A)
_TRIPLE = re.compile(r"""[ \t]*+(\"{3}|'{3})""", re.A)
#: An indented block after a mark, and one of its lines.
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[ \t]*\n((?:[ \t]++[^\n]*+(?:\n|\Z))++)", re.A)
_LINE = re.compile(r"[^\s](?:[^\n]*[^\s])?", re.A)
_JOIN = re.compile(r"[ \t]*(?:\+|\.(?=[ \t]*[\"'])|\.\.)", re.A)
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\-]*", re.A)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)

#: How sensitive the words of a target name are.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "pass": 0.7,
    "signature": 0.6, "salt": 0.6, "jwt": 0.9, "pin": 0.6,
}
_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("account", "key"): 0.9, ("shared", "key"): 0.8, ("connection", "string"): 0.8}
_PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|dummy|redacted|your[_-]|x{4,}|\*{3,}|^\W*$|^(?:true|false|none|null|undefined)$|^[$%{<].*[}%>]?$", re.A)


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    single = max((_SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([single, *(_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


def keylike(value: str) -> float:
    """0 to 1: how much a literal looks like a key."""
    n = len(value)
    if n < 8 or _PLACEHOLDER.search(value) or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes < 2 or value.count("/") > 2 and "://" not in value and "." in value:
        return 0.3
    return min(1.0, entropy / 3.2) * (0.8 + 0.05 * classes)


def _lines(text: str, at: int, missing: set[str]) -> tuple[list[tuple[int, int]], int]:
    """The lines of a value in triple quotes or in an indented block that begins at ``at``, and where it ends.

    No lines for another kind of value. ``missing`` has the quotes that don't occur any more, so that
    no text is searched for them again and again.
    """
    if opened := _TRIPLE.match(text, at):
        end = -1 if opened[1] in missing else text.find(opened[1], opened.end())
        if end >= 0:
            return [m.span() for m in _LINE.finditer(text, opened.end(), end)], end
        missing.add(opened[1])
    elif block := _BLOCK.match(text, at):
        return [m.span() for m in _LINE.finditer(text, block.start(1), block.end(1))], block.end(1)
    return [], at


def lex(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    defined: dict[str, list[int]] = {}
    pairs: list[tuple[str, list[int | str]]] = []
    literals: list[tuple[int, int]] = []
    missing: set[str] = set()
    whole = 0  # where the last value of several lines ends; none begins within it, so each line is taken once
    for target in _TARGET.finditer(text):
        name, parts, at = target[1], [], target.end()
        inside, whole = _lines(text, at, missing) if target.start() >= whole else ([], whole)
        for line in inside:
            literals.append(line)
            parts.append(len(literals) - 1)
        while not inside and (term := _TERM.match(text, at)):
            group = term.lastindex
            bare = group == 3
            value = term[3].rstrip(".:") if bare else ""
            if bare and not value:
                break
            known = bare and _IDENT.fullmatch(value)
            if known:
                parts.append(value)
            if not known or not value.isalpha() or len(value) >= 12:
                start = term.start(group)
                literals.append((start, start + len(value) if bare else term.end(group)))
                parts.append(len(literals) - 1)
            at = term.end()
            more = _JOIN.match(text, at)
            if not more:
                break
            at = more.end()
        if parts:
            pairs.append((name, parts))
            defined.setdefault(name, []).append(len(pairs) - 1)
    # Sensitive names hand their score down to what they are made of.
    reached: dict[int, float] = {}
    score: dict[str, float] = {}
    todo = sorted(((sensitivity(name), name) for name in defined), reverse=True)
    while todo:
        best, name = todo.pop()
        if best <= score.get(name, 0.0):
            continue
        score[name] = best
        for p in defined.get(name, ()):
            for part in pairs[p][1]:
                if isinstance(part, int):
                    reached[part] = max(reached.get(part, 0.0), best)
                elif part != name and part in defined and best > score.get(part, 0.0):
                    todo.append((best, part))
    out = []
    for i, (start, end) in enumerate(literals):
        if i in reached and (s := reached[i] * keylike(text[start:end])) >= LEAST:
            out.append((start, end, s))
    return out


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind: base spans score 1."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = sorted((s, e) for _, s, e, _ in out)
        reach, furthest = [], 0  # base spans by start, with the furthest end so far
        for s, e in base:
            furthest = max(furthest, e)
            reach.append((s, furthest))
        at = 0
        for s, e, score in sorted(set(lex(text))):
            while at < len(reach) and reach[at][0] <= s:
                at += 1
            if not at or reach[at - 1][1] < e:  # else a base span holds it
                out.append(("lexed", s, e, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: an array of (kind, start, end, score) by start, then kind.

    Offsets are code points, the end exclusive. A null text has no spans; repeated rows are kept;
    other columns are left out. Each text is read whole; nothing is shuffled. An empty table gives an
    empty result. Constants are known in their whole text, whatever block they stand in.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = scan(text.as_py() or "")
                rows.append([{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    kind = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(work, kind)
