"""Personal data: four fixed kinds, and identifiers found by bootstrapped contextual extraction.

The fixed kinds (e-mail, IP address, card number, phone number) are the seeds, whatever their form
or length. Every other token that holds a digit is an instance. Patterns are the words about it on
its line, their digits generalised: the one, two or three words before it (a label that it is glued
to is one of them), the word before with the word after, and the two words after. Patterns and instances form a
graph, which is scored in rounds until nothing new is accepted: a pattern's confidence is the
smoothed share of its occurrences that are seeds or accepted instances; it is good if that reaches
ACCEPT with SUPPORT different ones. What stands in a good pattern is accepted there. An accepted
instance that can hardly be anything else (letters and digits mixed, or SPECIFIC digits) is
accepted wherever it stands, and so raises the confidence of further patterns in the next round;
a short number is not, so that patterns don't drift to whatever such numbers stand in.

All of it is DataFrame operations. A match's offsets come from the lengths of the pieces between
matches, which ``split`` gives, so that no text is passed to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

KINDS = ("email", "ip", "card", "phone")
#: Share of a pattern's tokens that must be known for it to discover others, and different instances it needs.
ACCEPT, SUPPORT = 0.9, 5
#: Pseudo-count of unknown tokens that each pattern starts with.
SMOOTHING = 1.0
#: Digits that make an instance without letters specific.
SPECIFIC = 6
#: More rounds than this are an error: each accepts something new, and chains of patterns are short.
ROUNDS = 200
#: Matches whose offsets are summed together; sums of sums keep texts with very many matches cheap.
TOGETHER = 256

# Possessive and anchored so that no text makes the matcher go over the same characters again and
# again; each finds what the plain pattern beside it finds, without the matches that would be dropped.
_WORD = "A-Za-z0-9._%+-"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<![{_WORD}])|\G)[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ of 16 digits or more
    "card": r"[0-9](?:[\x20-]?[0-9]){15}(?:[\x20-]?[0-9])*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _luhn(digits: Column) -> Column:
    """Whether the last digit is right: from the right, every second digit counts twice, 9 less if over 9."""
    n = F.length(digits)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(
            (n - i) % 2 == 1,
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str, hint: str | None = None) -> tuple[Column, Column]:
    """(what lies between the matches, the matches)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    if hint is None:
        return between, found
    has = F.contains(text, F.lit(hint))
    return F.when(has, between).otherwise(F.array(text)), F.when(has, found).otherwise(F.array().cast("array<string>"))


#: Words before a match, read from its end backwards: punctuation and symbols next to the match don't count, but
#: ``:``, ``=`` and ``#`` are part of the last word. And words after a match.
_LEFT = r"\A[\x20\t\p{P}\p{S}&&[^:=#]]*+([^\s]++(?:[\x20\t]++[^\s]++){0,2})"
_RIGHT = r"\A[\x20\t\p{P}\p{S}]*+([^\s]++(?:[\x20\t]++[^\s]++)?)"


_MATCH = "struct<start:long,end:long,text:string,left:string,right:string>"


def _words(text: Column) -> Column:
    """Words as patterns have them: lower case, without punctuation before them, digits generalised."""
    plain = F.regexp_replace(F.lower(text), r"(?<!\S)\p{P}++(?=\S)", "")
    return F.regexp_replace(F.regexp_replace(plain, "[0-9]++", "9"), r"[\x20\t]++", " ")


def _left(text: Column) -> Column:
    """The last three words, or as many as there are, of what comes before a match on its line."""
    return _words(F.reverse(F.regexp_extract(F.reverse(text), _LEFT, 1)))


def _right(text: Column) -> Column:
    """The first two words, or as many as there are, of what comes after a match on its line, without punctuation at their ends."""
    return F.regexp_replace(_words(F.regexp_extract(text, _RIGHT, 1)), r"(?<=\S)\p{P}++(?!\S)", "")


def _offsets(between: Column, found: Column) -> Column:
    """(start, end, text, left, right) of each match: running sums of lengths, summed in groups, and the words about it.

    Words are looked for up to the next matches on either side, themselves included.
    """
    kind = f"array<{_MATCH}>"
    n = F.size(found)

    def group(at: Column, position: Column) -> Column:
        """Of the matches from index ``at`` on, where ``position`` characters come before."""
        start = F.struct(position.alias("position"), F.array().cast(kind).alias("out"))
        index = F.sequence(at, F.least(at + TOGETHER, n) - 1)

        def step(acc: Column, i: Column) -> Column:
            s = acc["position"] + F.length(F.get(between, i))
            e = s + F.length(F.get(found, i))
            left = _left(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(between, i)))
            right = _right(F.concat(F.get(between, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))))
            match = F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), F.get(found, i).alias("text"), left.alias("left"), right.alias("right"))
            return F.struct(e.cast("long").alias("position"), F.concat(acc["out"], F.array(match)).alias("out"))

        return F.aggregate(index, start, step)

    def outer(acc: Column, at: Column) -> Column:
        return F.aggregate(
            F.array(group(at, acc["position"])),
            acc,
            lambda a, got: F.struct(got["position"].alias("position"), F.concat(a["out"], F.array(got["out"])).alias("out")),
        )

    zero = F.struct(F.lit(0).cast("long").alias("position"), F.array().cast(f"array<{kind}>").alias("out"))
    whole = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(TOGETHER)), zero, outer)
    return F.when(n == 0, F.array().cast(kind)).otherwise(F.flatten(whole["out"]))


#: A token with a digit, of any length, and one with the label that it is glued to.
_TOKEN = r"(?<!\S)(?=[^\s0-9]*+[0-9])\S++"
_LABEL = r"\A([^\s]*[:=#])[^\s0-9]*+[0-9]"


#: A node of the graph as it stands in a text.
_NODE = "struct<start:long,end:long,text:string,left:string,right:string,seed:boolean>"


def _node(start: Column, end: Column, text: Column, left: Column, right: Column, seed: bool) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"), left.alias("left"), right.alias("right"), F.lit(seed).alias("seed"))


def _valid(kind: str) -> Column:
    """(start, end, text, left, right) of the valid matches of one fixed kind."""
    kept = F.filter(_offsets(F.col(f"{kind}_b"), F.col(f"{kind}_m")), lambda s: valid(kind, s["text"]))
    return F.when(F.size(f"{kind}_m") > 0, kept).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _spans(kind: str) -> Column:
    """(kind, start, end) of the valid matches of one fixed kind."""
    return F.transform(f"{kind}_v", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _glued(s: Column) -> Column:
    """The node of a token's part after a glued label with a letter, in an array; an empty one if it has none."""
    label = F.regexp_extract(s["text"], _LABEL, 1)
    n = F.length(label)
    left = F.trim(F.concat_ws(" ", s["left"], _words(label)))
    node = _node(s["start"] + n, s["end"], F.substring(s["text"], n + 1, F.length(s["text"])), left, s["right"], False)
    return F.when(label.rlike(r"\p{L}"), F.array(node)).otherwise(F.array().cast(f"array<{_NODE}>"))


def _patterns(left: Column, right: Column) -> Column:
    """The patterns that an occurrence stands in: ``_`` is where it stands."""
    before, after = F.split(left, " "), F.split(right, " ")
    last = lambda n: F.when((left != "") & (F.size(before) >= n), F.concat(F.array_join(F.slice(before, -n, n), " "), F.lit(" _")))
    both = F.when((left != "") & (right != ""), F.concat(F.element_at(before, -1), F.lit(" _ "), F.element_at(after, 1)))
    follow = F.when(F.size(after) >= 2, F.concat(F.lit("_ "), right))
    return F.filter(F.array(last(1), last(2), last(3), both, follow), lambda p: p.isNotNull())


def found(docs: DataFrame) -> DataFrame:
    """key, doc_id, base, candidates of every row, cut off from the texts.

    base: array of (kind, start, end), kinds in the order of KINDS, then by start. candidates:
    array of nodes: all base spans (the longest of those that start
    together) as seeds, and all tokens with a digit; a node is (start, end, text, left, right, seed). ``key`` names a row by its id and whole text,
    so equal rows share it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    pieces = {}
    for kind, pattern in PATTERNS.items():
        between, matches = _pieces(F.col("text"), pattern, _HINTS[kind])
        pieces[f"{kind}_b"], pieces[f"{kind}_m"] = between, matches
    pieces["token_b"], pieces["token_m"] = _pieces(F.col("text"), _TOKEN)
    rows = rows.withColumns(pieces).withColumns({f"{kind}_v": _valid(kind) for kind in KINDS})
    base = F.concat(*[_spans(k) for k in KINDS])
    ordered = F.array_sort(F.concat(*[F.transform(f"{k}_v", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right"))) for k in KINDS]))
    rows = rows.withColumns({"ordered": ordered, "tokens": _offsets(F.col("token_b"), F.col("token_m"))})
    first = F.filter("ordered", lambda s, i: (i == 0) | (F.get("ordered", i - 1)["start"] != s["start"]))
    candidate = F.concat(
        F.transform(first, lambda s: _node(s["start"], -s["back"], s["text"], s["left"], s["right"], True)),
        F.transform("tokens", lambda s: _node(s["start"], s["end"], s["text"], s["left"], s["right"], False)),
        F.flatten(F.transform("tokens", _glued)),
    )
    key = F.concat_ws(":", F.xxhash64("doc_id", "text").cast("string"), F.length("text").cast("string"), F.crc32(F.col("text").cast("binary")).cast("string"))
    return cut(rows.select(key.alias("key"), "doc_id", base.alias("base"), candidate.alias("candidates")))


def discovered(rows: DataFrame) -> DataFrame:
    """key, start, end of the tokens that patterns discover beyond the base spans; ``rows`` as of ``found``.

    A token that touches a base span is none of its own: the span stands for it.
    """
    inside = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    tokens = rows.select("key", "base", F.explode("candidates").alias("c")).where(F.col("c.seed") | ~inside)
    tokens = tokens.select("key", "c.start", "c.end", F.col("c.text").alias("instance"), "c.seed", _patterns(F.col("c.left"), F.col("c.right")).alias("patterns"))
    # The graph: how often a pattern holds an instance. One row an edge, not an occurrence.
    graph = tokens.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    graph = cut(graph.withColumn("known", F.col("seed")))
    # A pattern of fewer instances than SUPPORT can never be good.
    able = graph.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT).select("pattern")
    graph = cut(graph.join(able, "pattern", "left_semi"))
    specific = (F.col("instance").rlike(r"\p{L}")) | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= SPECIFIC)
    for _ in range(ROUNDS):
        known = F.when(F.col("known"), F.col("n")).otherwise(0)
        scored = graph.groupBy("pattern").agg((F.sum(known) / (F.sum("n") + SMOOTHING)).alias("confidence"), F.sum(F.col("known").cast("int")).alias("instances"))
        good = cut(scored.where((F.col("confidence") >= ACCEPT) & (F.col("instances") >= SUPPORT)).select("pattern"))
        if good.isEmpty():
            break
        accepted = graph.where("not known").join(good, "pattern", "left_semi")
        accepted = cut(accepted.select("pattern", "instance", specific.alias("everywhere")))
        if accepted.isEmpty():
            break
        here = accepted.select("pattern", "instance", F.lit(True).alias("here"))
        there = accepted.where("everywhere").select("instance", F.lit(True).alias("there")).distinct()
        graph = graph.join(here, ["pattern", "instance"], "left").join(there, "instance", "left")
        graph = cut(graph.withColumn("known", F.col("known") | F.coalesce("here", F.lit(False)) | F.coalesce("there", F.lit(False))).drop("here", "there"))
    else:
        raise RuntimeError(f"patterns still discover new instances after {ROUNDS} rounds")
    unseeded = tokens.where("not seed").select("key", "start", "end", "instance", "patterns")
    by_pattern = unseeded.select("key", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
    new = graph.where("known and not seed").where(specific).select("instance").distinct()
    by_instance = unseeded.join(new, "instance", "left_semi")
    names = ["key", "start", "end"]
    return by_pattern.select(*names).unionByName(by_instance.select(*names)).distinct()


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row: arrays of (kind, start, end) in code points, the end exclusive.

    ``base`` holds the fixed kinds, ``spans`` those and then what patterns discovered (kind
    ``context``), each kind by start. Null and empty texts have none. Repeated rows come out as
    often as they went in. Of an empty table the result is empty; other columns are left out.
    """
    rows = found(docs)
    kind = "array<struct<kind:string,start:long,end:long>>"
    more = discovered(rows).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("more"))
    more = more.select("key", F.transform("more", lambda s: F.struct(F.lit("context").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("more"))
    out = rows.select("key", "doc_id", "base").join(more, "key", "left")
    return out.select("doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(kind))).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first (the longer of two that start together) hides
    the others. Null texts stay null; all columns and rows stay, whatever the columns' names. Repeated
    rows are masked alike. An empty table gives an empty result.
    """
    names = docs.columns
    mine, list_ = unused(names, "pii_key"), unused(names, "pii_spans")
    key = F.concat_ws(":", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).cast("string"), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("string"))
    rows = found(docs)
    context = discovered(rows).select("key", F.lit("context").alias("kind"), "start", "end")
    base = rows.where(F.size("base") > 0).select("key", F.inline("base")).distinct()
    spans = base.unionByName(context).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias(list_))
    both = docs.withColumn(mine, key).join(spans.withColumnRenamed("key", mine), mine, "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        hidden = s["start"] < acc["at"]
        parts = F.when(hidden, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(clear, mark)))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.col(list_).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.aggregate(list_, zero, step, finish))
    return both.withColumn("text", text).select(*names)
