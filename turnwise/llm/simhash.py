"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most four bits are linked; a document's class is its connected
component. The search for links uses covering codes. The 64 bits are split into A (23 bits),
B (23 bits) and C (15 and 3 bits). If x and y differ in at most four bits, then A and B together
differ in at most two; or else C differs in at most one, and

- C is equal and A, or B, differs in at most two, or
- C differs in one bit and A, or B, in at most one.

So each pair of fields, (A, B), (A, C) and (B, C), has anchors of its own. Those of A and B are the
words of the binary Golay code, whose balls of radius 3 cover all 23-bit words exactly once; those of
C are the words of the Hamming code of 15 bits, with balls of radius 1, together with the 3 bits as
they are. A fingerprint is at home at one anchor of each pair, and visits every anchor within
covering radius plus the bits that may differ. Two linked fingerprints so meet at the home of
either, where they are compared bit by bit: about 210 visits a fingerprint, and 1 / 170,000 of all
pairs of unrelated ones compared. No anchor stands for fewer than 24 bits of choice.

Equal fingerprints are merged before the search, so a group of copies is one row in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut, trimmed, unused
from .components import components

THRESHOLD = 4
A_BITS, B_BITS, C_BITS, D_BITS = 23, 23, 15, 3
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Fingerprints whose visits one task makes.
TOGETHER = 20_000
_LANES = 0x100000001


def mark(text: Column) -> Column:
    """A hash that tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """One row a document: row, doc_id, mark (a hash of the text), fp (the 64 bits as a long).

    Null and blank texts have fingerprint 0. Repeated rows stay apart (``row`` tells them
    apart). The bits of all shingles are summed two to a long, so that no array of counters
    has to be carried.
    """
    words = F.split(trimmed(ascii_lower(F.col("text"))), SPACES, -1)
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", mark(F.col("text")).alias("mark"), words.alias("w")).select(
        "row", "doc_id", "mark", "w", F.size("w").alias("n")
    )
    names = [f"w{i}" for i in range(shingle)]
    many = F.arrays_zip(*[F.slice("w", i + 1, F.col("n") - (shingle - 1)).alias(x) for i, x in enumerate(names)])
    kind = "array<struct<" + ",".join(f"{x}:string" for x in names) + ">>"
    few = F.array(F.struct(F.concat_ws(" ", "w").alias("w0"), *[F.lit(None).cast("string").alias(x) for x in names[1:]]))
    none = F.lit(None).cast(kind)
    shingles = (
        F.when(F.col("w").isNull() | (F.array_join(F.slice("w", 1, 2), "") == ""), none)
        .when(F.col("n") < shingle, few.cast(kind))
        .otherwise(many.cast(kind))
    )
    rows = base.select("row", "doc_id", "mark", F.inline_outer(shingles)).select(
        "row", "doc_id", "mark", F.when(F.col("w0").isNotNull(), F.xxhash64(F.concat_ws(" ", *names))).alias("h")
    )
    sums = rows.groupBy("row", "doc_id", "mark").agg(
        F.count("h").alias("n"),
        *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"s{i}") for i in range(32)],
    )

    def bit(count: Column, i: int) -> Column:
        return F.when(count * 2 > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0))

    bits = [bit(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(32)]
    bits += [bit(F.shiftrightunsigned(F.col(f"s{i}"), 32), i + 32) for i in range(32)]
    return sums.select("row", "doc_id", "mark", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def _field(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _syndrome(word: Column) -> Column:
    """Which coset of the Golay code a 23-bit word is in: its remainder by the generator polynomial."""
    out = None
    remainders = []
    for i in range(A_BITS):
        r = 1 << i
        for k in range(A_BITS - 1, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        remainders.append(r)
    for j in range(11):
        mask = sum(1 << i for i in range(A_BITS) if remainders[i] >> j & 1)
        one = F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), j)
        out = one if out is None else out.bitwiseOR(one)
    return out


def _errors(spark) -> DataFrame:
    """For each of the 2,048 cosets: its words of weight at most 3, 4 and 5 (as e0, e1, e2).

    A word minus one of them is an anchor within that distance. 44,552 words in all, whatever
    the data, so the table can be broadcast.
    """
    words = spark.range(0, 1 << A_BITS, 1, 16).where(F.bit_count("id") <= 5)
    words = words.select(_syndrome(F.col("id")).cast("int").alias("s"), F.col("id").cast("int").alias("e"))
    up_to = lambda w: F.collect_list(F.when(F.bit_count("e") <= w, F.col("e")))
    return words.groupBy("s").agg(up_to(3).alias("e0"), up_to(4).alias("e1"), up_to(5).alias("e2"))


def _hamming(word: Column, within: int) -> Column:
    """Words of the Hamming code within 1 or 2 bits of a 15-bit word, as an array."""
    syndrome = [sum(1 << (i - 1) for i in range(1, 16) if i >> j & 1) for j in range(4)]
    s = [F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), j) for j, m in enumerate(syndrome)]
    coset = reduce(lambda x, y: x.bitwiseOR(y), s)
    errors: list[list[int]] = [[] for _ in range(16)]
    for i in range(16):
        for j in range(i + 1):
            e = (1 << i >> 1) ^ (1 << j >> 1) if i != j else 0
            bits = bin(e).count("1")
            at = (i if i != j else 0) ^ (j if i != j else 0)
            if bits <= within and e not in errors[at]:
                errors[at].append(e)
    table = F.array(*[F.array(*[F.lit(e).cast("long") for e in row]) for row in errors])
    return F.transform(F.element_at(table, coset + 1), lambda e: word.bitwiseXOR(e))


def anchors(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, visits): fp and anchor of each. ``distinct``: fp, unique."""
    spark = distinct.sparkSession
    at = {"a": (0, A_BITS), "b": (A_BITS, B_BITS), "c": (A_BITS + B_BITS, C_BITS), "d": (64 - D_BITS, D_BITS)}
    fields = {x: _field(F.col("fp"), *place) for x, place in at.items()}
    parts = distinct.select("fp", *[f.alias(x) for x, f in fields.items()])
    parts = parts.select("*", _syndrome(F.col("a")).cast("int").alias("sa"), _syndrome(F.col("b")).cast("int").alias("sb"))
    errors = cut(_errors(spark))
    for x in "ab":
        named = [F.col(k).alias(f"{x}{k}") for k in ("e0", "e1", "e2")]
        parts = parts.join(F.broadcast(errors.select(F.col("s").alias(f"s{x}"), *named)), f"s{x}")
    # The codeword of C's home with D above it, and those of words that differ from C and D in one bit.
    home = _hamming(F.col("c"), 1)[0].bitwiseOR(F.shiftleft("d", C_BITS))
    near = [F.transform(_hamming(F.col("c"), 2), lambda w: w.bitwiseOR(F.shiftleft(F.col("d"), C_BITS)))]
    near += [F.array(home.bitwiseXOR(F.lit(1 << (C_BITS + i)))) for i in range(D_BITS)]
    parts = parts.select("fp", "a", "b", *[f"{x}e{t}" for x in "ab" for t in range(3)], home.alias("h"), F.concat(*near).alias("near"))
    parts = parts.withColumn("near", F.filter("near", lambda w: w != F.col("h")))

    def pair(x: Column, y: Column, mark: int) -> Column:
        """An anchor of two fields; the marks tell pairs of fields apart, so that one join serves all."""
        return x.bitwiseOR(F.shiftleft(y, A_BITS)).bitwiseOR(F.lit(mark << 60))

    word = lambda x, e: F.col(x).bitwiseXOR(e.cast("long"))
    cross = lambda xs, ys, make: F.flatten(F.transform(xs, lambda p: F.transform(ys, lambda q: make(p, q))))
    only = lambda t, s, x: F.filter(F.col(f"{x}e{t}"), lambda e: F.bit_count(e) > s)
    ab = lambda p, q: pair(word("a", p), word("b", q), 0)
    homes = [ab(F.col("ae0")[0], F.col("be0")[0])]
    visits = [cross(F.col("ae1"), F.col("be1"), ab), cross(F.col("ae0"), only(2, 4, "b"), ab), cross(only(2, 4, "a"), F.col("be0"), ab)]

    def with_c(x: str, mark: int) -> None:
        homes.append(pair(word(x, F.col(f"{x}e0")[0]), F.col("h"), mark))
        visits.append(F.transform(f"{x}e2", lambda p: pair(word(x, p), F.col("h"), mark)))
        visits.append(cross(F.col(f"{x}e1"), F.col("near"), lambda p, w: pair(word(x, p), w, mark)))

    with_c("a", 1)
    with_c("b", 2)
    return parts.select("fp", F.explode(F.array(*homes)).alias("anchor")), parts.select("fp", F.explode(F.concat(*visits)).alias("anchor"))


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of fingerprints that differ in 1 to 4 bits. ``distinct``: fp, unique."""
    homes, visits = anchors(distinct)
    x, y = homes.alias("x"), visits.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= THRESHOLD
    met = x.join(y, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.fp") < F.col("y.fp")) & near)
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _roots(prints: DataFrame) -> DataFrame:
    """fp, root of each fingerprint: the least fingerprint that is reached from it."""
    distinct = cut(prints.select("fp").distinct())
    # A row makes some 210 visits: small partitions before, even ones after.
    spread = distinct.repartition(max(8, -(-distinct.count() // TOGETHER)), "fp")
    roots = components(links(spread))
    return cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def _with_roots(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, mark, fp, root of every row. Adding 0 leaves both sides to be shuffled for the join, so that
    Spark can split the partition of a fingerprint that very many documents have."""
    prints = cut(fingerprints(docs, shingle).select("doc_id", "mark", "fp"))
    roots = _roots(prints).select((F.col("fp") + 0).alias("fp"), "root")
    return prints.select("doc_id", "mark", (F.col("fp") + 0).alias("fp")).join(roots, "fp")


def classes(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id of its class of near-duplicates.

    Rows with fingerprint 0 (null and blank texts) are linked like any other. Null ids count for
    no component_id unless a class has no other. Repeated rows come out as often as they went in.
    An empty table gives an empty result.
    """
    rows = cut(_with_roots(docs, shingle))
    least = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = least.select((F.col("root") + 0).alias("root"), "component_id")
    return rows.select("doc_id", "fp", (F.col("root") + 0).alias("root")).join(named, "root").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the one with the least id (nulls last) stays.

    Of rows that repeat an id and a text one stays, whichever it is where they differ in other
    columns. All columns stay, whatever their names. Null and blank texts are one class. An empty
    table gives an empty result.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark"))
    # Two digests that are never null stand for id and text: the texts are dealt by them once, for the join and for repeats.
    digests = lambda doc_id, text: [F.xxhash64(F.lit(i), doc_id, text) for i in (1, 2)]
    kept = _with_roots(docs, shingle).groupBy("root").agg(first.alias("k"))
    names = [unused(docs.columns, f"simhash_key{i}") for i in (1, 2)]
    kept = kept.select(*[d.alias(n) for d, n in zip(digests(F.col("k.doc_id"), F.col("k.mark")), names, strict=True)])
    marked = docs.withColumns(dict(zip(names, digests(F.col("doc_id"), mark(F.col("text"))), strict=True)))
    return marked.join(kept, names, "left_semi").dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns])


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
