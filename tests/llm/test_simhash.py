"""Fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from turnwise.llm import components, simhash


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(prints):
    """doc position → least position reached."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_classes(docs):
    rng = random.Random(3)
    vocabulary = ["Lorem", "ipsum", "É", "dolor", "Übung", "ⅷ", "漢字", "a", "b", "The"]
    rows = [(i, " \t".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    base = " ".join(f"word{i}" for i in range(400))
    rows += [(100 + i, base.replace(f"word{i * 40}", "other")) for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, "one"), (204, "ONE"), (205, "x" * 100_000), (206, "a  b\nc")]
    got = {r.doc_id: r for r in simhash.classes(docs(rows, extra=True)).collect()}
    prints = [fingerprint(t) for _, t in rows]
    expected = classes(prints)
    for (i, _), fp, root in zip(rows, prints, expected):
        assert got[i].fp & (1 << 64) - 1 == fp
        assert got[i].component_id == min(rows[j][0] for j in range(len(rows)) if expected[j] == root)


def test_links_equal_brute_force(spark):
    rng = random.Random(9)
    words = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = rng.getrandbits(64)
        words.add(centre)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            words.add(x)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(w,) for w in signed], "fp long")).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == expected


def test_golay_code_covers_each_word_once(spark):
    e = simhash._errors(spark).agg(F.count("*"), F.min(F.size("e0")), F.max(F.size("e0")), F.sum(F.size("e2"))).first()
    assert tuple(e) == (2048, 1, 1, 44552)


def test_hamming_code(spark):
    words = spark.range(1 << 15).select("id", simhash._hamming(F.col("id"), 1).alias("h"), simhash._hamming(F.col("id"), 2).alias("n"))
    got = words.agg(F.max(F.size("h")), F.min(F.size("h")), F.count_distinct(F.col("h")[0]), F.max(F.bit_count(F.col("id").bitwiseXOR(F.col("h")[0]))), F.min(F.size("n")), F.max(F.size("n"))).first()
    assert tuple(got) == (1, 1, 1 << 11, 1, 1, 8)  # a codeword has no other within two bits


def test_few_comparisons(spark):
    """Visits a fingerprint and comparisons of unrelated ones are as the anchors' numbers say."""
    n = 40_000
    distinct = spark.range(n).select(F.xxhash64("id").alias("fp"))
    homes, visits = simhash.anchors(distinct)
    assert homes.count() == 3 * n
    assert 195 * n < visits.count() < 220 * n
    met = homes.alias("x").join(visits.alias("y"), "anchor").where(F.col("x.fp") != F.col("y.fp")).count()
    assert met < n * n / 150_000 + 10 * n**0.5
    longest = homes.groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert longest <= 4


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 9), (9, 7), (3, 4), (8, 4), (9, 9)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == nodes
    for a, b in edges:
        if a != b:
            assert got[a] == got[b]
    assert all(got[r] == r and r <= n for n, r in got.items())


def test_repeated_rows_survivors_and_empty(docs):
    rows = [(5, "same text of many words here"), (3, "same text of many words here"), (3, "same text of many words here"), (None, "lonely document without an id at all"), (9, None), (8, "")]
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.classes(docs(rows)).collect()) == sorted([("5", "3"), ("3", "3"), ("3", "3"), ("None", "None"), ("9", "8"), ("8", "8")])
    kept = simhash.survivors(docs(rows, extra=True)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "8", "None"]
    assert simhash.classes(docs([])).count() == simhash.survivors(docs([])).count() == 0
