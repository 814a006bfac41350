"""The manifest against a plain tree of Python lists."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from turnwise.llm import merkle


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(doc_id, source, lang, n, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def plain(rows):
    by = {}
    for r in rows:
        own = leaf(*r)
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0], own, leaf(*r[:4], lowered(r[4])) if hit else None))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))
    trees = {s: tree([x[1] for x in by[s]]) for s in order}
    over = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, (doc_id, own, altered) in enumerate(by[s]):
            steps = path(trees[s], i) + path(over, j)
            folded = altered or own
            for before, after in steps:
                folded = h("".join([*before, folded, *after]))
            proof = h("".join("".join(b + a) for b, a in steps))
            out.append((doc_id, own, trees[s][-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(sizes):
    rows, i = [], 0
    for s, n in sizes:
        for _ in range(n):
            rows.append((i * 7919 % 100_003, s, None if i % 11 == 0 else "en", None if i % 13 == 0 else i, None if i % 17 == 0 else f"Text {i} ÄÖ" if i % 3 else f"text {i}"))
            i += 1
    return rows


ODD = [(None, None, None, None, None), (None, "a", "en", 1, "X"), (3, "b", "en", 1, ""), (3, "b", "en", 1, ""), (3, "b", "en", 1, "Y"), (-5, "", "de", 2, "Z" * 50_000)]


@pytest.mark.parametrize(
    "sizes, top",
    [
        ([("a", 1)], 4096),
        ([("a", 16), ("b", 17), (None, 1), ("Ä", 257), ("z", 300), ("", 2)], 4096),
        ([("hot", 9000), ("b", 4096), ("c", 4097), ("d", 3)], 4096),  # several blocks of a source
        ([("hot", 9000), ("b", 5000), ("c", 1)], 3),  # two rounds, paths as rows
        ([(f"s{i}", 1 + i % 3) for i in range(40)], 3),  # sources outnumber what the driver takes
        ([("hot", 4500), *[(f"s{i}", 2) for i in range(20)]], 5),
    ],
)
def test_equals_plain(spark, sizes, top):
    rows = made(sizes) + (ODD if len(sizes) > 3 else [])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("h", "sid", "pos", "part", "name", "run", "i", "b", "altered", "path"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted((tuple(r) for r in merkle.manifest(df, top).collect()), key=str)
    want = plain(rows)
    assert got == want
    assert len({x[3] for x in want}) == 1


def test_tampering_shows(spark):
    rows = [(i, "s", "en", 4, "ABCD" if i % 2 else "abcd") for i in range(200)]
    out = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(200):
        assert out[i] == (zlib.crc32(str(i).encode()) % 5 != 0 or i % 2 == 0)


def test_empty(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
