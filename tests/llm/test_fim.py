"""Fill-in-the-middle against a plain version on strings, and the exact round trip."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from turnwise.llm import fim


def plain(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "ä€😀\nüß\n\n漢字", "x <P> y\nz", "<S>", "<M>\n", "<P", "a\r\nb\x0bc\x00\n", " \u0085\n" * 3]


def rows():
    rng = random.Random(3)
    made = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one\ntwo\n"), (5, "again\nand again"), (5, "again\nand again")]
    for i in range(100, 400):
        made.append((i, "".join(rng.choice("ab \n\nä😀") for _ in range(rng.randrange(60)))))
    made.append((1000, "line of words ä\n" * 60_000))
    made.append((1001, "x" * 700_000))
    return made


def key(r):
    return str(r)


def test_equals_plain_and_round_trip(spark, docs):
    for rate, first in ((100, 50), (40, 0), (0, 50), (100, 100)):
        out = fim.transformed(docs(rows(), extra=True), rate, first)
        out = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
        want = sorted(((i, *plain(i, t, rate, first), t or "") for i, t in rows()), key=key)
        assert sorted((tuple(r) for r in out), key=key) == want
    assert {r.form for r in out} == {"plain", "spm"}


def test_select_finds_every_bit():
    rng = random.Random(1)
    for size in (1, 2, 3, 17, 64, 65, 300):
        for _ in range(20):
            at = sorted(rng.sample(range(size), rng.randint(1, size)))
            bits = sum(1 << i for i in at)
            assert [fim.select(bits, size, k) for k in range(len(at))] == at


def test_empty_table(docs):
    out = fim.transformed(docs([]))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.count() == 0
