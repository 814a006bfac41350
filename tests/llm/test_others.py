"""Quality classifier, mixing, language identification, pipeline."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnwise.llm import langid, mixing, quality


# --- quality -------------------------------------------------------------------------


def corpus(n=300):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "kalonimutera" for b in ("ta", "no", "ri", "mo")]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80)))
        bad = i % 6 == 0
        rows.append((i, re.sub(" ", "### $$$ ", text) if bad else text))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_keeps_good_and_rejects_bad(spark, docs):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1, rows[1][1]), (None, rows[2][1]), (1003, rows[3][1] * 3000)]
    got = quality.classified(docs(rows + odd, extra=True), spark.createDataFrame(labels + [(2, None, None), (None, 1, 0)], LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 300}
    assert not any(kept[i] for i in range(0, 300, 6))
    assert sum(kept[i] for i in range(300) if i % 6) >= 0.97 * 250
    assert [r.kept for r in got if r.doc_id in (1000, 1001, 1002)] == [False] * 3
    brief = quality.judged(docs(rows + odd, extra=True), spark.createDataFrame(labels + [(2, None, None), (None, 1, 0)], LABELS))
    assert brief.columns == ["doc_id", "log_weight", "sample_key", "kept"]
    assert sorted(map(str, brief.collect())) == sorted(str(r) for r in quality.classified(docs(rows + odd, extra=True), spark.createDataFrame(labels + [(2, None, None), (None, 1, 0)], LABELS)).select(*brief.columns).collect())


def quality_sample(spark, labels):
    """Of labels that share a bucket one is looked at."""
    rows = spark.createDataFrame(labels, LABELS).select("doc_id", "quality", F.xxhash64("doc_id").alias("h"), F.xxhash64(F.xxhash64("doc_id")).alias("g")).collect()
    best = {}
    for r in rows:
        bucket = r.h % quality.LABELLED
        if bucket not in best or (r.g, r.doc_id) < (best[bucket].g, best[bucket].doc_id):
            best[bucket] = r
    return list(best.values())


def test_weights_equal_a_plain_model(spark, docs):
    """Log weights against counts in Python dictionaries, with the same hash of each n-gram."""
    rows, labels = corpus(60)
    ratios, share, _ = quality.fit(docs(rows), spark.createDataFrame(labels, LABELS))
    tool = quality.Hasher()
    import pyarrow as pa

    def grams(text):
        return Counter(int(b) for part, _ in tool.grams(pa.array([text])) for b in part)

    good = {r.doc_id for r in quality_sample(spark, labels) if r.quality == 1}
    raw = sum((grams(t) for _, t in rows), Counter())
    target = sum((grams(t) for i, t in rows if i in good), Counter())
    n = len(ratios)
    from math import log

    plain = [log((target[b] + 1) / (target.total() + n)) - log((raw[b] + 1) / (raw.total() + n)) for b in range(n)]
    for r in docs(rows).select("doc_id", quality.log_weight(ratios, F.col("text")).alias("w")).collect():
        assert r.w == pytest.approx(sum(plain[b] * c for b, c in grams(rows[r.doc_id][1]).items()), abs=1e-2)
    assert share == pytest.approx(len(good) / len(quality_sample(spark, labels)))


def test_grams_dont_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    texts = ["", "a b c", None, "word " * 200, "", "Tail tail ### x", ""]
    count = lambda: Counter((int(r), int(b)) for part, rows in quality.Hasher().grams(pa.array(texts)) for b, r in zip(part, rows))
    whole = count()
    monkeypatch.setattr(quality, "CHUNK", 64)
    assert count() == whole
    assert sum(c for (r, _), c in whole.items() if r == 1) == 5  # three words and two pairs


def test_no_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r.kept for r in quality.classified(docs([(1, "a"), (2, None), (3, "\n\t")]), none).orderBy("doc_id").collect()] == [True, False, False]
    assert [r.kept for r in quality.judged(docs([(1, "a"), (2, "\n\t")]), none).orderBy("doc_id").collect()] == [True, False]
    assert quality.classified(docs([]), none).count() == 0
    assert quality.classified(docs([]), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 50, 199, 200])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([1.5, -3.0, 1e9, rng.random()]) for _ in range(200)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    assert quality.kth_largest(keys, k, bins=8) == sorted(values, reverse=True)[k - 1]


# --- mixing --------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: rest * weight[s] / w for s in free} if free else {}
        over = [s for s in free if now[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | now
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mix(docs, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "b", "é", "Z", None, "z", "tiny"]) if i else "tiny"
        n = rng.choice([0, 1, 3, 30, 30, rng.randint(1, 400)]) if source != "tiny" else 2
        rows.append((i, "w " * n if n else rng.choice([None, "", " \n"]), "en", source))
    rows += [rows[5], (None, "one two", "en", "a")]
    got = mixing.mixed(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    aims = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= max(30, 0.02 * aim)
    again = mixing.mixed(docs(list(reversed(rows)), extra=True).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copied = mixing.copied(docs(rows, extra=True))
    assert copied.columns == docs(rows, extra=True).columns
    assert copied.count() == sum(r.copies for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed, monkeypatch):
    """Places and targets of sources in several ranges, against resharing in Python."""
    rng = random.Random(seed)
    sizes = {f"s{rng.randint(0, 10**6):07d}": int(10 ** rng.uniform(0, 6)) for _ in range(700)} | {None: 40, "é": 7, "zero": 0}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    aims = plain_targets(sizes)
    assert len(got) == len(sizes)
    for r in got:
        assert names[r.place] == r.source and r.target == pytest.approx(aims[r.source], rel=1e-9, abs=1e-9)


def test_copied_keeps_rows_that_differ(docs):
    """Equal id, text and source, but another language: two rows; equal in all: one row that comes more often."""
    rows = [(1, "one two three", "en", "a"), (1, "one two three", "de", "a"), (2, "x y", "en", "a"), (2, "x y", "en", "a"), (3, None, "en", None)]
    clash = docs(rows)
    for name in ("mix_mark", "mix_copy", "copies", "mark", "size", "sid"):
        clash = clash.withColumn(name, F.lit("mine"))
    out = mixing.copied(clash)
    assert out.columns == clash.columns
    assert Counter((r.doc_id, r.lang) for r in out.collect()) == Counter({(1, "en"): 1, (1, "de"): 1, (2, "en"): 2})
    assert mixing.copied(docs([])).count() == 0


def test_mix_of_nothing(docs):
    assert mixing.mixed(docs([])).count() == 0
    assert [r.taken for r in mixing.mixed(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_rates_meet_the_optimum(docs):
    """Rates are exp(lambda size / mean), cut at the limit, and meet the target."""
    rows = [(i, "w " * (1 + i % 17), "en", "abc"[i % 3]) for i in range(300)]
    got = mixing.mixed(docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.size), []).append(r.copies)
    for source in "abc":
        means = {z: sum(c) / len(c) for (s, z), c in by.items() if s == source}
        order = [means[z] for z in sorted(means)]
        assert order == sorted(order) or order == sorted(order, reverse=True) or max(abs(a - b) for a, b in zip(order, order[1:])) < 1


# --- language ------------------------------------------------------------------------


def test_language(docs):
    rng = random.Random(2)
    syllables = {"xx": ["ka", "lo", "mi", "nu"], "yy": ["tre", "que", "ón", "ez"], "zz": ["sch", "ung", "ein", "ß"]}
    rows = []
    for i in range(240):
        lang = ["xx", "yy", "zz"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang, "s"))
    rows += [(500, None, "xx", "s"), (501, "12 !?", "yy", "s"), (502, "", None, "s"), (503, rows[1][1], None, "s"), (None, rows[0][1], "xx", "s"), (0, rows[0][1], "xx", "s")]
    got = langid.languages(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 240:
            assert r.lang_pred == rows[r.doc_id][2]
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[500], by[501], by[502], by[503]) == ("und", "und", "und", "yy")


def test_language_without_training(docs):
    assert [r.lang_pred for r in langid.languages(docs([(1, "abc", None, "s")])).collect()] == ["und"]
    assert langid.languages(docs([])).count() == 0
    one = langid.predicted(docs([(1, "abc")]), {"xx": b"abc abd"}).first()
    assert (one.lang_pred, one.score) == ("xx", 1.0)


def test_language_equals_compression_by_each_dictionary(docs, monkeypatch):
    """More languages than are tried together; very long, empty and repeated texts; ties."""
    import zstandard

    monkeypatch.setattr(langid, "TOGETHER", 3)
    rng = random.Random(4)
    learned = {f"l{i}": " ".join(rng.choice("abcdefghij"[i:] + "klm") * 3 + rng.choice("xyz") for _ in range(300)).encode() for i in range(8)}
    learned["l9"] = learned["l0"]
    rows = [(i, " ".join(rng.choice("abcdefghijklm") * 3 + rng.choice("xyz") for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, rows[0][1] * 4000), (101, None), (102, "5 !"), (0, rows[0][1]), (None, rows[1][1])]
    tools = []
    for lang in sorted(learned):
        content = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools.append((lang, zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))
    expected = {}
    for i, text in rows:
        sizes = sorted((len(tool.compress(langid.plain(text))), lang) for lang, tool in tools) if text and re.search("[a-z]", text) else None
        expected[i] = (sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]) if sizes else ("und", 0.0)
    got = langid.predicted(docs(rows, extra=True), learned).collect()
    assert len(got) == len(rows)
    agree = [r.lang_pred == expected[r.doc_id][0] and r.score == pytest.approx(expected[r.doc_id][1]) for r in got]
    assert all(agree)


def test_every_language_is_learned(docs, monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 4)
    rng = random.Random(9)
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{rng.choice('qwrt')}{chr(97 + i % 26)}" for _ in range(60)), f"x{i % 26}", "s") for i in range(260)]
    got = {r.doc_id: r.lang_pred for r in langid.languages(docs(rows)).collect()}
    assert sum(got[i] == rows[i][2] for i in got) >= 245 and len(set(got.values())) == 26
