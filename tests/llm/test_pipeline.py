"""The pipeline: each stage on odd rows, and the whole of it against a plain version on small tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import mixing, quality, simhash

from test_others import LABELS, corpus
from test_pii import plain as plain_pii
from test_simhash import classes, fingerprint

CLASH = ("kept", "log_weight", "sample_key", "simhash_mark", "fp", "pii_key", "pii_spans", "mix_mark", "mix_copy", "copies", "mark", "size", "d", "k")


def tables(spark, docs, tmp_path, rows, labels):
    built = docs(rows)
    for name in CLASH:
        built = built.withColumn(name, F.lit(f"own {name}"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    built.write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def odd_rows():
    rows, labels = corpus(120)
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in rows]
    long = " ".join(t for i, t, _, _ in rows if i % 6) * 12
    rows += [(900, rows[1][1], "en", "a"), (901, rows[1][1], "de", None), (902, long, "en", "a"), (903, None, "en", "a"), (904, "", None, None), (905, " \n", "en", "b"), (None, rows[2][1] + " and more", "en", None), (7, rows[7][1], "en", "b"), (7, rows[7][1], "en", "b")]
    return rows, labels


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, tmp_path, name):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns."""
    rows, labels = odd_rows()
    now = tables(spark, docs, tmp_path, rows, labels)
    out = dict(corpus_pipeline.STAGES)[name](spark, now, str(tmp_path))
    got = out.collect()
    if name != "byte_bpe":
        assert out.columns == now.columns
        assert all(r[c] == f"own {c}" for r in got for c in CLASH)
    texts = Counter((r.doc_id, r.text) for r in got) if name != "byte_bpe" else None
    if name == "quality_classifier":
        judged = quality.judged(now, spark.createDataFrame(labels, LABELS)).where("kept").collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in judged) and len(got) > 40
        assert {903, 904, 905}.isdisjoint(r.doc_id for r in got) and texts[7, rows[7][1]] in (0, 3)
    elif name == "near_dedup":
        assert texts[7, rows[7][1]] == 1 and not any(r.doc_id in (900, 901, 904, 905) for r in got) and any(r.doc_id == 903 for r in got)
    elif name == "personal_data":
        assert texts == Counter((r[0], r[1]) for r in rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    elif name == "source_mix":
        assert not {903, 904, 905}.intersection(r.doc_id for r in got) and len(got) > 0
    else:
        assert len(got) == len(rows) and all(r.n_tokens == 0 for r in got if r.doc_id in (903, 904))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, docs, tmp_path, name):
    now = tables(spark, docs, tmp_path, [], [])
    assert dict(corpus_pipeline.STAGES)[name](spark, now, str(tmp_path)).count() == 0


def test_pipeline_of_nothing(spark, docs, tmp_path):
    tables(spark, docs, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_a_plain_version(spark, docs, tmp_path):
    """Rejected, merged and masked in plain Python; as often as the mix of what is left takes it; encoded as the library does."""
    from test_bpe import tiktoken_encoding

    rows, labels = corpus(240)
    rows = [(i, t + (f" write to user{i}@mail.example.com" if i % 9 == 1 else ""), "en", "ab"[i % 2]) for i, t in rows]
    rows += [(900 + i, rows[2][1], "en", "a") for i in range(5)] + [(950, None, "en", "a")]
    tables(spark, docs, tmp_path, rows, labels)
    judged = quality.judged(docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert kept.isdisjoint([*range(0, 240, 6), 950]) and len(kept) > 180
    left = [r for r in rows if r[0] in kept]
    root = classes([fingerprint(r[1]) for r in left])
    first = {}
    for r, c in zip(left, root, strict=True):
        first[c] = min(first.get(c, r), r)
    clean = []
    for i, text, lang, source in first.values():
        for kind, start, end in sorted(plain_pii(text), key=lambda s: -s[1]):
            text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
        clean.append((i, text, lang, source))
    copies = kept.intersection([2, *range(900, 905)])
    assert len(copies) > 1 and len(clean) == len(left) - len(copies) + 1 and not any("@" in r[1] for r in clean)
    # Which documents the mix takes is drawn by hashes of whole rows, so that step is its operator's.
    columns = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
    again = docs(clean)
    for name in CLASH:
        again = again.withColumn(name, F.lit(f"own {name}"))
    taken = Counter(r.doc_id for r in mixing.copied(again.select(*columns)).collect())
    encode = tiktoken_encoding()
    texts = {r[0]: r[1] for r in clean}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == taken
    for r in out:
        ids = [int.from_bytes(r.ids[4 * i : 4 * i + 4], "little") for i in range(r.n_tokens)]
        assert ids == encode.encode_ordinary(texts[r.doc_id])


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "personal_data", "source_mix", "byte_bpe"]
    assert simhash.THRESHOLD == 4 and re.search("four bits", corpus_pipeline.near_dedup.__doc__)
