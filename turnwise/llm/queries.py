"""The queries of this subpackage, one for each operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collision, covertree, fim, langid, merkle, mixing, pii, quality, secrets, simhash, urls, wrapper
from .common import spread, table


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _counts(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(kind) for kind in kinds]


def op1_collision_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.approximate_neighbours(table(spark, sf_dir, "embeddings"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.exact_top(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encoded(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_secret_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(spread(table(spark, sf_dir, "documents")))
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return found.select(
        "doc_id",
        *_counts("spans", secrets.KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *_counts("base", pii.KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(spread(table(spark, sf_dir, "documents")))


def op11_bitparallel_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(spread(table(spark, sf_dir, "documents")))
    back = F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), back)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spread(table(spark, sf_dir, "documents")))


def op13_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(spread(table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_collision_hashing,
        op2_cover_tree,
        op3_byte_bpe,
        op4_secret_lexer,
        op5_url_templates,
        op6_pii_bootstrap,
        op7_simhash_anchors,
        op8_importance_resampling,
        op9_entropy_balancing,
        op10_zstd_language,
        op11_bitparallel_fim,
        op12_merkle_manifest,
        op13_wrapper_induction,
    )
}

#: The units of op11 are joined to strings here, where the operator cuts bytes.
_FIM_SQL = """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
               sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
    ), h AS (
        SELECT *, len(units) AS n, ('0x' || x[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(units) + 1) AS b,
               ('0x' || x[17:24])::BIGINT % 100 AS h3, ('0x' || x[25:32])::BIGINT % 100 AS h4 FROM d
    ), f AS (
        SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain'
                       WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
               array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
               array_to_string(units[greatest(a, b) + 1:], '') AS s FROM h
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM f
"""


def _merkle_sql(levels: int = 8) -> str:
    """Level by level, for up to 16 ** ``levels`` rows of a source and as many sources."""

    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""rows_ AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS f FROM documents),
    a0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, f) - 1 AS pos, leaf AS h FROM rows_),
    t0 AS (SELECT g, pos, h FROM a0), w0 AS (SELECT doc_id, g, pos, leaf, f, '' AS proof FROM a0)"""]

    def climb(k: int, t: str, w: str) -> str:
        return f"""n{t}{k} AS (SELECT g, count(*) AS n FROM {t}{k} GROUP BY g),
    r{t}{k} AS MATERIALIZED (SELECT g, pos // 16 AS pos, list(h ORDER BY pos) AS run, any_value(n) AS n FROM {t}{k} JOIN n{t}{k} USING (g) GROUP BY g, pos // 16),
    {t}{k + 1} AS MATERIALIZED (SELECT g, pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM r{t}{k}),
    {w}{k + 1} AS MATERIALIZED (SELECT doc_id, w.g, w.pos // 16 AS pos, leaf, CASE WHEN n = 1 THEN f ELSE
        sha256(array_to_string(run[1:w.pos % 16], '') || f || array_to_string(run[w.pos % 16 + 2:], '')) END AS f,
        CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(run[1:w.pos % 16], '') || array_to_string(run[w.pos % 16 + 2:], '') END AS proof COLS
        FROM {w}{k} w JOIN r{t}{k} r ON w.g = r.g AND w.pos // 16 = r.pos)"""

    out += [climb(k, "t", "w").replace("COLS", "") for k in range(levels)]
    out.append(f"s0 AS (SELECT 0 AS g, g AS pos, h FROM t{levels}), v0 AS (SELECT doc_id, 0 AS g, w.g AS pos, leaf, f, proof, t.h AS subroot FROM w{levels} w JOIN t{levels} t ON w.g = t.g)")
    out += [climb(k, "s", "v").replace("COLS", ", subroot") for k in range(levels)]
    return f"""WITH {", ".join(out)}
    SELECT doc_id, leaf, subroot, s.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s.h AS verified FROM v{levels}, s{levels} s"""


ORACLE_SQL: dict[str, str] = {
    "op11_bitparallel_fim": _FIM_SQL,
    "op12_merkle_manifest": _merkle_sql(),
    "op2_cover_tree": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score
            FROM v q JOIN v r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id AND len(q.e) = len(r.e)
        ), t AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM t WHERE place <= 20
    """,
}
