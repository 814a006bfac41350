"""Queries on texts: normalisation, repetition and quality rules, similarity, numerals (families B, E, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerals
from ..functions import text as T
from ..operators import align
from ..registry import query
from .common import table

_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '[\s\x00\x{00A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _words(spark, d, name="documents", key="doc_id"):
    """Each text with its words as a column of their own: rules that look at single words refer to that column."""
    return table(spark, d, name).select(key, "text", T.words("text").alias("w"))


@query("H1_clean_text", f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def clean_text(spark, d):
    """White space collapsed."""
    return table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@query("H4_words", f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def words(spark, d):
    """H4: words of any script."""
    return _words(spark, d).select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("H2_U2_normalize_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark, d):
    """Normal form without invisible characters."""
    return table(spark, d, "documents").select("doc_id", T.normalize_text("text").alias("normalized"))


@query("H5_word_offsets", r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS g FROM documents),
    p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: length(x))) AS n, unnest(list_transform(g[1:len(w)], lambda x: length(x))) AS gap FROM t)
    SELECT doc_id, word, CAST(sum(n + gap) OVER o - n AS INTEGER) AS start, CAST(sum(n + gap) OVER o AS INTEGER) AS "end" FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)""")
def word_offsets(spark, d):
    """H5: words in their own case with offsets."""
    w = table(spark, d, "documents").select("doc_id", F.inline(T.word_offsets("text")))
    return w


@query("H6_lexical_similarity")
def lexical_similarity(spark, d):
    """H6: word match ratio of neighbours in a conversation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.words("text").alias("w"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next_w"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.lexical_similarity(F.col("w"), F.col("next_w")), 9).alias("similarity"))


@query("H7_roundtrip_similarity")
def roundtrip_similarity(spark, d):
    """H7: similarity of a turn and the next one, by words, recall and characters."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("back"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.roundtrip_similarity(F.col("text"), F.col("back")), 9).alias("similarity"))


@query("H8_H9_edit_rate", r"""
    SELECT c_custkey, levenshtein(c_name, 'Customer#000000042') AS distance, levenshtein(c_name, 'Customer#000000042') / greatest(1, length(c_name)) AS edit_rate FROM customer""")
def edit_rate(spark, d):
    """H8, H9: edit distance and rate."""
    c = table(spark, d, "customer")
    other = F.lit("Customer#000000042")
    return c.select("c_custkey", F.levenshtein("c_name", other).cast("bigint").alias("distance"), T.edit_rate("c_name", other).alias("edit_rate"))


@query("H10_punctuation_signature", "SELECT item_id, regexp_replace(text, '[^.,:?!]', '', 'g') AS signature FROM benchmark")
def punctuation_signature(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.punctuation_signature("text").alias("signature"))


@query("H11_uppercase_count", r"SELECT doc_id, CAST(length(regexp_replace(text, '\P{Lu}', '', 'g')) AS INTEGER) AS n_upper FROM documents")
def uppercase_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.uppercase_count("text").alias("n_upper"))


@query("H16_H19_prefix_and_marks", r"""
    SELECT doc_id, regexp_replace(regexp_replace(translate('en: ' || text, chr(9) || chr(10) || chr(13), '   '), '^\s*en:\s*', ''), '\s+([,.;:!?])', '\1', 'g') AS line FROM documents""")
def prefix_and_marks(spark, d):
    """Control characters, a language prefix, spaces before marks."""
    line = T.strip_prefix(T.one_line(F.concat(F.lit("en: "), "text")), "en")
    return table(spark, d, "documents").select("doc_id", T.tidy_punctuation(line).alias("line"))


@query("H17_sanitized_markup", r"""
    WITH c AS (SELECT page_id, trim(regexp_replace(html, '[\s\x00]+', ' ', 'g')) AS c FROM pages)
    SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(c, '</?\s*[A-Za-z][^>]{0,80}>', ' ', 'g'), '[¶♩♪♫♬]+', ' ', 'g'), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') AS clean FROM c""")
def sanitized(spark, d):
    """Tags and signs taken out of a translation."""
    return table(spark, d, "pages").select("page_id", T.sanitize_translation(F.lit("en-vi"), F.col("html")).alias("clean"))


@query("H62_xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.xml_escape("html").alias("escaped"))


@query("H69_safe_suffix", r"""
    SELECT page_id, CASE WHEN lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) IN ('html', 'wav') THEN '.' || lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) ELSE '.wav' END AS suffix FROM pages""")
def safe_suffix(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_suffix("url", ("html", "wav")).alias("suffix"))


@query("B5_other_scripts", r"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 7 = 0 THEN chr(12354) ELSE '' END, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}\x{0400}-\x{052F}\x{0600}-\x{06FF}]') AS other FROM documents")
def other_scripts(spark, d):
    """Letters of scripts that neither language uses."""
    t = table(spark, d, "documents")
    return t.select("doc_id", T.has_other_script(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "あ").otherwise(""))).alias("other"))


def _repeat_sql(span: int) -> str:
    same = " AND ".join(f"w[i + {k}] = w[i + {k + span}]" for k in range(2 * span))
    return f"(len(w) >= {3 * span} AND len(list_filter(range(1, len(w) - {3 * span} + 2), lambda i: {same})) > 0)"


@query("E6_E7_E8_repetition", f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, {_repeat_sql(1)} AS word_loop, {_repeat_sql(2)} AS bigram_loop, {' OR '.join(map(_repeat_sql, range(3, 9)))} AS block_loop FROM t")
def repetition(spark, d):
    """Words, pairs and blocks of three to eight words that stand three times in a row."""
    w = _words(spark, d)
    block = T.has_repeat(F.col("w"), 3, longest=8)
    return w.select("doc_id", T.has_run(F.col("w")).alias("word_loop"), T.has_repeat(F.col("w"), 2).alias("bigram_loop"), block.alias("block_loop"))


@query("B3_B4_quality_reason", f"""
    WITH t AS (SELECT doc_id, {_CLEAN} AS c, {_WORDS} AS w, greatest(0.45, length(text) * 60 / 1000.0) AS s FROM documents)
    SELECT doc_id, CASE WHEN c = '' THEN 'empty' WHEN length(regexp_replace(c, '\\P{{L}}', '', 'g')) < 2 THEN 'no-lexical-content' WHEN {_repeat_sql(1)} THEN 'consecutive-word-loop'
      WHEN {_repeat_sql(2)} THEN 'repeated-bigram' WHEN {' OR '.join(map(_repeat_sql, range(3, 9)))} THEN 'repeated-trigram'
      WHEN length(c) > greatest(220, floor(s * 55)) THEN 'implausible-length' WHEN len(w) >= 8 AND len(w) / s > 7 THEN 'implausible-word-rate'
      WHEN s >= 8 AND length(c) <= 18 AND len(w) <= 4 THEN 'sparse-long-audio' WHEN s >= 12 AND length(c) <= 26 AND len(w) <= 5 THEN 'sparse-very-long-audio' END AS reason FROM t""")
def quality_reason(spark, d):
    """The first reason to reject a transcript."""
    t = table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("c"), T.words("text").alias("w"), (F.length("text") * 60).alias("ms"))
    return t.select("doc_id", T.quality_reason(F.col("c"), F.col("w"), F.col("ms")).alias("reason"))


@query("B6_D23_D24_translation_quality")
def translation_quality(spark, d):
    """The first reason to reject an answer as a translation of the turn before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.clean_text("text").alias("text"), T.words("text").alias("w"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("out"), F.col("w").alias("out_w"))
    ratio = T.lexical_similarity(F.col("w"), F.col("out_w"))
    return c.join(n, ["conv_id", "turn"]).withColumn("ratio", ratio).select("conv_id", "turn", T.translation_quality_reason(F.col("w"), F.col("out"), F.col("out_w"), F.col("ratio")).alias("reason"))


@query("D24_G2_distinct_and_recall", f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents), r AS (SELECT item_id, {_WORDS} AS b FROM benchmark), t AS (SELECT doc_id, w, b FROM d JOIN r USING (item_id))
    SELECT doc_id, len(list_distinct(w)) / greatest(1, len(w)) AS distinct_ratio, len(list_intersect(list_distinct(b), w)) / greatest(1, len(list_distinct(b))) AS recall FROM t""")
def distinct_and_recall(spark, d):
    """Share of different words, and recall of the words of a reference text, one of them for each document."""
    b = table(spark, d, "benchmark").select("item_id", T.words("text").alias("b"))
    t = _words(spark, d).withColumn("item_id", F.col("doc_id") % b.agg(F.count("*")).scalar()).join(b, "item_id")
    return t.select("doc_id", T.distinct_ratio(F.col("w")).alias("distinct_ratio"), T.word_recall(F.col("b"), F.col("w")).alias("recall"))


@query("D23_trigram_counts", f"""
    WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM t, unnest(range(1, len(w) - 1)) r(i)),
    m AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, coalesce(most, 0) AS most FROM documents LEFT JOIN m USING (doc_id)""")
def trigram_counts(spark, d):
    """How often the most frequent trigram of a text occurs."""
    w = _words(spark, d)
    n = F.greatest(F.size("w") - 2, F.lit(0))
    grams = F.explode_outer(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c")))
    g = w.select("doc_id", grams.alias("g")).groupBy("doc_id", F.concat_ws(" ", "g.a", "g.b", "g.c").alias("g")).agg(F.count("g").alias("n"))
    return g.groupBy("doc_id").agg(F.max("n").alias("most"))


@query("G5_H30_id_anchors", r"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(text, '[^A-Za-z0-9_.-]', '  ', 'g') || ' ', ' ([A-Za-z]{1,12}[0-9]{1,12}) ', 1), lambda x: lower(x)))), ',') AS ids FROM documents""")
def id_anchors(spark, d):
    """Ids that mix letters and digits, sorted, once each."""
    t = F.concat(F.lit(" "), F.regexp_replace("text", "[^A-Za-z0-9_.-]", "  "), F.lit(" "))
    ids = F.transform(F.regexp_extract_all(t, F.lit(" ([A-Za-z]{1,12}[0-9]{1,12}) "), F.lit(1)), F.lower)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(ids)), ",").alias("ids"))


@query("C8_anchor_containment", r"""
    WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS g FROM documents), s AS (SELECT doc_id, g, count(*) AS n FROM a GROUP BY ALL),
    b AS (SELECT doc_id, unnest(regexp_extract_all(substring(text, 1, CAST(length(text) * (doc_id % 5 + 1) // 5 AS BIGINT)), '[0-9]+')) AS g FROM documents), t AS (SELECT doc_id, g, count(*) AS m FROM b GROUP BY ALL)
    SELECT doc_id, bool_and(coalesce(m, 0) >= n) AS contained FROM s LEFT JOIN t USING (doc_id, g) GROUP BY doc_id""")
def anchor_containment(spark, d):
    """Each number of a text must use up one of a shortened copy of it (a fifth to all of the text)."""
    t = table(spark, d, "documents").select("doc_id", "text", F.substring("text", F.lit(1), F.floor(F.length("text") * (F.col("doc_id") % 5 + 1) / 5).cast("int")).alias("other"))
    numbers = lambda c, n: t.select("doc_id", F.explode(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias(n))
    both = numbers("text", "n").join(numbers("other", "m"), ["doc_id", "g"], "left")
    return both.groupBy("doc_id").agg(F.bool_and(F.coalesce("m", F.lit(0)) >= F.col("n")).alias("contained"))


def _in_sql(words) -> str:
    return "(" + ", ".join(f"'{x}'" for x in words) + ")"


@query("H12_H13_H14_language_arbitration", rf"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}]+') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS repeats, len(list_distinct(w)) / greatest(1, len(w)) AS few,
      len(list_filter(w, lambda x: x IN {_in_sql(T.EN_WORDS)})) AS en, len(list_filter(w, lambda x: x IN {_in_sql(T.VI_WORDS)})) AS vi,
      len(list_filter(w, lambda x: regexp_matches(x, '[{T.VI_ONLY}]'))) AS few_marked, len(list_filter(w, lambda x: regexp_matches(x, '[{T.VI_LETTERS}]'))) AS marked FROM t),
    p AS (SELECT *, least(n, 12) * 0.08 - (CASE WHEN n < 2 THEN 0 ELSE repeats * 1.2 END + CASE WHEN n >= 6 AND few < 0.45 THEN (0.45 - few) * 8.0 ELSE 0 END) AS base FROM c),
    s AS (SELECT doc_id, round(CASE WHEN n = 0 THEN -100.0 ELSE base + en * 0.55 - few_marked END::DOUBLE, 6) AS en_score, round(CASE WHEN n = 0 THEN -100.0 ELSE base + vi * 0.55 + marked * 0.35 END::DOUBLE, 6) AS vi_score FROM p)
    SELECT doc_id, en_score, vi_score, CASE WHEN en_score > vi_score THEN 'en' ELSE 'vi' END AS language FROM s""")
def language_arbitration(spark, d):
    """Scores of both languages and the choice."""
    t = table(spark, d, "documents").select("doc_id", T.plain_words("text").alias("w"))
    s = t.select("doc_id", F.round(T.language_score(F.col("w"), "en"), 6).alias("en_score"), F.round(T.language_score(F.col("w"), "vi"), 6).alias("vi_score"))
    return s.withColumn("language", T.arbitrate(F.col("en_score"), F.col("vi_score")))


@query("H20_H26_written_form")
def written_form(spark, d):
    """The value of a turn that is a number in words, and both written forms of each turn (tests hold the rules against phrases)."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", numerals.vi_value("text").alias("value"), numerals.written_form("text").alias("display"), numerals.translation_form("text").alias("translation_input"))


#: Whole numbers of the tables, up to the billions, by the number of an event.
_NUMBERS = "event_id * 7919 * (event_id % 13) * (event_id % 7 + 1) % 1000000000000"


@query("H27_english_numbers", f"""
    SELECT event_id, CAST(0 AS INTEGER) AS run_no, {_NUMBERS} AS value FROM events UNION ALL SELECT event_id, 1, CAST(floor(value) AS BIGINT) FROM events""")
def english_numbers(spark, d):
    """The numbers of events, spelled out in a sentence, found as runs of number words and read again."""
    n, m = F.expr(_NUMBERS), F.floor("value")
    said = F.concat(F.lit("There were "), numerals.en_spelled(n), F.lit(" people, not "), numerals.en_spelled(m), F.lit(", in the tent."))
    runs = table(spark, d, "events").select("event_id", said.alias("text")).select("event_id", F.posexplode(F.regexp_extract_all("text", F.lit(numerals.EN_RUN), F.lit(0))).alias("run_no", "phrase"))
    return runs.select("event_id", "run_no", numerals.en_value("phrase").alias("value"))


@query("H20_H22_H71_numbers_in_words", f"""
    SELECT event_id, CAST({_NUMBERS} AS VARCHAR) AS value, CAST({_NUMBERS} AS VARCHAR) || '.' || CAST(event_id AS VARCHAR) AS decimal_value,
      'tăng ' || CAST(floor(value) AS BIGINT) || '% khu ' || CAST(floor(value) AS BIGINT) || ' có ' || replace(CAST(event_id % 1000 AS VARCHAR), '5', '6') || ' người' AS display FROM events""")
def numbers_in_words(spark, d):
    """The numbers of events in Vietnamese words, read again as whole numbers, decimals, percentages, labelled and counted numbers.

    What is counted has no five: its word is also that for years, which the counting rule takes for what is counted."""
    e = table(spark, d, "events").select("event_id", F.expr(_NUMBERS).alias("n"), F.floor("value").alias("m"))
    digits = F.array_join(F.transform(F.split(F.col("event_id").cast("string"), ""), lambda c: numerals.vi_spelled(c.cast("int"))), " ")
    words = numerals.vi_spelled(F.col("n"))
    said = F.concat_ws(" ", F.lit("tăng"), numerals.vi_spelled(F.col("m")), F.lit("phần trăm khu"), numerals.vi_spelled(F.col("m")), F.lit("có"), numerals.vi_spelled(F.translate((F.col("event_id") % 1000).cast("string"), "5", "6").cast("int")), F.lit("người"))
    decimal = F.concat_ws(" ", words, F.lit(numerals.POINT), digits)
    return e.select("event_id", numerals.vi_value(words).alias("value"), numerals.vi_value(decimal).alias("decimal_value"), numerals.digits_form(said).alias("display"))


@query("B7_H28_H29_lost_anchors")
def lost_anchors(spark, d):
    """What the next turn would have lost as a translation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("out"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", numerals.lost_anchor("text", "out").alias("reason"))


@query("H31_rolling_merge")
def rolling_merge(spark, d):
    """Each turn's windows folded into one text."""
    return align.merged_turns(table(spark, d, "conversations"), ["conv_id"], ["turn"])


@query("H32_H33_H34_translation_chunks")
def translation_chunks(spark, d):
    """Texts cut into chunks of sentences, and that joining them loses nothing."""
    t = table(spark, d, "documents").select("doc_id", "text", align.chunk_column("text").alias("c"))
    return t.select("doc_id", F.size("c").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.size(F.split(x, " ")))).alias("largest"), (F.array_join("c", " ") == T.clean_text("text")).alias("lossless"))


@query("H36_edit_chunks", """
    WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
    SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, CAST(CASE WHEN n <= 48 THEN 1 WHEN n < 84 THEN 2 ELSE (n - 12 + 35) // 36 END AS INTEGER) AS n_chunks FROM t""")
def edit_chunks(spark, d):
    """How many windows of 48 tokens, 12 of them shared, a text has."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    t = table(spark, d, "documents").select("doc_id", n.alias("n_tokens"))
    count = F.when(F.col("n_tokens") <= 48, 1).when(F.col("n_tokens") < 84, 2).otherwise(F.size(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_tokens") - 13), F.lit(36))))
    return t.select("doc_id", "n_tokens", count.alias("n_chunks"))


@query("E15_last_words", r"""SELECT doc_id, CAST(least(24, len(w)) AS INTEGER) AS n, array_to_string(w[-24:], ' ') AS last_words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
def last_words(spark, d):
    """The last 24 words."""
    w = _words(spark, d)
    last = F.slice("w", F.greatest(F.lit(1), F.size("w") - 23), F.lit(24))
    return w.select("doc_id", F.size(last).alias("n"), F.array_join(last, " ").alias("last_words"))


@query("F11_best_block")
def best_block(spark, d):
    """The best alignment block of a turn and the next one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.words("text").alias("w"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next_w"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", align.block_column("w", "next_w").alias("b")).select("conv_id", "turn", "b.size", "b.at")
