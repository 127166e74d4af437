"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquill.llm import (
    chat_format,
    exact_dedup,
    hard_negatives,
    language_id,
    license_scan,
    line_dedup,
    ngram_model,
    packing,
    periodic_runs,
    quality,
    sentence_pieces,
    simhash,
    toxicity,
)
from mailquill.llm.common import in_fold

TOXIC_FROM = 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = language_id.fit(docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang"))
    predicted = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(docs, model).alias("p"))
    return predicted.select("doc_id", "held_out", "p.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir), wrapped=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = toxicity_model(spark, sf_dir, docs)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled rows of ``docs`` that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~in_fold(F.col("doc_id"), 4, 2))
    known = docs.select(F.col("doc_id").alias("id"), "text")
    return toxicity.fit(known, labels.select(F.col("doc_id").alias("id"), "toxic"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, docs = public_tokenizers.path("piece_bpe_32k.model"), documents(spark, sf_dir)
    digest = sentence_pieces.encode_digest(F.col("text"), model, sentence_pieces.word_table(docs, model))
    return docs.select("doc_id", digest.alias("digest")).select("doc_id", "digest.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_digest(documents(spark, sf_dir), tokenizer)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = documents(spark, sf_dir).select("doc_id", quality.quality(F.col("text")).alias("verdict"))
    return judged.select("doc_id", "verdict.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), largest=True)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = in_fold(F.col("doc_id"), 7, 2)
    model = ngram_model.fit(docs.where(~held_out).select("text"))
    scored = docs.select("doc_id", held_out.alias("held_out"), ngram_model.score_texts(docs, model).alias("s"))
    return scored.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "s.base_score", "s.score", F.pow(F.lit(10.0), -F.col("s.score") / F.col("s.n_tokens")).alias("perplexity"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    vectors = rows.select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        hard_negatives.scaled(F.col("embedding")).alias("vector"),
    )
    return hard_negatives.mine_hard_negatives(vectors, F.col("id") % 50 == 0)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.digest(chat_format.render_turns(turns.unionByName(odd)))


def _with_period(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words from some place on as repetitions of a period drawn from the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), word), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.transform(F.array(words), repeated)[0]  # a one-element array binds an expression to a name
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", _with_period(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("found.runs")

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    listed = F.array_join(F.transform(runs, lambda run: F.concat(line(run), F.lit("\n"))), "")
    found = docs.select("doc_id", periodic_runs.periodic_runs(F.col("text")).alias("found"))
    best = found.select("*", F.reduce(runs, none, better).alias("best"))
    return best.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_periodic_runs": op13_periodic_runs,
}

def _license_sql() -> str:
    values = ", ".join(
        f"({n}, '{label}', {license_scan.template_words(text)!r}, {license_scan.longest_span(((label, text),))})"
        for n, (label, text) in enumerate(license_scan.TEMPLATES)
    )
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in license_scan.PHRASES.items())
    return rf"""
WITH templates(template, label, own, span) AS (VALUES {values}), phrases(phrase, label) AS (VALUES {phrases}),
folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
worded AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM folded),
placed AS (SELECT doc_id, label, unnest(list_filter(range(0, len(words)),
             lambda i: array_to_string(words[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)) AS place
           FROM worded, phrases
           WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
         FROM placed GROUP BY doc_id),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM folded)),
alike AS (SELECT doc_id, label, len(list_intersect(words, own)) / len(own)::DOUBLE AS contained
            FROM lines, templates WHERE len(list_intersect(words, own)) >= ceil(round({license_scan.CONTAINMENT} * len(own), 9))),
windows AS (SELECT doc_id, label, list_max(list_transform(list_filter(range(1, len(words) + 1), lambda i: list_contains(own, words[i])),
                lambda i: len(list_intersect(own, words[i : i + span - 1])))) / len(own)::DOUBLE AS contained, len(own) AS n
            FROM worded, templates WHERE len(list_intersect(words, own)) >= ceil(round({license_scan.CONTAINMENT} * len(own), 9))),
hits AS (SELECT doc_id, max(contained) AS contained, list(DISTINCT label) AS labels
         FROM (SELECT doc_id, label, contained FROM alike
               UNION ALL SELECT doc_id, label, contained FROM windows WHERE contained * n + 0.5 >= ceil(round({license_scan.CONTAINMENT} * n, 9))) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hits.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (doc_id) LEFT JOIN hits USING (doc_id)
"""


LINE_DEDUP_SQL = rf"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, count(*) AS times,
                md5(coalesce('i' || doc_id, 'n') || '/' || md5(coalesce(text, ''))) AS place FROM documents GROUP BY ALL),
split AS (SELECT *, regexp_extract_all(text, '{line_dedup.UNIT}') AS units FROM rows),
keyed AS (SELECT *, list_transform(units, lambda unit: trim(unit, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS keys FROM split),
coded AS (SELECT *, list_transform(keys, lambda key: ('0x' || substr(md5(key), 1, 8))::BIGINT) AS codes FROM keyed),
ended AS (SELECT *, list_filter(range(1, len(keys) + 1), lambda i: i = len(keys)
            OR codes[i] % {line_dedup.MODULUS} * 3 < {line_dedup.MODULUS} * 2) AS ends FROM coded),
numbered AS (SELECT doc_id, place, times, keys, ends, unnest(range(1, len(ends) + 1)) AS no FROM ended),
cut AS (SELECT *, CASE WHEN no = 1 THEN 1 ELSE ends[no - 1] + 1 END AS first, ends[no] AS last FROM numbered),
own AS (SELECT doc_id, place, times, no, first, last, keys[first : last] AS own,
          list_sum(list_transform(keys[first : last], lambda key: length(key) - length(replace(key, ' ', '')) + 1)) AS words FROM cut),
chunks AS (SELECT *, sum(times) OVER (PARTITION BY own) > 1 AS again, coalesce(lag(own) OVER row, []) AS back,
             coalesce(lead(own) OVER row, []) AS ahead
           FROM own WINDOW row AS (PARTITION BY place ORDER BY no)),
stretched AS (SELECT *, no - row_number() OVER (PARTITION BY place ORDER BY no) AS stretch FROM chunks WHERE again),
enough AS (SELECT place, stretch FROM stretched GROUP BY place, stretch
           HAVING sum(words) * {line_dedup.LEAST_PART} >= {line_dedup.LEAST_WORDS}),
wanted AS (SELECT * FROM stretched JOIN enough USING (place, stretch)),
paired AS (SELECT place, no, first, last, back, ahead,
           first_value({{'place': place, 'no': no, 'back': back, 'ahead': ahead}}) OVER (PARTITION BY own ORDER BY doc_id NULLS FIRST, place, no) AS f
         FROM wanted),
extended AS (SELECT place, first, last, list_reverse(back) AS back, list_reverse(f.back) AS f_back, ahead, f.ahead AS f_ahead
             FROM paired WHERE place <> f.place OR no <> f.no),
spans AS (SELECT DISTINCT place,
            first - coalesce(list_min(list_filter(range(1, least(len(back), len(f_back)) + 1), lambda i: back[i] <> f_back[i])) - 1,
                             least(len(back), len(f_back))) AS first,
            last + coalesce(list_min(list_filter(range(1, least(len(ahead), len(f_ahead)) + 1), lambda i: ahead[i] <> f_ahead[i])) - 1,
                            least(len(ahead), len(f_ahead))) AS last
          FROM extended),
opened AS (SELECT *, first > coalesce(max(last) OVER (PARTITION BY place ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS opens FROM spans),
islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY place ORDER BY first, last) AS island FROM opened),
stretches AS (SELECT place, min(first) AS first, max(last) AS last FROM islands GROUP BY place, island),
counted AS (SELECT place, first, last, list_sum(list_transform(keys[first : last], lambda key: length(key) - length(replace(key, ' ', '')) + 1)) AS words
            FROM stretches JOIN keyed USING (place)),
ranges AS (SELECT place, list({{'first': first, 'last': last, 'words': words}} ORDER BY first) AS r FROM counted
           WHERE words >= {line_dedup.LEAST_WORDS} GROUP BY place),
held AS (SELECT doc_id, text, times, units, len(units) AS n, coalesce(r, []) AS r FROM split LEFT JOIN ranges USING (place)),
kept AS (SELECT *, array_to_string(list_transform(range(1, len(r) + 2), lambda i:
           array_to_string(units[CASE WHEN i = 1 THEN 1 ELSE r[i - 1].last + 1 END : CASE WHEN i > len(r) THEN n ELSE r[i].first - 1 END], '')
           || CASE WHEN i <= len(r) AND r[i].first > CASE WHEN i = 1 THEN 1 ELSE r[i - 1].last + 1 END AND r[i].last < n
                     AND contains(units[r[i].last], chr(10)) AND NOT contains(units[r[i].first - 1], chr(10)) THEN chr(10) ELSE '' END), '') AS rest FROM held)
SELECT doc_id, array_to_string(list_transform(r, lambda x: x.first || '-' || x.last), ',') AS removed_units,
       CAST(coalesce(list_sum(list_transform(r, lambda x: x.last - x.first + 1)), 0) AS BIGINT) AS n_removed_units,
       CAST(coalesce(list_sum(list_transform(r, lambda x: x.words)), 0) AS BIGINT) AS n_removed_words,
       sha256(CASE WHEN len(r) = 0 THEN text ELSE rest END) AS text_sha256
FROM kept, range(times)
"""

QUALITY_SQL = r"""
WITH worded AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS start FROM worded),
windows AS (SELECT doc_id, start, array_to_string(words[start : start + 7], ' ') AS own FROM starts),
again AS (SELECT doc_id, start FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, own) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
            FROM (SELECT doc_id, unnest(range(start, start + 8)) AS place FROM again) GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM split),
counted AS (
  SELECT doc_id, line, own, len(own) AS n, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
         length(line) - length(replace(line, '|', '')) AS bars,
         length(line) - length(regexp_replace(line, '[#*$%&]', '', 'g')) AS marks,
         (length(line) - length(replace(line, '!!', ''))) // 2 AS shouts,
         len(list_filter(range(2, len(own) + 1), lambda i: own[i] = own[i - 1])) AS repeats
  FROM lines WHERE len(own) > 0),
failed AS (
  SELECT doc_id, line, n,
         bars >= 0.12::DOUBLE * n OR marks >= 0.3::DOUBLE * n OR shouts >= 0.3::DOUBLE * n OR repeats >= 0.3::DOUBLE * n
         OR n <= 20 AND regexp_matches(folded, 'BOILERPLATE')
         OR n <= 3 AND NOT regexp_matches(own[-1], '[.!?:;,"'')…”»]$') AS fails
  FROM counted),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost
            FROM failed GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN by_line USING (doc_id)),
verdict AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_lost_words <= 0.5 * n_words AS kept, n_lost_words
FROM verdict
""".replace("BOILERPLATE", "|".join(quality.BOILERPLATE).replace("'", "''"))

HARD_NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.alike AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 3
"""

ORACLES: dict[str, str] = {
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op2_license_scan": _license_sql(),
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op7_quality_rules": QUALITY_SQL,
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
