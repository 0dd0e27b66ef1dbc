"""The registered queries of this subpackage and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from drayage.llm import (
    chat_format, exact_dedup, html_extract, mixing, ngram_join, packing, periodic_runs, personal_data, quality_rules,
    suffix_dedup, toxicity, warc, whitening)
from drayage.llm.common import WORD, table, text_or_empty, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op2_tag_path_ratios")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op3_warc")
def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, warc.archive_folder(pages))
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ESCAPED = r"regexp_replace(t, '(\\|###|</turn>)', '\\\1', 'g')"
_ESCAPED_ROLE = r"regexp_replace(r, '(\\|###|</turn>|:|\n)', '\\\1', 'g')"


@query("op5_chat_format", rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED}) + length({_ESCAPED_ROLE}) + 14) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""")
def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    turns = chat_format.canonical_turns(rows.withColumn("record", record), "conv_id", "record", "turn")
    return chat_format.read_back(chat_format.formatted_turns(turns)).withColumnRenamed("id", "conv_id")


@query("op8_quality_rules")
def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


@query("op9_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""")
def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


_DRAW = "CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || k), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


@query("op10_mixing", rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
l AS (SELECT sum(source_size) OVER () AS total, sum(w) OVER () AS weights, sum(source_size) OVER o AS full_size, sum(w) OVER o AS full_w
  FROM s WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT max(x) AS level FROM (
  SELECT CAST(total AS DOUBLE) / weights AS x FROM l
  UNION ALL SELECT CAST(total - 3 * full_size AS DOUBLE) / (weights - full_w) FROM l WHERE weights > full_w)),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * level) AS target FROM s, v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
u AS (SELECT doc_id, d.source, size, source_size, target, rate, k, {_DRAW} < rate - floor(rate) AS drawn
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range({mixing.SEEDS}) seeds(k)),
c AS (SELECT source, k, abs(sum(CASE WHEN drawn THEN size ELSE 0 END)
    - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS away FROM u GROUP BY source, k),
b AS (SELECT source, k FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY away, k) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN drawn THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u JOIN b ON u.k = b.k AND u.source IS NOT DISTINCT FROM b.source""")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        F.col("taken").cast("long").alias("taken"))


@query("op4_best_fit_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_suffix_repeats")
def texts_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                        (F.col("n_removed") > 0).alias("has_repeat"))


@query("op7_ngram_join")
def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by a hash of the id, go on with a stretch of
    their own words over and over up to their length."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", F.when(
        h % 10 == 0, F.regexp_extract_all(text_or_empty("text"), F.lit(WORD), F.lit(0))).alias("words"), g.alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn(
        "a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(
        F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    words = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(
        F.col("text")).alias("text"))


@query("op11_periodic_runs")
def words_without_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_personal_data")
def personal_data_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in personal_data.BASE_KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(personal_data.written(base), 256).alias("base_sha256"),
        personal_data.written(F.col("spans")).alias("spans"))


@query("op13_whitening")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
