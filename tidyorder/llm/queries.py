"""One registered query per operator, over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyorder.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_exact_dedup", """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_kd_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.sharding import assign_shards

    shards = assign_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.simhash import simhash_groups

    rows = simhash_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4, seed=42)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
flagged AS (SELECT keyed.*, coalesce(first <> doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.line_dedup import apply_bitmaps, line_bitmaps

    docs = table(spark, sf_dir, "documents")
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_decontamination", r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS k
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT doc_id, i, size, item_id FROM spots JOIN windows USING (size, k)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits),
by_doc AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
by_item AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN by_doc USING (doc_id) LEFT JOIN by_item USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.decontaminate import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tk")


#: Shares of tokens that the mixture asks of the domains of `labels`.
MIXTURE = {"high": 0.95, "low": 0.05, "toxic": 0.0}


@query("op3_soft_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.mixing import label_domains, mix

    rows = mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIXTURE)
    return rows.drop("tk")


@query("op8_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.surrogates import replace_private

    return replace_private(table(spark, sf_dir, "documents")).drop("tk")


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op1_context_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.context_mixing import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.periodic_runs import plant_periods, word_runs

    found = word_runs(plant_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.conversations import damage, repair_conversations

    return repair_conversations(damage(table(spark, sf_dir, "conversations")), present_col="present")


@query("op13_html_extraction")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyorder.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
