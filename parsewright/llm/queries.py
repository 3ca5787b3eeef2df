"""The queries of the training-data problems, each over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.llm import packing, pairs, quality, scans, split, tokenizers, truncation, webspam
from parsewright.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(read_table(spark, d, "chunks"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(read_table(spark, d, "chunks"))


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each oversized text put together again without what they share: ``chunk_id``, units, and the text's MD5."""
    chunks = read_table(spark, d, "chunks")
    limits = chunks.select("chunk_id", "unit", F.least(F.greatest(F.coalesce("chunk_overlap", F.lit(0)), F.lit(0)), F.col("chunk_size") - 1).alias("overlap"))
    pieces = split.split_oversized(chunks).join(limits, "chunk_id")
    shared = F.concat(F.lit(r"^(?:[^ \t\r\n]+[ \t\r\n]+){"), F.col("overlap"), F.lit("}"))
    own = F.when(F.col("piece") == 0, F.col("text")).when(F.col("unit") == "token", F.regexp_replace("text", shared, F.lit(""))).otherwise(F.substring("text", F.col("overlap") + 1, F.length("text")))
    texts = pieces.withColumn("own", own).groupBy("chunk_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "").alias("text"))
    return texts.select("chunk_id", split.units_of(F.col("text"), F.col("unit")).cast("bigint").alias("n_units"), F.md5("text").alias("text_md5"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(read_table(spark, d, "parsed_docs")).select("parse_id")


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.length_limits(read_table(spark, d, "parsed_docs"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(read_table(spark, d, "parsed_docs")).withColumnRenamed("source", "parser")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.find_not_prose(read_table(spark, d, "parsed_docs"), read_table(spark, d, "common_words"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(read_table(spark, d, "parsed_docs"), read_table(spark, d, "common_words"))


def p3_calibration(spark: SparkSession, d: str) -> DataFrame:
    return quality.calibration(quality.text_statistics(read_table(spark, d, "parsed_docs"), read_table(spark, d, "common_words")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(read_table(spark, d, "results"), read_table(spark, d, "queries"), read_table(spark, d, "common_words"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(read_table(spark, d, "parsed_docs"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_texts(read_table(spark, d, "parsed_docs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizers.encode_texts(read_table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, d, "documents"), read_table(spark, d, "context_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of the containers' space that is used, for each budget."""
    placed = p7_containers(spark, d)
    used = placed.groupBy("budget_id", "container").agg(F.sum("size").alias("used"))  # containers are many and small
    total = used.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(read_table(spark, d, "context_budgets"), "budget_id").select("budget_id", "tokenizer", "capacity", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return webspam.find_spam(read_table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    return webspam.score_all(documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p2_found, p2_limits, p2_rates, p3_found, p3_statistics, p3_calibration, p4_found, p5_found, p5_repaired, p6_ids, p7_containers, p7_fill, p8_found, p8_scores)}

#: The others can't be said in SQL; tests/llm checks them by round trips, brute force and labelled cases.
ORACLE_SQL = {
    "p1_found": r"""
        SELECT chunk_id FROM chunks
        WHERE text IS NOT NULL AND chunk_size > 0
          AND CASE WHEN unit = 'token' THEN len(regexp_extract_all(text, '[^ \t\r\n]+')) ELSE length(text) END
              > chunk_size + greatest(coalesce(chunk_overlap, 0), 0)
    """,
    "p1_rejoined": r"""
        WITH sized AS (
            SELECT *, CASE WHEN unit = 'token' THEN len(regexp_extract_all(text, '[^ \t\r\n]+')) ELSE length(text) END AS n_units
            FROM chunks WHERE text IS NOT NULL AND chunk_size > 0)
        SELECT chunk_id, CAST(n_units AS BIGINT) AS n_units, md5(text) AS text_md5 FROM sized
        WHERE n_units > chunk_size + greatest(coalesce(chunk_overlap, 0), 0)
    """,
}
