"""Incremental mode: newly arrived documents are chunked and embedded, those already done are left alone."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.operators.chunking import length_chunks
from parsewright.operators.retrieval import embed_checksum
from parsewright.session import ensure_checkpoint_dir


def chunk_stream(spark: SparkSession, source: str, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """A streaming DataFrame of embedded chunks of the documents that arrive in a folder of Parquet files."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source if os.path.isdir(source) or "://" in source else f"{os.path.dirname(source)}/{os.path.basename(source)}*")
    docs = stream.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    return embed_checksum(length_chunks(docs, text_col, size, overlap, keep=(id_col,)), "text")


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Take in what has arrived, once, and stop. Files that the checkpoint knows are not read again."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def chunk_available(spark: SparkSession, source: str, id_col: str, text_col: str) -> DataFrame:
    """Chunks of all documents by the incremental path, kept in the shared checkpoint folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    run_available(chunk_stream(spark, source, id_col, text_col), f"{root}/chunks", f"{root}/state")
    return spark.read.parquet(f"{root}/chunks")
