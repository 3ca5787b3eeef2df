"""Commands: ``python -m parsewright.cli parse-docs | chunking | embed | full-infer``."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.operators import chunking, generation, retrieval, trials
from parsewright.registry import CHUNKERS, PARSERS
from parsewright.session import cut_lineage, local_session
from parsewright.sources import documents


def _there(spark: SparkSession, folder: str) -> DataFrame | None:
    """What a folder of Parquet files holds; None if there is nothing yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _left(df: DataFrame, done: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    return df if done is None else trials.not_done(df, done, keys)


def parse_docs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parses the files that the folder of parsed documents doesn't hold for the parser; those it fails on go to ``<out>.errors``."""
    files = documents.raw_files(spark, a.folder, a.glob).withColumn("parser", F.lit(a.parser))
    parsed = cut_lineage(documents.parse(_left(files, _there(spark, a.out), ("doc_name", "parser")), a.parser, PARSERS[a.parser]))
    documents.write_parsed(parsed.where("error is null").drop("error"), a.out)
    parsed.where("error is not null").select("doc_name", "parser", "error", F.current_timestamp().alias("failed_at")).write.mode("append").parquet(f"{a.out.rstrip('/')}.errors")


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks each document by each setting that it isn't chunked by yet."""
    docs = spark.read.parquet(a.parsed).select("doc_name", "parser", "content").where("content is not null")
    for size in a.size:
        for overlap in (o for o in a.overlap if o < size):
            setting = {"chunker": F.lit(a.chunker), "chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap)}
            left = _left(docs.withColumns(setting), _there(spark, a.out), ("doc_name", "parser", *setting)).select(*docs.columns)
            if a.chunker == "LengthChunker":
                chunks = chunking.length_chunks(left, "content", size, overlap, keep=("doc_name", "parser"))
            else:
                chunks = CHUNKERS[a.chunker](left.withColumn("id", F.struct("doc_name", "parser")), "content", size, overlap, "id").select("id.*", "chunk_index", "text", "metadata")
            chunks.withColumns(setting).write.mode("append").partitionBy("parser", "chunker", "chunk_size", "chunk_overlap").parquet(a.out)


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Embeds the chunks that the vector store doesn't hold; with ``--force`` all, in place of the vectors that it holds of them."""
    keys = ("doc_name", "parser", "chunker", "chunk_size", "chunk_overlap", "chunk_index")
    chunks, store = spark.read.parquet(a.chunks), _there(spark, a.out)
    if a.force and store is not None:
        kept = cut_lineage(trials.not_done(store, chunks, keys))  # written elsewhere before the store is
        kept.unionByName(retrieval.embed_checksum(chunks, "text")).write.mode("overwrite").parquet(a.out)
    else:
        documents.append_vectors(retrieval.embed_checksum(_left(chunks, store, keys), "text"), a.out)


def full_infer(spark: SparkSession, a: argparse.Namespace) -> None:
    questions = documents.query_file(spark, a.queries).select("query_id", F.col("prompts")[a.prompt].alias("base"))
    docs = spark.read.parquet(a.parsed).select("doc_name", "content")
    pairs = generation.full_inference(docs, questions, lambda df: generation.fill_context(F.col("base"), F.col("content")), F.col("doc_name") == a.doc if a.doc else None, a.limit)
    pairs.select("doc_name", "query_id", generation.stub_answer(F.col("prompt")).alias("raw_output")).write.mode("overwrite").parquet(a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="parsewright")
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("parse-docs")
    s.set_defaults(run=parse_docs)
    s.add_argument("folder"), s.add_argument("out"), s.add_argument("-p", "--parser", default="TextParser"), s.add_argument("--glob", default="*.pdf")
    s = sub.add_parser("chunking")
    s.set_defaults(run=chunk)
    s.add_argument("parsed"), s.add_argument("out"), s.add_argument("-c", "--chunker", default="LengthChunker")
    s.add_argument("--size", type=int, nargs="+", default=list(chunking.GRID_SIZES)), s.add_argument("--overlap", type=int, nargs="+", default=list(chunking.GRID_OVERLAPS))
    s = sub.add_parser("embed")
    s.set_defaults(run=embed)
    s.add_argument("chunks"), s.add_argument("out"), s.add_argument("--force", action="store_true")
    s = sub.add_parser("full-infer")
    s.set_defaults(run=full_infer)
    s.add_argument("parsed"), s.add_argument("queries"), s.add_argument("out"), s.add_argument("--prompt", default="base_prompt"), s.add_argument("--doc"), s.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    a.run(spark or local_session(), a)


if __name__ == "__main__":
    main()
