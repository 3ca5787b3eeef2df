"""Documents in and out: raw files, parsed texts, chunk files, catalogues, and what their markup holds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.functions import text as T
from parsewright.operators.chunking import pretty_json

CHUNK_SCHEMA = "array<struct<text:string,metadata:map<string,string>>>"
QUERY_SCHEMA = "struct<label:string,description:string,description_detailed:string,instructions:string,type:string,choices:array<struct<key:string,value:string,description:string>>,prefilled:array<string>,examples:array<struct<context:string,answer:string>>,prompts:map<string,string>>"
SUMMARY_SCHEMA = "trial_number int, overall_average_accuracy double, parameters map<string,string>, document_aggregates map<string,double>, query_aggregates map<string,double>, timestamp string"

#: A parser: bytes of a document to its text, format and metadata. Made once a task, on the worker.
Parser = Callable[[bytes], tuple[str, str, dict[str, str]]]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def raw_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """``doc_name``, ``path``, ``length``, ``content`` of the files in a folder, sorted names left to the caller."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select(stem(F.col("path")).alias("doc_name"), "path", "length", "content")


def parse(files: DataFrame, parser_name: str, make: Callable[[], Parser], parallel: int | None = None) -> DataFrame:
    """``doc_name``, ``parser``, ``format``, ``content``, ``metadata``, ``error``: a parser over raw files in Arrow batches.
    A document that its parser fails on comes out with the error's first 300 characters and no content."""
    if parallel:
        files = files.repartition(parallel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in batches:
            parser = parser or make()
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    text, kind, meta = parser(data)
                    out.append((kind, text, list(meta.items()), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, None, [], str(e)[:300]))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parser_name] * batch.num_rows, pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.map_(pa.string(), pa.string())), pa.array(cols[3], pa.string())], names=["doc_name", "parser", "format", "content", "metadata", "error"])

    return files.select("doc_name", "content").mapInArrow(run, "doc_name string, parser string, format string, content string, metadata map<string,string>, error string")


def sniff_format(content: Column) -> Column:
    """``tei_xml`` for what begins like markup, else ``markdown``."""
    return F.when(T.strip(content).startswith("<"), "tei_xml").otherwise("markdown")


def parsed_text(value: Column) -> Column:
    """Text of a parsed document: a JSON string as it is, a JSON list joined by blank lines, other JSON pretty, anything else raw."""
    as_list = F.from_json(value, "array<string>")
    kind = F.schema_of_variant(F.try_parse_json(value))
    return F.when(kind == "STRING", F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(as_list, "\n\n")).when(kind.isNotNull(), pretty_json(F.when(F.startswith(kind, F.lit("OBJECT")), value))).otherwise(value)


def parsed_files(spark: SparkSession, folder: str, parser: str) -> DataFrame:
    """Parsed documents of a folder, one file each; sidecars with metadata and hidden files are no documents."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("path"))
    kept = files.where(~F.col("path").endswith(".meta.json") & ~F.element_at(F.split("path", "/"), -1).startswith("."))
    text = F.when(F.col("path").endswith(".json"), parsed_text(F.col("value"))).otherwise(F.col("value"))
    return kept.select(stem(F.col("path")).alias("doc_name"), F.lit(parser).alias("parser"), sniff_format(text).alias("format"), text.alias("content"))


def write_parsed(df: DataFrame, folder: str) -> None:
    df.write.mode("append").partitionBy("parser").parquet(folder)


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of JSON files: lists of text and metadata, or of texts; what is no JSON is parted at blank lines."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("path"))
    objects = F.from_json("value", CHUNK_SCHEMA)
    texts = F.transform(F.from_json("value", "array<string>"), lambda t: F.struct(t.alias("text"), F.expr("cast(map() as map<string,string>)").alias("metadata")))
    blocks = F.transform(F.filter(F.split("value", r"\n\s*\n"), lambda x: T.strip(x) != ""), lambda t: F.struct(t.alias("text"), F.expr("cast(map() as map<string,string>)").alias("metadata")))
    is_objects = F.col("value").rlike(r"^\s*\[\s*\{")
    is_json = F.try_parse_json("value").isNotNull()
    chosen = F.when(is_objects & is_json, objects).when(is_json & F.col("value").rlike(r"^\s*\["), texts).otherwise(blocks)
    return files.select(stem(F.col("path")).alias("doc_name"), F.posexplode(chosen).alias("chunk_index", "c")).select("doc_name", "chunk_index", "c.text", "c.metadata")


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """A question catalogue, a JSON object keyed by question id, as one row a question."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{QUERY_SCHEMA}>").alias("m"))
    return whole.select(F.explode("m").alias("query_id", "q")).select("query_id", "q.*")


def rules_file(spark: SparkSession, path: str) -> DataFrame:
    """Applicability rules, a JSON object keyed by question id, as one row a condition."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<depends_on:array<string>,not_applicable_if:array<map<string,string>>>>").alias("m"))
    rules = whole.select(F.explode("m").alias("query_id", "r")).select("query_id", F.explode("r.not_applicable_if").alias("c"))
    return rules.select("query_id", F.explode("c").alias("depends_on", "blocked"))


def templates(spark: SparkSession, folder: str, category: str) -> DataFrame:
    """Templates of a folder, ``<type>.txt`` each."""
    files = spark.read.text(folder, wholetext=True).select("value", F.input_file_name().alias("path"))
    return files.select(stem(F.col("path")).alias("type"), F.lit(category).alias("category"), F.col("value").alias("template"))


def models_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def summary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Trial summaries of the folders below; a file that is broken gives no row."""
    found = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*/trial_summary.json")
    return found.where("trial_number is not null")


def append_vectors(df: DataFrame, folder: str) -> None:
    """The vector store: Parquet that is appended to."""
    df.write.mode("append").parquet(folder)


def markdown_counts(df: DataFrame) -> DataFrame:
    """Table lines, displayed equations and the title of markdown contents."""
    content = F.col("content")
    count = lambda pattern: F.size(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))
    return df.where(content.isNotNull()).select("parse_id", count(r"(?md)^\|[^\n]*\|[ \t\r]*$").alias("table_lines"), count(r"(?s)\$\$.+?\$\$").alias("equations"), F.nullif(F.regexp_extract(content, r"^# ([^\n\r]+)", 1), F.lit("")).alias("title"))


def tei_parts(df: DataFrame, id_col: str = "parse_id") -> DataFrame:
    """Title, authors, section heads, and numbers of paragraphs, tables and formulas of TEI contents, whatever their
    namespace; contents that are no well-formed XML have no row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, content in enumerate(batch.column(1).to_pylist()):
                try:
                    root = ET.fromstring(content)
                except (ET.ParseError, ValueError):
                    continue
                every: dict[str, list[ET.Element]] = {}
                for e in root.iter():
                    every.setdefault(str(e.tag).rpartition("}")[2], []).append(e)
                text = lambda e: " ".join("".join(e.itertext()).split())
                authors = [" ".join(t for t in (p.strip() for p in a.itertext()) if t) for a in every.get("author", [])]
                rows.append((i, text(every["title"][0]) if "title" in every else None, authors, [text(h) for h in every.get("head", [])], len(every.get("p", [])), len(every.get("table", [])), len(every.get("formula", []))))
            cols = list(zip(*rows)) if rows else [()] * 7
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], strings), pa.array(cols[3], strings), *(pa.array(c, pa.int32()) for c in cols[4:])], names=[id_col, "title", "authors", "heads", "paragraphs", "tables", "formulas"])

    known = df.where(F.ltrim(F.col("content")).startswith("<")).select(id_col, "content")
    return known.mapInArrow(run, f"`{id_col}` {kind}, title string, authors array<string>, heads array<string>, paragraphs int, tables int, formulas int")
