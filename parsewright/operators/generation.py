"""From prompts to answers: contexts, pluggable generators, option-by-option questions, and the text of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from parsewright.functions import text as T


class Generator(Protocol):
    """Made once a task on the worker; answers a batch of prompts."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def fill_context(prompt: Column, context: Column) -> Column:
    """The prompt with its excerpt; braces elsewhere stay as they are."""
    return F.replace(prompt, F.lit("{context}"), F.coalesce(context, F.lit("")))


def assemble_context(hits: DataFrame, group: tuple[str, ...], rank: str = "rank", text: str = "text") -> DataFrame:
    """``context`` of each group: its texts in order of rank, a line each. Groups are a query's k hits."""
    return hits.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, text))), lambda x: x[text]), "\n").alias("context"))


def stub_answer(prompt: Column) -> Column:
    """The deterministic offline generator: a letter that depends on the prompt alone."""
    return F.substring(F.translate(F.upper(F.md5(prompt)), "0123456789", "GHIJKLMNOP"), 1, 1)


def generate(df: DataFrame, prompt_col: str, make: Callable[[], Generator], out: str = "raw_output", parallel: int | None = None) -> DataFrame:
    """Answers by a model in Arrow batches. ``parallel`` bounds how many tasks call it at once.

    A task that is run again calls the model again; results are to be written with a key and skipped when
    they are there (``trials.not_done``).
    """
    if parallel:
        df = df.repartition(parallel)
    schema = S.StructType([*df.schema.fields, S.StructField(out, S.StringType())])
    at = df.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or make()
            answers = model(batch.column(at).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def binary_answers(df: DataFrame, keys: tuple[str, ...], prompts_col: str, choices_col: str, context: Column, answer: Callable[[Column], Column] = stub_answer) -> DataFrame:
    """One question per option, matched by position: ``keys`` and ``raw_output``, the keys answered with A in order, or Z."""
    asked = df.select(*keys, F.col(choices_col).alias("_choices"), context.alias("_context"), F.posexplode(prompts_col).alias("_i", "_prompt"))
    yes = T.first_answer(T.without_reasoning(answer(fill_context(F.col("_prompt"), F.col("_context"))))) == "A"
    key = F.get(F.col("_choices"), F.col("_i"))["key"]
    found = asked.select(*keys, F.when(yes, F.struct(F.col("_i"), key.alias("key"))).alias("hit"))
    return found.groupBy(*keys).agg(F.coalesce(F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list("hit")), lambda x: x["key"]), ","), F.lit("")), F.lit("Z")).alias("raw_output"))


def response_text(response: Column) -> Column:
    """Text of a response, be it plain text or JSON of the usual shapes (text, message, content, choices), without
    reasoning marks. Log-probabilities and usage are no text."""
    field = lambda path: F.get_json_object(response, path)
    is_json = T.strip(response).rlike(r"^\{") & F.try_parse_json(response).isNotNull()
    choices = F.array_join(F.filter(F.transform(F.from_json(field("$.choices"), "array<struct<text:string,message:struct<content:string>,content:string>>"), lambda c: F.coalesce(c["text"], c["message"]["content"], c["content"])), lambda x: x.isNotNull()), "\n")
    text = F.coalesce(field("$.text"), field("$.message.content"), field("$.message"), field("$.content"), F.nullif(choices, F.lit("")), F.lit(""))
    return F.coalesce(T.without_reasoning(F.when(is_json, text).otherwise(response)), F.lit(""))


def align_logprobs(tokens: Column, logprobs: Column, cleaned: Column) -> Column:
    """Map of the tokens that the cleaned text still holds, in order, to their log-probability; of repeated tokens the last."""
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<token:string,logprob:double>>)").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        found = F.position(x["token"], cleaned, s["at"])
        hit = (found > 0) & (x["token"] != "")
        return F.struct(F.when(hit, found + F.length(x["token"])).otherwise(s["at"]).alias("at"), F.when(hit, F.concat(s["kept"], F.array(F.struct(x["token"].alias("token"), x["logprob"].alias("logprob"))))).otherwise(s["kept"]).alias("kept"))

    pairs = F.transform(F.arrays_zip(tokens.alias("token"), logprobs.alias("logprob")), lambda x: F.struct(x["token"].alias("token"), x["logprob"].cast("double").alias("logprob")))
    last = F.aggregate(pairs, start, step, lambda s: s["kept"])
    # the last of equal tokens: reverse, keep the first
    back = F.reverse(last)
    names = F.transform(back, lambda x: x["token"])
    return F.map_from_entries(F.filter(back, lambda x, i: F.array_position(names, x["token"]) == i + 1))


def full_inference(docs: DataFrame, questions: DataFrame, prompt: Callable[[DataFrame], Column], doc_filter: Column | None = None, limit: int | None = None) -> DataFrame:
    """Documents times questions with a prompt, ready to be answered. Questions are few and broadcast; those without the
    prompt drop out. ``limit`` takes the first documents by name and is the caller's choice."""
    chosen = docs.where(doc_filter) if doc_filter is not None else docs
    if limit is not None:
        chosen = chosen.orderBy("doc_name").limit(limit)
    pairs = chosen.crossJoin(F.broadcast(questions))
    return pairs.withColumn("prompt", prompt(pairs)).where(F.col("prompt").isNotNull())
