"""Questions, prompts, ground truth and outcomes as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsewright.functions import text as T

# Sentinels in answers.
NOT_APPLICABLE, NOT_REPORTED, OTHER = "-99", "Z", "Y"
QUERY_TYPES = ("open_ended", "multiple_choice", "numeric", "single_choice", "list")


def item_codes(sheet: DataFrame, item_col: str, row_col: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``item`` and ``place`` of each dotted item code, in the order of its first row."""
    item = T.strip(F.col(item_col))
    first = sheet.select(item.alias("item"), F.col(row_col).alias("row")).where(F.col("item").rlike(r"^\d+(\.\d+)*$") & ~F.col("item").isin(*excluded, "")).groupBy("item").agg(F.min("row").alias("first_row"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first_row", "item")))


def fill_down(df: DataFrame, value_col: str, order_col: str, partition: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """Empty values take the last one before them within the partition; each partition must be bounded (a sheet, a document)."""
    upto = Window.partitionBy(*partition).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or value_col, F.last(F.nullif(F.col(value_col), F.lit("")), ignorenulls=True).over(upto))


def normalise_choices(lines: Column) -> Column:
    """Checkbox lines to choices: numbered headings and not-applicable lines drop out, marks are taken off, letters are
    given in order; Other gets Y and Not reported gets Z."""
    clean = F.transform(lines, lambda x: T.strip(F.regexp_replace(F.regexp_replace(x, r"\[\s*\]", ""), r"[:_]+\s*$", "")))
    kept = F.filter(clean, lambda x: (x != "") & ~x.rlike(r"^\d+\.\s*") & ~x.rlike(r"(?i)^-99|not applicable"))
    special = lambda x: x.rlike(r"(?i)^(other|not reported)")
    plain = F.filter(kept, lambda x: ~special(x))
    lettered = F.transform(plain, lambda x, i: F.struct(F.char(F.lit(65) + i).alias("key"), x.alias("value")))
    tail = F.transform(F.filter(kept, special), lambda x: F.struct(F.when(x.rlike("(?i)^other"), OTHER).otherwise(NOT_REPORTED).alias("key"), x.alias("value")))
    return F.concat(lettered, tail)


def key_value_choices(lines: Column) -> Column:
    """Lines ``key = value``, parted at the first sign, in order."""
    return F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(T.strip(F.split(x, "=", 2)[0]).alias("key"), T.strip(F.split(x, "=", 2)[1]).alias("value")))


def infer_type(values: Column) -> Column:
    """Type of a question by its value lines: none or one is open, checkboxes allow several, ``1=`` one, ``Numeric`` a number."""
    return (
        F.when(F.exists(values, lambda x: F.contains(x, F.lit("["))), "multiple_choice")
        .when(F.exists(values, lambda x: x.rlike(r"(?i)^\s*numeric")), "numeric")
        .when(F.exists(values, lambda x: x.rlike(r"^\s*1\s*=")), "single_choice")
        .otherwise("open_ended")
    )


def expand_metrics(df: DataFrame, id_col: str, prefilled_col: str) -> DataFrame:
    """One row per prefilled value, with an id of its own and a type: free text where it asks to specify, else numeric."""
    return df.select("*", F.posexplode(prefilled_col).alias("_i", "metric")).withColumn("metric_id", F.concat_ws(".", F.col(id_col), F.col("_i") + 1)).withColumn("metric_type", F.when(F.col("metric").rlike("(?i)specify"), "open_ended").otherwise("numeric")).drop("_i")


def unpivot_examples(df: DataFrame, id_col: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Column pairs ``paragraph_<s>`` and ``correct_answer_<s>`` as ``examples``, those without a paragraph dropped."""
    pairs = F.array(*(F.struct(F.col(f"paragraph_{s}").alias("context"), F.col(f"correct_answer_{s}").alias("answer")) for s in suffixes))
    return df.select(id_col, F.filter(pairs, lambda x: x["context"].isNotNull() & (T.strip(x["context"]) != "")).alias("examples"))


def unpivot_truth(wide: DataFrame, item_col: str, row_col: str | None = None) -> DataFrame:
    """Columns named by digits are documents: ``doc_name``, ``query_id``, ``answers`` in row order, blanks and ``nan`` dropped."""
    docs = [c for c in wide.columns if c.isdigit()]
    long = wide.select(F.col(item_col).alias("query_id"), *([F.col(row_col).alias("row")] if row_col else [F.lit(0).alias("row")]), F.explode(F.array(*(F.struct(F.lit(c).alias("doc_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in docs))).alias("v"))
    value = T.strip(F.col("v.value"))
    given = F.when(value.isNotNull() & (value != "") & (F.lower(value) != "nan"), F.struct("row", value.alias("value")))
    return long.groupBy("v.doc_name", "query_id").agg(F.transform(F.sort_array(F.collect_list(given)), lambda x: x["value"]).alias("answers"))


def without_prefilled(answers: Column, prefilled: Column) -> Column:
    """Answers that neither are nor begin with a prefilled text, whatever the case; none left gives not applicable."""
    kept = F.filter(answers, lambda a: a.isNotNull() & (T.strip(a) != "") & ~F.exists(F.coalesce(prefilled, F.expr("cast(array() as array<string>)")), lambda p: (p != "") & F.lower(T.strip(a)).startswith(F.lower(T.strip(p)))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(NOT_APPLICABLE)))


def cleaned_truth(answers: Column, prefilled: Column, split_commas: bool = True) -> Column:
    """True answers for scoring: after ``Other:`` the rest is kept, any other prefilled beginning discards the answer;
    then answers are parted at commas, blanks dropped."""
    blank = F.expr("cast(array() as array<string>)")

    def rest(v: Column) -> Column:
        return F.aggregate(
            F.coalesce(prefilled, blank),
            F.struct(T.strip(v).alias("v"), F.lit(False).alias("done")),
            lambda s, p: F.when(s["done"] | ~s["v"].startswith(p) | (p == ""), s)
            .when(F.lower(p) == "other:", F.struct(T.strip(F.substr(s["v"], F.length(p) + 1)).alias("v"), F.lit(False).alias("done")))
            .otherwise(F.struct(F.lit("").alias("v"), F.lit(True).alias("done"))),
            lambda s: s["v"],
        )

    given = F.filter(F.coalesce(answers, blank), lambda v: v.isNotNull() & (T.strip(v) != ""))
    values = F.transform(given, rest)
    if split_commas:
        values = F.flatten(F.transform(values, lambda v: F.split(v, r"(?U),\s*")))
    return F.filter(F.transform(values, T.strip), lambda v: v != "")


def value_letters(values: Column, choices: Column) -> Column:
    """Sorted distinct keys of values looked up in ``choices`` whatever the case; 0 gives Z, an unknown value Y."""

    def letter(v: Column) -> Column:
        hit = F.filter(choices, lambda c: F.lower(T.strip(c["value"])) == F.lower(T.strip(v)))
        return F.when(T.strip(v) == "0", NOT_REPORTED).otherwise(F.coalesce(F.get(F.transform(hit, lambda c: c["key"]), F.lit(0)), F.lit(OTHER)))

    return F.array_sort(F.array_distinct(F.transform(values, letter)))


def metric_number(value: Column, prefix: str) -> Column:
    """The first number of a value that begins with ``prefix``, as text."""
    return F.when(value.startswith(prefix), F.nullif(F.regexp_extract(value, r"[-−]?\d*\.?\d+", 0), F.lit("")))


def outcome_prompt(outcome: Column, single: str, multiple: str) -> Column:
    """The prompt for several outcomes with the outcome put in, or that for one where none is named."""
    return F.when(F.coalesce(outcome, F.lit("")) == "", single).otherwise(F.replace(F.lit(multiple), F.lit("{OUTCOME}"), outcome))


def newest_by(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Of each key the row with the greatest order columns; ties by all columns, so the result is one row for sure."""
    rest = [c for c in df.columns if c not in keys]
    kept = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *(c for c in kept if c not in order))).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def choice_lines(choices: Column) -> Column:
    """``key: value - description`` a line, without the dash where there is no description."""
    return F.array_join(F.transform(choices, lambda c: F.concat(c["key"], F.lit(": "), c["value"], F.when(F.coalesce(T.strip(c["description"]), F.lit("")) != "", F.concat(F.lit(" - "), T.strip(c["description"]))).otherwise(""))), "\n")


def render(template: Column, concept: Column, description: Column, instructions: Column, choices: Column | None = None) -> Column:
    """The template with its fields put in; ``{context}`` stays for the excerpt."""
    out = template
    for field, value in (("{concept}", concept), ("{description}", description), ("{instructions}", instructions), ("{choices}", choices)):
        if value is not None:
            out = F.replace(out, F.lit(field), F.coalesce(value, F.lit("")))
    return out


def render_prompts(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """``query_id``, ``category``, ``prompt``: each category's template for the question's type (a null type holds for all)."""
    joined = queries.alias("q").join(F.broadcast(templates).alias("t"), F.col("t.type").isNull() | (F.col("t.type") == F.col("q.type")))  # a few templates
    lines = F.when(F.size("q.choices") > 0, choice_lines(F.col("q.choices"))).otherwise("{choices}")
    return joined.select("q.query_id", "t.category", F.when(F.col("t.type").isNull(), F.col("t.template")).otherwise(render(F.col("t.template"), F.col("q.description"), F.col("q.description_detailed"), F.col("q.instructions"), lines)).alias("prompt"))


def few_shot(base: Column, examples: Column, answer_lead: str = "Answer: ") -> Column:
    """Examples as excerpt and answer, then the prompt; without examples the prompt alone."""
    blocks = F.array_join(F.transform(examples, lambda e: F.concat(F.lit("Excerpt:\n"), e["context"], F.lit("\n" + answer_lead), e["answer"])), "\n\n")
    return F.when(F.size(examples) > 0, F.concat(blocks, F.lit("\n\n"), base)).otherwise(base)


def select_prompt(prompts: Column, query_type: Column, choices: Column, default: str, use_default: bool) -> Column:
    """``struct<kind, prompt>``: the binary prompts for a question with more than two choices unless the default is
    asked for; true few-shot falls back to synthetic few-shot; an absent prompt gives a null."""
    has_binary = (F.size(F.coalesce(prompts["binary_prompts"], F.expr("cast(array() as array<string>)"))) > 0) & query_type.isin("multiple_choice", "single_choice") & (F.size(choices) > 2)
    own = prompts[default] if default != "true_few_shot_prompt" else F.coalesce(prompts["true_few_shot_prompt"], prompts["synthetic_few_shot_prompt"])
    binary = F.lit(False) if use_default else F.coalesce(has_binary, F.lit(False))
    return F.struct(F.when(binary, "binary").otherwise(default).alias("kind"), F.when(~binary, own).alias("prompt"))


def ordered_columns(names: Column, preferred: tuple[str, ...]) -> Column:
    """Preferred names that are there, in their order, then the others sorted."""
    first = F.array(*map(F.lit, preferred))
    return F.concat(F.filter(first, lambda x: F.array_contains(names, x)), F.array_sort(F.array_except(names, first)))


def html_table(rows: DataFrame, columns: tuple[str, ...], order_col: str) -> DataFrame:
    """One row ``html``: a table of the columns in order, cells escaped. For catalogues, which are small."""
    cells = F.concat(*(F.concat(F.lit("<td>"), T.html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    body = rows.select(F.struct(F.col(order_col).alias("o"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row")).alias("r"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    return body.agg(F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))
