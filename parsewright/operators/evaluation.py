"""Scoring of answers by question type, and applicability rules between questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewright.functions import text as T
from parsewright.operators.catalogue import NOT_APPLICABLE, value_letters

_STRINGS = "cast(array() as array<string>)"


def _score(accuracy: Column, indicator: Column | None = None, value: Column | None = None, number: Column | None = None, true_indicator: Column | None = None, true_value: Column | None = None) -> Column:
    """The one wide result: absent parts are null."""
    strings = lambda c: (c if c is not None else F.lit(None)).cast("array<string>")
    return F.struct(
        strings(indicator).alias("pred_indicator"),
        strings(value).alias("pred_value"),
        (number if number is not None else F.lit(None)).cast("double").alias("pred_num"),
        strings(true_indicator).alias("true_indicator"),
        strings(true_value).alias("true_value"),
        F.coalesce(accuracy.cast("int"), F.lit(0)).alias("accuracy"),
    )


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def score_single(answer: Column, truth: Column, choices: Column) -> Column:
    """First word against the first true answer; Z counts as 0."""
    first = T.first_answer(F.coalesce(answer, F.lit("")))
    key = F.when(first == "Z", "0").otherwise(first)
    true = F.get(truth, F.lit(0))
    named = lambda k: F.coalesce(F.get(F.transform(F.filter(choices, lambda c: c["key"] == k), lambda c: c["value"]), F.lit(0)), F.lit(""))
    return _score(key == true, F.array(key), F.array(named(key)), None, F.array(true), F.array(named(F.coalesce(true, F.lit("")))))


def score_multiple(answer: Column, truth: Column, choices: Column, other: Column | None = None) -> Column:
    """Every capital letter is a choice (so is one inside a word); sets of plain values are compared. Z counts as 0;
    ``other`` is the text that a follow-up gave for Y. No choice and no true answer are equal, being empty sets."""
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("[A-Z]"), F.lit(0))))
    value = lambda k: F.get(F.transform(F.filter(choices, lambda c: F.upper(c["key"]) == k), lambda c: c["value"]), F.lit(0))
    named = F.transform(F.filter(F.transform(letters, value), lambda x: x.isNotNull() & (x != "")), T.plain)
    pred = F.when(F.array_contains(letters, "Z"), F.array(F.lit("0"))).otherwise(named)
    if other is not None:
        pred = F.when(F.array_contains(letters, "Y") & (F.coalesce(other, F.lit("")) != ""), F.concat(pred, F.array(T.plain(other)))).otherwise(pred)
    true = F.transform(F.filter(F.coalesce(truth, F.expr(_STRINGS)), lambda x: x.isNotNull()), T.plain)
    return _score(same_set(pred, true), letters, pred, None, value_letters(true, choices), true)


def score_numeric(answer: Column, truth: Column) -> Column:
    """Equality as doubles; Z counts as 0, what is no number scores 0."""
    pred = F.when(F.upper(T.strip(answer)) == "Z", F.lit(0.0)).otherwise(T.to_number(answer))
    return _score(pred == T.to_number(F.get(truth, F.lit(0))), None, None, pred, None, truth)


def score_list(answer: Column, truth: Column) -> Column:
    """Equality of the sets of parts between commas, in exact writing."""
    pred = F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce(answer, F.lit("")), ","), T.strip)))
    true = F.array_sort(F.array_distinct(F.coalesce(truth, F.expr(_STRINGS))))
    return _score(pred == true, None, pred, None, None, true)


def score_open(answer: Column, truth: Column) -> Column:
    """Offline stand-in for mutual entailment by a model: equality of the plain texts. Not an entailment judgement."""
    return _score(T.plain(F.coalesce(answer, F.lit(""))) == T.plain(F.get(truth, F.lit(0))), None, None, None, None, truth)


def score(df: DataFrame, answer: str = "answer", truth: str = "truth", choices: str = "choices", kind: str = "type") -> DataFrame:
    """Each row scored by its type as ``scored``; an unknown type is an error, a null one scores null."""
    a, t, c, k = F.col(answer), F.col(truth), F.col(choices), F.col(kind)
    by_type = F.when(k == "single_choice", score_single(a, t, c)).when(k == "multiple_choice", score_multiple(a, t, c)).when(k == "numeric", score_numeric(a, t)).when(k == "list", score_list(a, t)).when(k == "open_ended", score_open(a, t))
    return df.withColumn("scored", by_type.when(k.isNotNull(), F.raise_error(F.concat(F.lit("unknown question type: "), k))))


def _equal_values(value: Column, blocked: Column) -> Column:
    """As numbers if both are, else as trimmed texts whatever the case and punctuation."""
    a, b = T.to_number(value), T.to_number(blocked)
    return F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(F.coalesce(T.plain(value) == T.plain(blocked), value.isNull() & blocked.isNull()))


def applicability(results: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("doc_name",)) -> DataFrame:
    """``keys``, ``query_id``, ``applicable``, ``ready`` for each document (of each trial, if the keys say so) and each
    question that has rules.

    ``results`` has the keys, ``query_id``, ``values``; ``rules`` has ``query_id``, ``depends_on``, ``blocked``
    (one row a condition). A question is not applicable if for any condition all values of the question it
    depends on are blocked (no values at all are), and ready once all its dependencies have a result.
    """
    docs = results.select(*keys).distinct()
    pairs = docs.crossJoin(F.broadcast(rules.select("query_id", "depends_on", "blocked")))  # rules are a short list
    same = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys]
    held = pairs.alias("p").join(results.alias("r"), [*same, F.col("p.depends_on") == F.col("r.query_id")], "left")
    blocked = F.col("r.query_id").isNotNull() & F.forall(F.coalesce(F.col("r.values"), F.expr(_STRINGS)), lambda v: _equal_values(v, F.col("p.blocked")))
    return held.groupBy(*(f"p.{k}" for k in keys), "p.query_id").agg(F.bool_and(F.col("r.query_id").isNotNull()).alias("ready"), (~F.bool_or(blocked)).alias("applicable"))


def with_not_applicable(scored: DataFrame, rules_held: DataFrame) -> DataFrame:
    """Rows of questions that are not applicable replaced by the default: prediction -99, accuracy 1."""
    joined = scored.alias("s").join(rules_held.where(~F.col("applicable")).alias("a"), ["doc_name", "query_id"], "left")
    off = F.col("applicable").isNotNull()
    changed = {"raw_output": F.lit("Not applicable"), "pred_value": F.array(F.lit(NOT_APPLICABLE)), "accuracy": F.lit(1)}
    return joined.select(*(F.when(off, changed[c]).otherwise(F.col(f"s.{c}")).alias(c) if c in changed else F.col(c) if c in ("doc_name", "query_id") else F.col(f"s.{c}") for c in scored.columns))


def dependency_levels(rules: DataFrame) -> dict[str, int]:
    """Question -> level: those without rules are 0, others one above the highest they depend on. The rules are a short
    list; a circle is an error."""
    pairs = [(r.query_id, r.depends_on) for r in rules.select("query_id", "depends_on").distinct().collect()]
    level: dict[str, int] = {q: 0 for p in pairs for q in p}
    for _ in range(len(level) + 1):
        new = {q: max([0, *(level[d] + 1 for a, d in pairs if a == q)]) for q in level}
        if new == level:
            return level
        level = new
    raise ValueError("questions depend on each other in a circle")
