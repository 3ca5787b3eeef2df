"""Configuration sweeps: the grid, keys, resuming, accuracy aggregates and frames for analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsewright.functions import text as T
from parsewright.session import cut_lineage


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the given values, a column each; the values are literals, so nothing is joined."""
    df = spark.range(1)
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return df.drop("id")


def config_key(*names: str) -> Column:
    """MD5 over name=value of the columns in order of their names, nulls written out."""
    return F.md5(F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in sorted(names))))


def not_done(wanted: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What is still to do; null keys match each other."""
    d = done.select(*keys).distinct()
    return wanted.alias("w").join(d.alias("d"), [F.col(f"w.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys], "left_anti")


def not_done_items(groups: DataFrame, items: DataFrame, done: DataFrame, keys: tuple[str, ...], item: str) -> DataFrame:
    """``not_done`` for each row of ``groups`` times ``items``, a short list: the groups alone are shuffled, with a list of
    what is done of each; null keys and items match each other."""
    d = done.groupBy(*keys).agg(F.collect_set(F.struct(item)).alias("_done"))
    held = groups.alias("g").join(d.alias("d"), [F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys], "left").select("g.*", "_done")
    every = items.agg(F.collect_list(F.struct(item)).alias("_items"))
    left = F.filter("_items", lambda x: ~F.coalesce(F.array_contains("_done", x), F.lit(False)))
    return held.crossJoin(F.broadcast(every)).select(*keys, F.explode(left).alias("_item")).select(*keys, f"_item.{item}")


def allowed(df: DataFrame, allow_list: DataFrame, key: str) -> DataFrame:
    return df.join(allow_list.select(key).distinct(), key, "left_semi")


def assign_ids(existing: DataFrame, names: DataFrame, name: str = "doc_name", number: str = "doc_number") -> DataFrame:
    """Stable numbers: known names keep theirs, new ones go on in order of their names.

    New names are parted into ranges in order; each range's names are ranked by themselves and moved on by the counts of the
    ranges before it, so no task holds all names.
    """
    last = existing.agg(F.coalesce(F.max(number), F.lit(-1)).alias("last"))
    new = names.select(name).distinct().join(existing, name, "left_anti")
    # written once: ranges are drawn by a sample, which must not change between the counts and the ranks
    ranged = cut_lineage(new.repartitionByRange(name).sortWithinPartitions(name).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    ranked = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(name)))
    numbered = ranked.join(F.broadcast(before), "_range").crossJoin(F.broadcast(last)).select(name, (F.col("last") + F.col("_before") + F.col("_place")).cast("bigint").alias(number))
    return existing.select(name, F.col(number).cast("bigint").alias(number)).unionByName(numbered)


def accuracy_sets(results: DataFrame, *keys: str, value: str = "accuracy") -> DataFrame:
    """Mean accuracy by each key alone and over all, in one pass; ``level`` names the key."""
    sets = [[F.col(k)] for k in keys]
    grouped = results.groupingSets([*sets, []], *(F.col(k) for k in keys)).agg(F.avg(value).alias("mean_accuracy"), F.count(value).cast("bigint").alias("n"), *(F.grouping(k).alias(f"_{k}") for k in keys))
    level = F.coalesce(*(F.when(F.col(f"_{k}") == 0, k) for k in keys), F.lit("total"))
    return grouped.select(level.alias("level"), *keys, "mean_accuracy", "n")


def trial_means(results: DataFrame) -> DataFrame:
    """Mean over questions of each document of each trial, then the trial's mean over documents."""
    by_doc = results.where(F.col("accuracy").isNotNull()).groupBy("trial_id", "doc_name").agg(F.avg("accuracy").alias("doc_accuracy"))
    return by_doc.groupBy("trial_id").agg(F.avg("doc_accuracy").alias("mean_accuracy"), F.count("*").cast("bigint").alias("n_docs"))


def should_stop(trials: DataFrame, order: str = "trial_id", value: str = "overall_average_accuracy", last: int = 10, spread: float = 0.01) -> DataFrame:
    """``stop`` where the accuracies of the last trials lie within ``spread``. Trials are few; the window has one partition."""
    w = Window.orderBy(order).rowsBetween(-(last - 1), 0)
    known = trials.where(F.col(value).isNotNull())
    return known.select(order, value, F.coalesce((F.count(value).over(w) == last) & (F.max(value).over(w) - F.min(value).over(w) < spread), F.lit(False)).alias("stop"))


def spec_curve(trials: DataFrame, parameters: tuple[str, ...], value: str = "overall_average_accuracy", labels: dict[str, str] | None = None) -> DataFrame:
    """Trials ranked by accuracy, one row per parameter: ``rank``, ``trial_id``, ``value``, ``parameter``, ``setting``, and
    whether the parameter is categorical (more than two settings that are no numbers)."""
    ranked = trials.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "trial_id")))
    long = ranked.unpivot(["rank", "trial_id", value], [F.col(p).cast("string").alias(p) for p in parameters], "parameter", "setting")
    kinds = long.where("setting is not null").groupBy("parameter").agg(((F.countDistinct("setting") > 2) & ~F.bool_and(T.to_number(F.col("setting")).isNotNull())).alias("categorical"))
    shown = F.col("setting")
    if labels:
        mapping = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
        shown = F.coalesce(mapping[F.col("setting")], F.col("setting"))
    return long.join(F.broadcast(kinds), "parameter", "left").select("rank", "trial_id", value, "parameter", shown.alias("setting"), F.coalesce("categorical", F.lit(False)).alias("categorical"))


def natural_order(df: DataFrame, column: str, out: str = "place") -> DataFrame:
    """Place of each distinct dotted id in natural order."""
    return df.select(column).distinct().withColumn(out, F.row_number().over(Window.orderBy(T.natural_key(F.col(column)), column)))


def summary_frame(summaries: DataFrame) -> DataFrame:
    """Trial summaries with their parameters as columns."""
    return summaries.select("trial_number", "overall_average_accuracy", "parameters.*").orderBy("trial_number")


def aggregate_points(summaries: DataFrame, map_col: str, key: str) -> DataFrame:
    """A map column of each trial's means as rows, with the mean of each key over trials."""
    rows = summaries.select("trial_number", F.explode(map_col).alias(key, "mean_accuracy"))
    return rows.withColumn("overall", F.avg("mean_accuracy").over(Window.partitionBy(key)))
