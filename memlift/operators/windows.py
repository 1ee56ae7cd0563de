"""Ordered and ranked operators: sequences, flips, watches, keep-first, budgets, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequence(df: DataFrame, key: str, *order: str, name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def flips(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one believed before; the first is believed."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(value) != F.col("before")))


def watch(df: DataFrame, key: str, order: str, value: str, delta: float) -> DataFrame:
    """Adds tripped: the value moved by delta or more since the tick before; the first tick never trips."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("tripped", F.coalesce(F.abs(F.col(value) - before) >= delta, F.lit(False)))


def current_and_previous(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last two values of a key."""
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("r <= 2")
    return ranked.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("current"), F.max(F.when(F.col("r") == 2, F.col(value))).alias("previous"))


def top_k(df: DataFrame, by: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def first_stage(df: DataFrame, by: str, stage: str) -> DataFrame:
    """Of rows tagged with the stage that found them, those of each group's first stage."""
    return df.withColumn("first_", F.min(stage).over(W.partitionBy(by))).where(F.col(stage) == F.col("first_")).drop("first_")


def keep_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("n_ = 1").drop("n_")


def greedy_budget(items: Column, clip: int = 700, budget: int = 6000, mark: str = "…") -> Column:
    """Of an ordered array of texts, those that fit: each is clipped, and one that would pass the budget is skipped, not
    the end. Returns an array of (place, text)."""
    cut = F.transform(items, lambda t, i: F.struct(i.alias("place"), F.when(F.length(t) > clip, F.concat(F.substring(t, 1, clip), F.lit(mark))).otherwise(t).alias("text")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<place:int,text:string>>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + F.length(x["text"]) <= budget
        return F.struct(
            F.when(fits, state["used"] + F.length(x["text"])).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(cut, start, step, lambda s: s["kept"])


def splice(turns: DataFrame, extra: DataFrame, key: str, order: str) -> DataFrame:
    """Extra rows placed after the turn their order names, all renumbered from 0."""
    both = turns.withColumn("at_", F.col(order).cast("double")).unionByName(extra.withColumn("at_", F.col(order) + 0.5))
    return both.withColumn(order, F.row_number().over(W.partitionBy(key).orderBy("at_")) - 1).drop("at_")


def merge_support(sources: list[DataFrame], key: str) -> DataFrame:
    """(key, merged, n) from sources (key, place, body) in order of precedence: each body once, where it first comes, in order of
    source and place. Repeats are folded before rows of a key come together."""
    rows = reduce(DataFrame.unionByName, [d.select(key, F.lit(i).alias("source_"), F.col("place").cast("long").alias("place"), "body") for i, d in enumerate(sources)])
    once = rows.where("body is not null").groupBy(key, "body").agg(F.min(F.struct("source_", "place")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "body")))
    return once.groupBy(key).agg(F.transform(listed, lambda x: x["body"]).alias("merged"), F.count("*").alias("n"))
