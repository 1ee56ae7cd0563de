"""Data-quality gates: each is a named condition for what is wrong with a row or a group; a report has one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """check, passed, n_bad for conditions over rows; one pass over the table for all of them, none stops at the first."""
    counts = df.agg(*(F.coalesce(F.count_if(F.coalesce(c, F.lit(True))), F.lit(0)).alias(n) for n, c in bad.items()))
    long = counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in bad)), F.array(*(F.col(f"`{n}`") for n in bad)))).alias("check", "n_bad"))
    return long.select("check", (F.col("n_bad") == 0).alias("passed"), "n_bad")


def together(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def repeated_keys(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """One check: how many keys stand more than once."""
    return df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n_bad")).select(F.lit(name).alias("check"), (F.col("n_bad") == 0).alias("passed"), "n_bad")


def constant(df: DataFrame, *cols: str) -> DataFrame:
    """One check a column: it has one value."""
    counts = df.agg(*(F.countDistinct(c).alias(c) for c in cols))
    long = counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in cols)), F.array(*cols))).alias("check", "values"))
    return long.select("check", (F.col("values") <= 1).alias("passed"), F.greatest(F.col("values") - 1, F.lit(0)).alias("n_bad"))


def missing(df: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """One check: rows whose key no parent has."""
    n = df.join(parents.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_bad"))
    return n.select(F.lit(name).alias("check"), (F.col("n_bad") == 0).alias("passed"), "n_bad")


def transcript_structure(v: DataFrame) -> DataFrame:
    """Known tiers, T1 never calls the store and the others always do, no cell twice, all four tiers for each segment, one
    ability a segment."""
    rows = report(
        v,
        {
            "known tiers": ~F.col("tier").isin("T1", "T2", "T3", "T4"),
            "T1 never calls the store": (F.col("tier") == "T1") & F.col("store_call"),
            "other tiers call it": (F.col("tier") != "T1") & ~F.col("store_call"),
        },
    )
    per = v.groupBy("seg_id").agg(F.countDistinct("tier").alias("tiers"), F.countDistinct("ability").alias("abilities"))
    return together(rows, repeated_keys(v, "no cell twice", "seg_id", "tier"), report(per, {"all four tiers": F.col("tiers") != 4, "one ability": F.col("abilities") != 1}))


def statistics() -> dict[str, Column]:
    """What is wrong with a statement of statistics: method, stated (number of clusters), score, lower and upper as stated, beside
    clusters, derived, low and high as worked out from the rows. A missing interval doesn't agree."""
    near = lambda a, b, by: F.coalesce(F.abs(F.col(a) - F.col(b)) < by, F.lit(False))
    return {
        "method is paired": F.col("method") != "paired-cluster",
        "clusters agree": F.col("stated") != F.col("clusters"),
        "score is derived": ~near("score", "derived", 1e-9),
        "interval in order": F.col("lower") > F.col("upper"),
        "interval agrees": ~(near("lower", "low", 1e-6) & near("upper", "high", 1e-6)),
    }
