"""Seeded sampling, balanced order, chunking and the paired cluster bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.functions import text as T
from memlift.operators.graph import cut
from memlift.shipping import ship

# Fixed values of the seeded generator: its start and its step for each draw.
SEED, STEP = 0x414D4249, 0x6D2B79F5
ITERATIONS = 2000


def draw(k: Column) -> Column:
    """The k-th draw (from 1) of the seeded generator; each draw depends on its number only, so draws are independent."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = T.times32(k.bitwiseAND(mask), STEP)
    return T.mulberry((F.lit(SEED).cast("long") + step).bitwiseAND(mask))


def stratified(df: DataFrame, stratum: str, key: str, seed: str, limit: int | None = None, cap: int | None = None) -> DataFrame:
    """Rounds over strata: in each stratum rows come in the order of a seeded hash; round r takes the r-th of each."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(stratum).cast("string"), F.col(key).cast("string")).cast("binary"), 256)
    ranked = df.withColumn("round", F.row_number().over(W.partitionBy(stratum).orderBy(h, key)))
    if cap is not None:
        ranked = ranked.where(F.col("round") <= cap)
    return ranked if limit is None else ranked.orderBy("round", stratum).limit(limit)


def tier_order(tiers: list[str], shift: Column) -> Column:
    """The tiers rotated by a shift: over segments and repeats, each tier stands in each place equally often."""
    n = len(tiers)
    return F.array(*(F.element_at(F.array(*(F.lit(t) for t in tiers)), (F.pmod(shift + i, F.lit(n)) + 1).cast("int")) for i in range(n)))


def chunks(turns: DataFrame, key: str, order: str, text: str, size: int = 8, clip: int = 800) -> DataFrame:
    """Turns of a key in groups of `size`, each turn clipped, as one excerpt: key, chunk, n, excerpt."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    rows = turns.withColumn("n_", n).withColumn("chunk", F.floor(F.col("n_") / size).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("n_", F.substring(text, 1, clip).alias("t"))))
    return rows.groupBy(key, "chunk").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("excerpt"))


def cluster_means(verdicts: DataFrame, tiers: tuple[str, ...] = ("T1", "T2", "T3", "T4")) -> DataFrame:
    """Per segment the mean of `hit` by tier, over its replicates; segments with a replicate that lacks a tier are left out."""
    per = verdicts.groupBy("seg_id", "replicate").pivot("tier", list(tiers)).agg(F.max(F.col("hit").cast("int")))
    whole = F.lit(True)
    for t in tiers:
        whole = whole & F.col(t).isNotNull()
    return per.withColumn("whole", whole).groupBy("seg_id").agg(F.bool_and("whole").alias("whole"), *(F.avg(t).alias(t) for t in tiers)).where("whole").drop("whole")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with place, 0 on by order, without one task for all rows: ranges are sorted by themselves and their sizes give the
    offsets. Only the table of ranges, one row a task, is in one window."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("id_", F.monotonically_increasing_id())
    ranged = cut(ranged)  # written once: ranges come from a sample, which another run may draw otherwise
    ranged = ranged.withColumn("part_", F.shiftright("id_", 33)).withColumn("at_", F.col("id_").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(sizes.select("part_", before.alias("before_")).hint("broadcast"), "part_").withColumn("place", F.col("before_") + F.col("at_")).drop("id_", "part_", "at_", "before_")  # one row a task


#: Clusters whose means one task holds (4 MB at four tiers), and iterations it draws.
CLUSTER_BLOCK, DRAW_BLOCK = 1 << 17, 50


def _draws(k: np.ndarray) -> np.ndarray:
    """draw() for an array of numbers."""
    m32 = np.uint64(0xFFFFFFFF)
    a = (np.uint64(SEED) + (k.astype(np.uint64) & m32) * np.uint64(STEP)) & m32
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & m32
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & m32)) & m32
    return ((t ^ (t >> np.uint64(14))) & m32) / 4294967296.0


def paired_bootstrap(means: DataFrame, iterations: int = ITERATIONS, by: str | None = None) -> DataFrame:
    """Intervals of completion by tier and of the deltas to T1, from resampled segments: (by,) metric, lower, upper.

    Iteration b picks cluster floor(u * n) with draw b * n + i + 1, for i from 0 to n - 1. A task has the means of one block of
    clusters and a block of iterations: it makes the draws by numpy, counts how often each cluster of its block is picked, and
    multiplies counts by means. So no pick is a row: the clusters are shuffled once for every DRAW_BLOCK iterations, and
    each task gives one row an iteration. With `by`, each group is resampled by itself; groups of fewer than two have none."""
    spark = means.sparkSession
    ship(spark)
    tiers = [c for c in means.columns if c not in ("seg_id", by)]
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    rows = cut(numbered(means.withColumn("group_", group).withColumn("order_", F.struct("group_", "seg_id")), "order_"))
    sizes = cut(rows.groupBy("group_").agg(F.min("place").alias("first_"), F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(sizes.hint("broadcast" if sizes.count() <= 100_000 else "merge"), "group_").withColumn("place", F.col("place") - F.col("first_"))
    blocks = rows.select("group_", "n", "place", F.floor(F.col("place") / CLUSTER_BLOCK).alias("block"), *(F.col(t).cast("double").alias(t) for t in tiers), F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // DRAW_BLOCK))).alias("turn"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        group, n, block, turn = (int(x) for x in key)
        low = block * CLUSTER_BLOCK
        x = part.sort_values("place")[tiers].to_numpy()
        out = []
        for b in range(turn * DRAW_BLOCK, min(iterations, (turn + 1) * DRAW_BLOCK)):
            counts = np.zeros(len(x), np.int64)
            for at in range(0, n, 1 << 20):
                place = np.floor(_draws(np.arange(b * n + at + 1, b * n + min(n, at + (1 << 20)) + 1)) * n).astype(np.int64) - low
                counts += np.bincount(place[(place >= 0) & (place < len(x))], minlength=len(x))
            out.append((group, n, b, *(counts[:, None] * x).sum(0)))
        return pd.DataFrame(out, columns=["group_", "n", "b", *tiers])

    sums = blocks.groupBy("group_", "n", "block", "turn").applyInPandas(run, f"group_ long, n long, b long, {', '.join(f'{t} double' for t in tiers)}")
    b = sums.groupBy("group_", "n", "b").agg(*((F.sum(t) / F.col("n")).alias(t) for t in tiers))
    metrics = {t: F.col(t) for t in tiers} | {f"{t}-T1": F.col(t) - F.col("T1") for t in tiers if t != "T1"}
    metrics["interaction"] = (F.col("T3") - F.col("T1")) - ((F.col("T2") - F.col("T1")) + (F.col("T4") - F.col("T1")))
    found = cut(b.select("group_", F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in metrics)), F.array(*metrics.values()))).alias("metric", "value")))
    lower, upper = (at_share(found, ["group_", "metric"], "value", p, name) for p, name in ((0.025, "lower"), (0.975, "upper")))
    out = lower.join(upper, ["group_", "metric"])
    return out.withColumnRenamed("group_", by) if by else out.drop("group_")


def at_place(df: DataFrame, by: list[str], c: str, place: Column, name: str) -> DataFrame:
    """by, name: the value at a place (0 on, from the group's size n_) of a group's sorted values; no value between two is made up.
    Counts by distinct value and running sums of these take the place of sorted arrays, so no group is held whole."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("c_"))
    w = W.partitionBy(*by)
    run = counts.withColumn("n_", F.sum("c_").over(w)).withColumn("upto_", F.sum("c_").over(w.orderBy(c).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return run.where(F.col("upto_") > place).groupBy(*by).agg(F.min(c).alias(name))


def at_share(df: DataFrame, by: list[str], c: str, p: float, name: str) -> DataFrame:
    """The value at floor(p * (n - 1)) of a group's sorted values."""
    return at_place(df, by, c, F.floor(F.lit(p) * (F.col("n_") - 1)), name)


def upper_median(df: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
    """The value at floor(n / 2) of a group's sorted values."""
    return at_place(df, by, c, F.floor(F.col("n_") / 2), name)


def keep_flagged_stride(df: DataFrame, key: str, order: str, flag: str, most: int) -> DataFrame:
    """All flagged rows, and of the others every so many-th, so that about `most` stay; in order."""
    w = W.partitionBy(key, flag).orderBy(order)
    total = W.partitionBy(key, flag)
    rows = df.withColumn("place", F.row_number().over(w) - 1).withColumn("stride", F.greatest(F.lit(1), F.ceil(F.count("*").over(total) / most)))
    return rows.where(F.col(flag) | (F.col("place") % F.col("stride") == 0)).drop("place", "stride")
