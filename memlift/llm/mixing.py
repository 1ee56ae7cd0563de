"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in order of code points (null last) have weights 1, 2, 3, repeating, and share the words of all
documents; no target is above three times its source's words, and what is over goes to the other sources by weight. That
is one level for the ratio of target to weight at which the targets use up all words.

Whole copies: with ratio = target / source words, each document is taken floor(ratio) times for certain. The rest of the
target is a fixed-size sample with unequal probabilities: a document's inclusion probability is in proportion to its words
(documents so large that it would reach 1 are certain, and the others share what these leave),
its rank is random odds divided by inclusion odds, and documents are taken in order of rank until the words are there.
Random numbers come from the hash of the document's id, so reruns agree.

The order is never sorted as a whole: ranks fall into fixed bins, words are summed by source and bin, and only the bin in
which a source's sample ends is ordered. Last, the one document whose coming in or going out brings a source nearest to its target is
taken or left. So a source with a third of all rows is dealt out like the others.

Nulls: a null text has 0 words and is taken with its source's certain copies, which are no words; a null source is a
source of its own; a null id hashes as the text "null", ties in rank go by id, then by size, and rows equal in both are
taken together or not. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlift.llm.common import WORD, stage

BINS = 4096
MOST_COPIES = 3


def n_words(text: Column) -> Column:
    """Words as runs of what isn't white space, counted by the ends of runs."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, total: DataFrame) -> DataFrame:
    """From (source, source_size) and the one row (all_size): source, source_size, target."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
    # sources reach their cap in order of cap by weight: before each, what is capped and what weight is left
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_COPIES)
    w = w.withColumn("weight_left", F.sum("w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.crossJoin(F.broadcast(total))  # one row
    w = w.withColumn("level", (F.col("all_size") - F.col("capped")) / F.col("weight_left"))
    # the first source that stays under its cap at its level sets the level for all
    under = F.when(F.col("level") * F.col("w") <= F.col("source_size") * MOST_COPIES, F.col("level"))
    w = w.withColumn("final", F.min_by(under, F.struct(F.when(under.isNull(), 1).otherwise(0), F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))).over(Window.partitionBy(F.lit(1))))
    capped = F.lit(float(MOST_COPIES)) * F.col("source_size")
    return w.select("source", "source_size", F.least(capped, F.coalesce(F.col("final") * F.col("w"), capped)).alias("target"))


def _shares(d: DataFrame, goal: DataFrame) -> DataFrame:
    """source, rate, certain_above: a document of a source is in its sample with probability rate * size, and for certain where
    its size is above certain_above, so that the expected words are the rest of the target. From counts by source and size."""
    sizes = d.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("double") * F.col("size") * F.col("n")
    x = sizes.withColumn("above", F.coalesce(F.sum(words).over(by), F.lit(0))).withColumn("left", F.sum(squares).over(Window.partitionBy("source")) - F.coalesce(F.sum(squares).over(by), F.lit(0.0)))
    g = goal.select(F.col("source").alias("own"), "rest")
    x = x.join(g.hint("merge"), F.col("source").eqNullSafe(F.col("own"))).withColumn("rate", (F.col("rest") - F.col("above")) / F.col("left"))
    # the largest size that isn't certain when all above it are
    return x.where(F.col("rate") * F.col("size") < 1).groupBy("source").agg(F.max_by("rate", "size").alias("rate"), F.max("size").alias("certain_above"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: its id, size, source_size, target (of its source), copies, taken (size times copies), source.
    Rows with one id, source and size have the same copies."""
    d = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("long")
    d = stage(d.withColumn("u", (u + 0.5) / float(1 << 48)), "sizes")
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("decimal(20,0)") * F.col("size")).cast("double").alias("squares"))
    sums = stage(sums, "sources")
    goal = targets(sums.select("source", "source_size"), sums.agg(F.sum("source_size").alias("all_size")))
    goal = goal.alias("g").join(sums.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.*", "s.squares")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = stage(goal, "targets")
    share = stage(_shares(d, goal), "shares")
    goal = goal.alias("g").join(share.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")), "left").select("g.*", "s.rate", "s.certain_above")
    goal = stage(goal, "rates").withColumnRenamed("source", "own")
    # one row a source; the table is sent whole only where it is small, else both sides are dealt by source
    hint = "broadcast" if goal.count() <= 10_000 else "merge"
    r = d.join(goal.hint(hint), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    p = F.when(F.col("rest") <= 0, 0.0).when(F.col("size") > F.col("certain_above"), 1.0).otherwise(F.coalesce(F.col("rate") * F.col("size"), F.lit(0.0)))
    odds, inclusion = F.col("u") / (1 - F.col("u")), p / (1 - p)
    # the rank on a scale from 0 to 1; what is certain comes first, no inclusion odds last
    r = r.withColumn("rank", F.when(p >= 1, 0.0).when(p > 0, odds / (odds + inclusion)).otherwise(1.0)).withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    r = r.withColumn("room", F.col("rest"))
    bins = r.where("rank < 1").groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the bin in which a source's sample ends
    edge = bins.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select(F.col("source").alias("own"), F.col("bin").alias("edge"), "before")
    edge = stage(edge, "edges")
    r = r.join(edge.hint(hint), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    inside = r.where((F.col("bin") == F.col("edge")) & (F.col("rank") < 1)).select("source", "id", "rank", "size", "rest", "before")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # a document on the edge is taken when that comes nearer to the target than leaving it out
    chosen = inside.withColumn("upto", upto).where(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    chosen = stage(chosen.select(F.col("source").alias("own"), F.col("rank").alias("last"), F.col("id").alias("last_id"), F.col("size").alias("last_size")), "edge_rows")
    last = chosen.groupBy("own").agg(F.max(F.struct("last", "last_id", "last_size")).alias("last"))
    r = r.join(stage(last, "last").hint(hint), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    key = F.struct(F.col("rank").alias("last"), F.col("id").alias("last_id"), F.col("size").alias("last_size"))
    taken = F.when(F.col("rank") >= 1, 0).when(F.col("edge").isNull(), F.when(F.col("rest") > 0, 1).otherwise(0)).when(F.col("bin") < F.col("edge"), 1).when(F.col("bin") > F.col("edge"), 0)
    taken = taken.otherwise(F.when(F.col("last").isNotNull() & (key <= F.col("last")), 1).otherwise(0))
    r = stage(r.select("id", "source", "size", "source_size", "target", "rank", "whole", taken.cast("long").alias("taken_")), "drawn")
    # what a source's sample misses its target by, and the one document that mends most of it by coming in or going out
    gap = r.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * (F.col("whole") + F.col("taken_")))).alias("gap"))
    gap = stage(gap.withColumnRenamed("source", "own"), "gaps")
    g = r.join(gap.hint(hint), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    miss = F.abs(F.abs(F.col("gap")) - F.col("size"))
    fits = (F.col("rank") < 1) & (F.col("size") > 0) & (miss < F.abs(F.col("gap"))) & (F.col("taken_") == F.when(F.col("gap") > 0, 0).otherwise(1))
    mend = g.where(fits).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "id", "size")).alias("x"))
    mend = stage(mend.select(F.col("source").alias("own"), F.col("x.rank").alias("rank_"), F.col("x.id").alias("id_"), F.col("x.size").alias("size_")), "mended")
    r = r.join(mend.hint(hint), F.col("source").eqNullSafe(F.col("own")) & (F.col("rank") == F.col("rank_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("size") == F.col("size_")), "left")
    changed = F.when(F.col("rank_").isNull(), F.col("taken_")).otherwise(1 - F.col("taken_"))
    r = r.withColumn("copies", F.col("whole") + changed)
    return r.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.col("source").alias(source_col))
