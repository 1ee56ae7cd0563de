"""How quality filters overlap: every order of the filters, step by step, and each filter's share over all orders.

A document's failures are one mask, a bit a filter. Documents are counted by part (language), mask and label, which leaves at most
32 cells a part, so the texts are read once and no order of filters reads them again. A recursive query then extends
prefixes of filters by each unused letter, joins them with the cells and carries the bits applied so far: each level of
the recursion says of each cell whether that step removes it, finds it removed already, or leaves it. Sums by part and prefix
are the metrics of the step, and the 120 full orders read them from their five prefixes.

Filter E (a text that a smaller doc_id has too) is counted without joining documents with each other: equal texts have equal
A to D, so rows are first summed by text and id, then by text, part, label and mask with the least id of each, and of
these few rows a text the least id of all. The key of a text is its SHA-256, and a text that a third of all rows
hold is summed in each task before anything is shuffled.

A null text is empty, a null lang is the part "". A null doc_id is neither smaller nor larger than another: such a row doesn't
fail E and makes no other row fail it. Rows with one doc_id and text count one by one, none of them fails E by the others.
A document with several label rows is good or toxic if one of them says so; one without is neither. Further columns don't
matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlift.llm.common import stage, unstage

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = "[#$%&*|]"
BREAK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of A to D for a text that isn't null."""
    words = F.filter(F.split(text, BREAK), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        F.when(F.size(words) < MIN_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words), 2).otherwise(0)
        + F.when(100 * capitals > MAX_CAPITALS * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters of mask, and how many of them are labelled so."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("body"), failures(text).alias("mask"))
    rows = slim.groupBy("doc_id", "part", "body", "mask").agg(F.count("*").alias("n"))
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.hint("merge").join(flags.hint("merge"), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ("part", "mask", "good", "toxic")
    # the same id with one text in several parts: E compares ids, so each group keeps its least id with the rows that have it
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = rows.groupBy("body", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), least.alias("least"))
    by_text = groups.groupBy("body").agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct(*kind, "n", "with_id", "least")).alias("g"))
    g = by_text.select("first", F.inline("g"))
    stay = F.col("n") - F.col("with_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = g.select(*kind, F.explode(F.array(F.struct(stay.alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") - stay).alias("n"), F.lit(16).alias("e")))).alias("x"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    cell = both.groupBy("part", (F.col("mask") + F.col("x.e")).alias("cell")).agg(F.sum("x.n").alias("n"), counted("good").alias("n_good"), counted("toxic").alias("n_toxic"))
    return cell.where("n > 0").select("part", F.col("cell").alias("mask"), "n", F.col("n_good").alias("good"), F.col("n_toxic").alias("toxic"))


#: Prefixes grow by one unused letter a level; each is joined with every cell. `applied` holds the bits before the step's own.
WALK = """with recursive filters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(part, prefix, step, applied, bit, mask, n, good, toxic) as (
    select part, letter, 1, 0, bit, mask, n, good, toxic from {cells} cross join filters
    union all
    select w.part, concat(w.prefix, f.letter), w.step + 1, w.applied | w.bit, f.bit, c.mask, c.n, c.good, c.toxic
    from walk w join filters f on (w.applied | w.bit) & f.bit = 0 join {cells} c on c.part = w.part and c.mask = w.mask)
select part, prefix, step, right(prefix, 1) as letter,
    sum(case when mask & (applied | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & applied = 0 and mask & bit > 0 then n else 0 end) as removed,
    sum(case when mask & applied > 0 and mask & bit > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & applied = 0 and mask & bit > 0 then good else 0 end) as good_lost,
    sum(case when mask & applied = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
from walk group by part, prefix, step"""


def _walk(cell: DataFrame) -> DataFrame:
    """The metrics of each part and prefix, written. The recursion has 325 prefixes x 32 cells a part, so its row limit, which
    is there for recursions that don't end, is lifted while it runs."""
    spark: SparkSession = cell.sparkSession
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        return stage(spark.sql(WALK, cells=cell), "walk")
    finally:
        spark.conf.set(key, before)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, filter_order and step with the counts of that step and the filter's removals over all orders."""
    cell = stage(cells(docs, labels), "cells")
    steps = _walk(cell)
    unstage(cell)
    full = steps.where(F.col("step") == len(FILTERS)).select(F.col("part").alias("part_"), F.col("prefix").alias("filter_order"))
    cut = full.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step_")).withColumn("prefix_", F.expr("left(filter_order, step_)"))
    out = cut.hint("merge").join(steps.hint("merge"), (F.col("part") == F.col("part_")) & (F.col("prefix") == F.col("prefix_")))
    # a prefix of k letters begins (5 - k)! orders
    times = F.element_at(F.array(*(F.lit(x) for x in (24, 6, 2, 1, 1))), F.col("step"))
    share = steps.groupBy(F.col("part").alias("part_s"), F.col("letter").alias("letter_s")).agg(F.sum(F.col("removed") * times).alias("shapley"))
    out = out.join(share.hint("merge"), (F.col("part") == F.col("part_s")) & (F.col("letter") == F.col("letter_s")))
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *(F.col(c).cast("long").alias(c) for c in counts))
