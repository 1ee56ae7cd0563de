"""Exact Jaccard self-join on word shingles by T-occurrence search.

A document's set has its distinct shingles of five lower-cased words. Two documents of s and t shingles link when their
overlap is at least T = ceil(0.8 / 1.8 * (s + t)), which for any partner is at least ceil(0.8 * s). DivideSkip splits a
document's inverted lists by length: of its s lists, the T - 1 longest are only probed, and each partner must occur in one
of the s - T + 1 shorter ones; with T - 10 probed lists, a partner must occur in 10 of the s - T + 10 shorter ones, which keeps
chance meetings out; of large sets it is T - s / 10 probed lists and s / 10 meetings, so documents that share a passage only
drop out by their counts alone. Lists are ordered by how often a shingle occurs (frequent ones last, others by hash), the
same for all documents, so the short lists are each set's first entries. The short lists are merged by Spark's sort-merge
joins and counts of (document, partner); the long ones are probed by binary search in the partner's sorted set, which gives
the exact overlap.

Copies of a set collapse into one class before lists are made, and pairs inside a group that is connected already are never
made (see components.linked_groups), so groups of thousands of copies cost as much as their members.

Which shingles are frequent only orders lists; it never changes a result. So it comes from counts in each input split, over
documents that don't share their smallest or largest shingle hash with one before (copies, mostly), and the largest sums are kept.

Fewer than five words are one shingle. Nulls and empty texts have an empty set, which links with nothing. Very long texts
are read whole. Repeated rows count as copies, and rows that share an id share its links. A null id is kept, alone. Further columns
don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import release, sized, stage, unstage
from memlift.llm.components import linked_groups, only
from memlift.llm.wordhash import shingle_sets
from memlift.shipping import ship

SHINGLE = 5
PERCENT = 80
#: So many shingles at most are known as frequent: 6.4 MB that goes to each task.
FREQUENT = 400_000
#: A partner must occur in so many short lists and in a tenth of the set's size (in all that an overlap needs, where that is fewer).
LEAST_MET = 10
#: Counts of shingles in a split are taken over so many at a time.
AT_ONCE = 1_500_000
LONGS = pa.list_(pa.int64())


def lists_met(n: int, percent: int = PERCENT) -> int:
    """How many of a set's short lists each partner occurs in."""
    return min(-(-percent * n // 100), max(LEAST_MET, n // 10))


def lists_met_column(n: Column, percent: int = PERCENT) -> Column:
    return F.least(F.ceil(n * percent / 100), F.greatest(F.lit(LEAST_MET), F.floor(n / 10)))


def short_lists(members: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The s - T + lists_met(s) members that come first in the order of lists: those that aren't known as frequent, by hash,
    and after them those that are, from the rarest on. members and frequent are sorted."""
    s = len(members)
    n = s - -(-percent * s // 100) + lists_met(s, percent)
    if not s or not len(frequent):
        return members[:n], members[:0]
    at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
    hit = frequent[at] == members
    rare = members[~hit][:n]
    known = members[hit]
    return rare, known[np.argsort(rank[at[hit]], kind="stable")][: n - len(rare)]


def _sets_of(batch: pa.RecordBatch, column: int):
    """(first row, sets) of a batch in pieces of bounded size."""
    for at in range(0, batch.num_rows, 500):
        yield at, shingle_sets(batch.column(column).slice(at, 500).to_pylist(), SHINGLE)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the largest sums of counts in splits, sorted, each with its place from the rarest on."""
    target = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def counts(held):
        keys = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        c = np.diff(np.append(first, len(keys)))
        hit = c >= 3
        return pa.RecordBatch.from_arrays([pa.array(keys[first[hit]]), pa.array(c[hit])], schema=target)

    def run(batches):
        held, total, seen = [], 0, (set(), set())
        for batch in batches:
            for _, sets in _sets_of(batch, 0):
                for m in sets:
                    if not len(m) or m[0] in seen[0] or m[-1] in seen[1]:  # copies, near ones too, don't make a shingle frequent
                        continue
                    seen[0].add(m[0])
                    seen[1].add(m[-1])
                    held.append(m)
                    total += len(m)
                    if total > AT_ONCE:
                        yield counts(held)
                        held, total, seen = [], 0, (set(), set())
        if total:
            yield counts(held)

    ship(docs.sparkSession)
    seen = docs.select("text").mapInArrow(run, "key long, c long")
    top = seen.groupBy("key").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "key").limit(FREQUENT).toArrow()
    keys = top.column("key").to_numpy()
    place = np.arange(len(keys), 0, -1, dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], place[order]


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, sign (16 bytes of the set) and its short lists, in short those not known as frequent and in hot the
    rest; docs: id, text."""
    frequent, rank = _frequent(docs)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, rank))
    target = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("sign", pa.binary()), ("short", LONGS), ("hot", LONGS)])

    def run(batches):
        known, place = sent.value
        for batch in batches:
            for at, sets in _sets_of(batch, 1):
                both = [short_lists(m, known, place, percent) for m in sets]
                cols = [[len(m) for m in sets], [xxhash.xxh3_128_digest(m.tobytes()) for m in sets], [x[0] for x in both], [x[1] for x in both]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), *(pa.array(c, f.type) for c, f in zip(cols, list(target)[1:]))], schema=target)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "id long, n_shingles long, sign binary, short array<long>, hot array<long>")


def member_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members) of the documents in ids."""
    target = pa.schema([("id", pa.int64()), ("members", LONGS)])

    def run(batches):
        for batch in batches:
            for at, sets in _sets_of(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(sets, LONGS)], schema=target)

    return only(docs, ids).select("id", "text").mapInArrow(run, "id long, members array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: its id, n_shingles, class_id (the smallest id with the same set) and component_id."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    full = stage(classes(own, percent), "classes")
    # one id stands for each set; the others' lists are left out
    known = full.where("n_shingles > 0 and id is not null")
    copied = stage(known.groupBy("sign").agg(F.min("id").alias("class_id"), F.count("*").alias("c")).where("c > 1").select("sign", "class_id"), "copied")
    others = stage(known.select("id", "sign").join(copied.hint("merge"), "sign").where("id != class_id").select("id", "sign").distinct(), "others")
    lists = known.join(sized(others), ["id", "sign"], "left_anti")
    n = F.col("n_shingles").cast("int").alias("n")
    postings, hot = (lists.select(F.explode(c).alias("key"), "id", n) for c in ("short", "hot"))
    linked = linked_groups(postings, lambda ids: member_sets(own, ids), percent, lambda n: lists_met_column(n, percent), hot)
    linked = stage(linked.withColumnRenamed("id", "class_id"), "linked")
    found = stage(full.select("id", "n_shingles", "sign"), "signs")
    unstage(full, others)
    release(spark)
    out = found.join(copied.hint("merge"), "sign", "left").withColumn("class_id", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "id")).otherwise(F.col("id")))
    out = out.join(linked.hint("merge"), "class_id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
