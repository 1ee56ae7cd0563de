"""Connected components and links found through shared keys, for groups of any size.

components() gives every linked id the smallest id that its links reach, by alternating large-star and small-star steps:
each round of joins and grouped minima at least squares what an id has seen, so a few rounds do.

linked_groups() finds the components of "similar enough" among ids that share keys, without making all pairs of a group. Each
similar pair shares at least met(n) keys, so ids with fewer shared keys go first. Then each id is checked with the two leaders
(smallest and largest id of a key) it shares most keys with. Only keys whose ids are still in different components go on, and of
their ids only those with enough such keys. Pairs are then made and checked by key where few ids share it, else by the rarest
members. Nothing that is similar stays unconnected: a pair that shares enough keys is in one component already, or shares them
all with few others, or both have a key that many share, and then its rare members bring it together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlift.llm.common import BROADCAST_IDS, arrow_rows, release, sized, stage, unstage
from memlift.shipping import ship


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From (a, b) to (id, component) of all ids with a link to another."""
    spark = edges.sparkSession
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage(e, "edges")
    for _ in range(most_rounds):
        # stars around their smallest id are the end: nobody has two centres, and no centre has one itself
        two = e.groupBy("a").count().where("count > 1").limit(1).count()
        if not two and not e.select(F.col("b").alias("a")).distinct().hint("merge").join(e.select("a"), "a", "left_semi").limit(1).count():
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a != b").distinct(), "large_star")
        unstage(least)
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = large.join(least.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = e
        e = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small_star")
        unstage(old, large, least)
        release(spark)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sets have 100 * intersection >= percent * union. sets: id, members (sorted, distinct longs).

    The shorter set's members are probed into the longer sorted one by binary search."""
    s = sets.select("id", "members")
    with_b = pairs.join(s.select(F.col("id").alias("b"), F.col("members").alias("mb")).hint("merge"), "b")
    with_a = with_b.join(s.select(F.col("id").alias("a"), F.col("members").alias("ma")).hint("merge"), "a").select("a", "b", "ma", "mb")
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            ma, mb = batch.column(2), batch.column(3)
            va, oa, vb, ob = ma.values.to_numpy(), ma.offsets.to_numpy(), mb.values.to_numpy(), mb.offsets.to_numpy()
            keep = []
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                if len(x) * 100 < percent * len(y) or not len(x):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=target)

    ship(pairs.sparkSession)
    return with_a.mapInArrow(run, "a long, b long")


#: A key with more ids than this makes no pairs by itself.
SHORT_KEY = 6


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (with an id) whose id is in ids. Few ids are sent to the rows; else both are dealt out by id."""
    return rows.join(sized(ids), "id", "left_semi")


def _able(rows: DataFrame, met: Callable[[Column], Column] | None, label: str) -> DataFrame:
    """Rows (key, id, n, ...) of the ids with as many keys as any similar partner would need.

    A pair shares met() of the smaller set's size at least; seen from the larger set that is two less at most."""
    if met is None:
        return rows
    able = rows.groupBy("id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= met(F.col("n")) - 2).select("id")
    return rows.join(stage(able, label).hint("merge"), "id")


def shared_postings(postings: DataFrame, hot: DataFrame | None) -> DataFrame:
    """key, id, n, lo, hi (the two leaders of the key: its smallest id, by rank where there is one, and its largest) of the keys
    that several ids have. Postings of keys known to be common (hot) are counted before they are shuffled and joined with
    the counts, so that a hot key can be split."""

    first = F.struct("rank", "id") if "rank" in postings.columns else F.struct("id")
    per = Window.partitionBy("key")
    lo = F.min(first).over(per)["id"]
    more = F.min("id").over(per) < F.max("id").over(per)
    out = postings.select("key", "id", "n", lo.alias("lo"), F.max("id").over(per).alias("hi"), more.alias("more")).where("more").drop("more")
    if hot is not None:
        ends = hot.groupBy("key").agg(F.min(first)["id"].alias("lo"), F.max("id").alias("hi"), (F.min("id") < F.max("id")).alias("more")).where("more").drop("more")
        out = out.unionByName(hot.join(ends.hint("merge"), "key").select("key", "id", "n", "lo", "hi"))
    return out


def linked_groups(postings: DataFrame, load_sets: Callable[[DataFrame], DataFrame], percent: int, met: Callable[[Column], Column] | None = None, hot: DataFrame | None = None) -> DataFrame:
    """postings, hot: key, id, n (size of the id's set) and, if wanted, rank (smallest: first leader), each (key, id) once. load_sets: from a table of ids to (id, members).
    A similar pair shares at least met(n of the smaller) keys (one, where met is None). Returns (id, component) of linked ids."""
    spark = postings.sparkSession
    found = stage(shared_postings(postings, hot), "shared_postings")
    release(spark)
    shared = stage(_able(found, met, "able"), "able_postings") if met else found
    with arrow_rows(spark, 500):
        sets = stage(load_sets(stage(shared.select("id").distinct(), "shared_ids")), "sets")
    if met:
        unstage(found)
    release(spark)
    need = met(F.col("n")) if met else F.lit(1)
    first = []
    for end in ("lo", "hi"):  # the leader that shares most keys
        most = shared.where(F.col("id") != F.col(end)).groupBy("id", F.col(end).alias("b")).agg(F.count("*").alias("met"), F.first("n").alias("n")).where(F.col("met") >= need - 2)
        first.append(most.groupBy("id").agg(F.max(F.struct("met", -F.col("b"))).alias("x")).select(F.col("id").alias("a"), (-F.col("x.col2")).alias("b")))
    links = _check(stage(first[0].unionByName(first[1]).distinct(), "first_pairs"), sets, percent, "links_first")
    comp = stage(components(links), "components_first")
    own = stage(shared.select("key", "id", "n").join(comp.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), "own")
    unstage(shared, comp)
    release(spark)
    # keys whose ids are in one component already have nothing to add
    mixed = stage(own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"), "mixed")
    left = stage(_able(own.join(mixed.hint("merge"), "key"), met, "mixed_able"), "mixed_own")
    unstage(own, mixed)
    release(spark)
    # keys with a few ids: their pairs. Whoever has a key with many is compared by rare members instead
    many = stage(left.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > SHORT_KEY).select("key"), "long_keys")
    few = left.join(many.hint("merge"), "key", "left_anti")
    pairs = stage(_pairs(few, percent).groupBy("a", "b").agg(F.count("*").alias("met"), F.first("n").alias("n")).where(F.col("met") >= need).select("a", "b"), "pairs")
    crowd = stage(left.join(many.hint("merge"), "key", "left_semi").select("id", "n", "component").distinct(), "crowd")
    release(spark)
    more = _check(pairs, sets, percent, "links_more")
    rare = _check(stage(_rare_pairs(crowd, sets, percent), "rare_pairs"), sets, percent, "links_rare")
    unstage(left, many, crowd, sets)
    return components(links.unionByName(more).unionByName(rare))


def _pairs(rows: DataFrame, percent: int, places: bool = False) -> DataFrame:
    """a, b, n (the smaller size) for ids of different components and fitting sizes under one key; rows: key, id, n, component.

    With places (the key's place among its id's members, by one order for all), rows also go unless what stands behind the
    two places is enough for the overlap: the first member that a similar pair shares has nothing shared before it."""
    x = rows.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), *([F.col("place").alias("pa")] if places else []))
    y = rows.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), *([F.col("place").alias("pb")] if places else []))
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    if places:
        close &= F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    return x.hint("merge").join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "b", F.least("na", "nb").alias("n"))


def _rare_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest members; crowd: id, n, component.

    With members ordered by how often they occur among these ids, a pair that is similar enough shares one of each set's
    first n - ceil(percent * n) + 1. Versions of a text have their own edits there, so a group of versions that aren't
    similar makes hardly any pairs, however large it is."""
    sets = stage(sets.join(crowd.hint("merge"), "id"), "crowd_sets")
    rows = sets.select("id", F.explode("members").alias("key"))
    often = stage(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "crowd_counts")
    shared = rows.join(often.hint("merge"), "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("shared"))
    # members of one id only come first in the order and meet nobody; of the first ones, what is left are shared ones
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    first = sets.select("id", "n", "component").join(stage(shared, "crowd_shared").hint("merge"), "id").where(head > 0)
    keys = stage(first.select("id", "n", "component", (F.col("n") - F.size("shared")).alias("lone"), F.posexplode(F.slice("shared", F.lit(1), head.cast("int"))).alias("at", "x")).select("id", "n", "component", F.col("x.key").alias("key"), (F.col("lone") + F.col("at")).alias("place")), "crowd_keys")
    unstage(sets, often)
    mixed = stage(keys.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"), "crowd_mixed")
    return _pairs(keys.join(mixed.hint("merge"), "key"), percent, places=True).select("a", "b").distinct()


def _check(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs that are similar; of sets, those of their ids are moved only."""
    ids = stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    with arrow_rows(pairs.sparkSession, 500):
        links = stage(verified(pairs, only(sets, ids) if few else sets, percent), label)
    unstage(ids, pairs)
    release(pairs.sparkSession)
    return links
