"""Graph and integrity work over edge tables, as rounds of joins. Each round is written to the checkpoint folder, so plans
stay short and a lost executor costs one round. Rounds stop on counts; no rows come to the driver. Graphs of bounded size are
solved inside tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.shipping import ship


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read back: plans of rounds stay short, with true sizes.
    Where that is unset, a folder of our own, in local mode only."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or f"file://{tempfile.mkdtemp(prefix='memlift-')}")
    path = f"{sc.getCheckpointDir().rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes what cut() wrote for frames that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("cut-"):
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def cyclic_graphs(edges: DataFrame) -> DataFrame:
    """The graphs g of (g, src, dst) that hold a cycle: what is left when nodes without a way in or a way out are taken off
    again and again. In each round inner nodes of ways without branches are jumped over too, so a long chain takes
    about as many rounds as its length has digits; every round but the last takes edges off, so rounds end."""
    e = cut(edges.select("g", "src", "dst").distinct())
    n = e.count()
    while n:
        into, out = e.select("g", F.col("dst").alias("src")).distinct(), e.select("g", F.col("src").alias("dst")).distinct()
        trimmed = cut(e.join(into, ["g", "src"], "left_semi").join(out, ["g", "dst"], "left_semi").select("g", "src", "dst"))
        old, e = e, cut(_jumped(trimmed))
        drop(old, trimmed)
        left = e.count()
        if left == n:
            break
        n = left
    return e.select("g").distinct()


def _jumped(e: DataFrame) -> DataFrame:
    """Edges of which every second inner node is left out: nodes with one way in and one out, picked by the hash of their
    number so that no two neighbours go at once. A node's own loop stays."""
    one_in = e.groupBy("g", F.col("dst").alias("node")).agg(F.count("*").alias("c"), F.min("src").alias("from_")).where("c = 1").drop("c")
    one_out = e.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("c"), F.min("dst").alias("to_")).where("c = 1").drop("c")
    inner = one_in.join(one_out, ["g", "node"]).where("from_ <> node")
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    # the largest by hash among itself and both its neighbours
    inner = (inner.where((rank("node") > rank("from_")) & (rank("node") > rank("to_"))))
    rest = e.join(inner.select("g", F.col("node").alias("src")), ["g", "src"], "left_anti").join(inner.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")
    return rest.select("g", "src", "dst").unionByName(inner.select("g", F.col("from_").alias("src"), F.col("to_").alias("dst"))).distinct()


#: A graph of at most so many edges is solved whole inside one task (a few MB); larger ones go through rounds of joins.
WHOLE = 50_000


def _frontiers(node_of: np.ndarray, src: np.ndarray, dst: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Longest way to each of len(node_of) nodes from their start levels, by taking off nodes without a way in; -1 on or behind a
    cycle."""
    n = len(node_of)
    order = np.argsort(src, kind="stable")
    out, at = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    waits = np.bincount(dst, minlength=n)
    level = start.astype(np.int64).copy()
    done = np.zeros(n, bool)
    front = np.flatnonzero(waits == 0)
    while len(front):
        done[front] = True
        size = at[front + 1] - at[front]
        own = np.repeat(front, size)
        to = out[np.repeat(at[front + 1] - np.cumsum(size), size) + np.arange(size.sum())] if len(own) else own
        np.maximum.at(level, to, level[own] + 1)
        np.subtract.at(waits, to, 1)
        to = np.unique(to)
        front = to[waits[to] == 0]
    level[~done] = -1
    return level


def _indexed(part: pd.DataFrame) -> tuple[pd.MultiIndex, np.ndarray, np.ndarray]:
    """The nodes of edges (g, src, dst), and both ends of each edge by their place among them."""
    ends = pd.concat([part[["g", "src"]].rename(columns={"src": "node"}), part[["g", "dst"]].rename(columns={"dst": "node"})])
    code, nodes = pd.MultiIndex.from_frame(ends).factorize()
    return nodes, code[: len(part)], code[len(part) :]


def _by_size(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the graphs that a task can hold, with `bin_` for about a task's worth of them, and edges of the others."""
    sizes = cut(e.groupBy("g").agg(F.count("*").alias("size_")))
    total = sizes.where(F.col("size_") <= WHOLE).agg(F.sum("size_")).first()[0] or 0
    e = e.hint("merge").join(sizes.hint("merge"), "g")
    small = e.where(F.col("size_") <= WHOLE).withColumn("bin_", F.pmod(F.xxhash64("g"), F.lit(total // WHOLE + 1)))
    return small.drop("size_"), e.where(F.col("size_") > WHOLE).drop("size_")


def closing_edges(edges: DataFrame) -> DataFrame:
    """(g, closing): for each graph with a cycle the number (column seq) of the edge that made its first one. Graphs that a task
    can hold are searched there; for larger ones the range of numbers is halved, for all of them at once: edges up to a number
    hold a cycle or don't."""
    e = cut(edges.select("g", "src", "dst", "seq").where("src is not null and dst is not null"))
    small, large = _by_size(e)

    def search(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, own in part.sort_values("seq").groupby("g"):
            seqs = own["seq"].to_numpy()

            def cyclic(upto: int) -> bool:
                nodes, src, dst = _indexed(own[:upto])
                return bool((_frontiers(nodes, src, dst, np.zeros(len(nodes))) < 0).any())

            if cyclic(len(own)):
                lo, hi = 1, len(own)
                while lo < hi:
                    lo, hi = (lo, (lo + hi) // 2) if cyclic((lo + hi) // 2) else ((lo + hi) // 2 + 1, hi)
                out.append((g, seqs[lo - 1]))
        return pd.DataFrame(out, columns=["g", "closing"])

    ship(edges.sparkSession)
    kind = dict(e.dtypes)
    found = small.groupBy("bin_").applyInPandas(lambda part: search(part), f"g {kind['g']}, closing {kind['seq']}")
    large = cut(large)
    if not large.limit(1).count():
        return found
    span = cut(large.join(cyclic_graphs(large), "g", "left_semi").groupBy("g").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")))
    while span.where("lo < hi").limit(1).count():
        span = span.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
        part = large.join(span, "g").where("seq <= mid and lo < hi")
        yes = cyclic_graphs(part).withColumn("yes", F.lit(True))
        span = cut(span.join(yes, "g", "left").select("g", F.when(F.col("yes") | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(F.col("yes"), F.col("mid")).otherwise(F.col("hi")).alias("hi")))
    return found.unionByName(span.select("g", F.col("hi").cast(kind["seq"]).alias("closing")))


def levels(edges: DataFrame) -> DataFrame:
    """(g, node, level) of a graph without cycles: the longest way to a node, in steps.

    Graphs that a task can hold are solved there, many in a task. Larger ones go in rounds over blocks of nodes: nodes are dealt into
    blocks by range of their level so far, each block settles what its own edges say in one task, and edges between
    blocks then lift the levels for the next round. So a round is a step between blocks, not a level. A cycle is an error that
    names a graph."""
    ship(edges.sparkSession)
    e = cut(edges.select("g", "src", "dst").where("src is not null and dst is not null").distinct())
    small, large = _by_size(e)
    kind = dict(e.dtypes)
    schema = f"g {kind['g']}, node {kind['src']}, level int"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        nodes, src, dst = _indexed(part)
        return nodes.to_frame(index=False).set_axis(["g", "node"], axis=1).assign(level=_frontiers(nodes, src, dst, np.zeros(len(nodes))))

    found = cut(small.groupBy("bin_").applyInPandas(lambda part: solve(part), schema))
    _no_cycle(found)
    large = cut(large)
    return found.unionByName(_levels_by_blocks(large, schema)) if large.limit(1).count() else found


def _no_cycle(found: DataFrame) -> None:
    bad = found.where("level < 0").first()
    if bad:
        raise ValueError(f"graph {bad['g']} has a cycle")


def _levels_by_blocks(e: DataFrame, schema: str) -> DataFrame:
    lev = cut(e.select("g", F.col("src").alias("node")).unionByName(e.select("g", F.col("dst").alias("node"))).distinct().withColumn("level", F.lit(0)))
    n = lev.count()
    most = lev.groupBy("g").count().agg(F.max("count")).first()[0]

    def settle(nodes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        place = pd.MultiIndex.from_frame(nodes[["g", "node"]])
        src, dst = (place.get_indexer(pd.MultiIndex.from_frame(own[["g", c]])) for c in ("src", "dst"))
        return nodes[["g", "node"]].assign(level=_frontiers(place, src, dst, nodes["level"].to_numpy()))

    while True:
        nodes = cut(lev.repartitionByRange(max(1, n // WHOLE), "g", "level", "node").withColumn("block", F.spark_partition_id()))
        at = lambda c, b: nodes.select("g", F.col("node").alias(c), F.col("block").alias(b)).hint("merge")
        placed = cut(e.join(at("src", "a"), ["g", "src"]).join(at("dst", "b"), ["g", "dst"]).select("g", "src", "dst", "a", "b"))
        inner = placed.where("a = b").select("g", "src", "dst", F.col("a").alias("block"))
        settled = cut(nodes.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(lambda x, y: settle(x, y), schema))
        _no_cycle(settled)
        between = placed.where("a <> b").join(settled.withColumnRenamed("node", "src").hint("merge"), ["g", "src"])
        lift = between.groupBy("g", F.col("dst").alias("node")).agg((F.max("level") + 1).alias("up"))
        lev = cut(settled.join(lift.hint("merge"), ["g", "node"], "left").select("g", "node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.col("up") > F.col("level")).alias("moved")))
        moved, high = lev.agg(F.bool_or("moved"), F.max("level")).first()
        if not moved:
            return lev.drop("moved")
        if high > most:
            raise ValueError(f"graph {lev.where(F.col('level') == high).first()['g']} has a cycle")
        drop(nodes, placed, settled)
        lev = lev.drop("moved")


def _tarjan(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The number of each node's strongly connected component, without recursion."""
    order = np.argsort(src, kind="stable")
    out, at = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, of, path, count = [-1] * n, [0] * n, [-1] * n, [], 0
    for start in range(n):
        if index[start] >= 0:
            continue
        todo = [(start, at[start])]
        index[start] = low[start] = count
        count += 1
        path.append(start)
        while todo:
            node, i = todo.pop()
            if i < at[node + 1]:
                todo.append((node, i + 1))
                to = out[i]
                if index[to] < 0:
                    index[to] = low[to] = count
                    count += 1
                    path.append(to)
                    todo.append((to, at[to]))
                elif of[to] < 0:
                    low[node] = min(low[node], index[to])
                continue
            if low[node] == index[node]:
                while True:
                    member = path.pop()
                    of[member] = node
                    if member == node:
                        break
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
    return np.array(of, np.int64)


def strong_components(edges: DataFrame) -> DataFrame:
    """(g, node, component): the nodes that lie on a cycle of (g, src, dst), with the smallest node of their strongly connected
    component. Graphs that a task can hold are solved there; in larger ones colours (the smallest node that reaches a node) are
    spread forward, a component is what its colour's node is reached from inside the colour, and the rest goes on."""
    ship(edges.sparkSession)
    e = cut(edges.select("g", "src", "dst").where("src is not null and dst is not null").distinct())
    small, large = _by_size(e)
    kind = dict(e.dtypes)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        nodes, src, dst = _indexed(part)
        out = nodes.to_frame(index=False).set_axis(["g", "node"], axis=1).assign(of=_tarjan(src, dst, len(nodes)))
        out["component"] = out.groupby("of")["node"].transform("min")
        loops = np.zeros(len(nodes), bool)
        loops[src[src == dst]] = True
        return out[(out.groupby("of")["of"].transform("size") > 1) | loops][["g", "node", "component"]]

    found = cut(small.groupBy("bin_").applyInPandas(lambda part: solve(part), f"g {kind['g']}, node {kind['src']}, component {kind['src']}"))
    e = cut(large)
    while e.limit(1).count():
        colour = cut(e.select("g", F.col("src").alias("node")).unionByName(e.select("g", F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        colour = _spread(colour, e, "src", "dst", F.least)
        inside = e.join(colour.select("g", F.col("node").alias("src"), F.col("colour").alias("a")), ["g", "src"]).join(colour.select("g", F.col("node").alias("dst"), F.col("colour").alias("b")), ["g", "dst"]).where("a = b").select("g", "src", "dst")
        reached = cut(colour.withColumn("colour", (F.col("node") == F.col("colour")).cast("int")))
        reached = _spread(reached, cut(inside), "dst", "src", F.greatest)
        own = cut(colour.join(reached.where("colour = 1").select("g", "node"), ["g", "node"]))
        looped = inside.where("src = dst").select("g", F.col("src").alias("node"), F.lit(True).alias("own")).distinct()
        size = own.groupBy("g", "colour").agg(F.count("*").alias("size_"))
        found = found.unionByName(own.join(size, ["g", "colour"]).join(looped, ["g", "node"], "left").where("size_ > 1 or own").select("g", "node", F.col("colour").alias("component")))
        gone = lambda c: own.select("g", F.col("node").alias(c))
        e = cut(e.join(gone("src"), ["g", "src"], "left_anti").join(gone("dst"), ["g", "dst"], "left_anti").select("g", "src", "dst"))
    return found


def _spread(values: DataFrame, e: DataFrame, start: str, end: str, better) -> DataFrame:
    """values (g, node, colour) after each node has taken the better of its own and its neighbours', until none changes. Only nodes
    that changed speak in the next round."""
    pick = F.min if better is F.least else F.max
    fresh = values
    while True:
        said = e.join(fresh.select("g", F.col("node").alias(start), F.col("colour").alias("said")), ["g", start]).groupBy("g", F.col(end).alias("node")).agg(pick("said").alias("said"))
        after = cut(values.join(said, ["g", "node"], "left").select("g", "node", better("colour", F.coalesce("said", "colour")).alias("colour"), (better("colour", F.coalesce("said", "colour")) != F.col("colour")).alias("moved")))
        values, fresh = after.drop("moved"), after.where("moved").drop("moved")
        if not fresh.limit(1).count():
            return values


def heads(edges: DataFrame, with_hops: bool = False) -> DataFrame:
    """(id, head): where each chain of src superseded by dst ends, with the number of links where asked for; each round
    doubles the way."""
    j = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("head"), F.lit(1).cast("long").alias("hops")))
    n, old = j.count(), [j]
    for _ in range(max(1, n).bit_length() + 1):
        step = j.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("hops").alias("more"))
        nxt = cut(j.join(step, "head", "left").select("id", "head", "further", "hops", "more"))
        moved = nxt.where("further is not null").limit(1).count()
        drop(*old)
        old = [nxt]
        j = nxt.select("id", F.coalesce("further", "head").alias("head"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        if not moved:
            return j if with_hops else j.drop("hops")
    raise ValueError(f"the chain of {nxt.where('further is not null').first()['id']} has a cycle")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def leaf_hash(row: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), row.cast("binary")), 256)


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels (idx, hash) from the leaves to the root. A node without a partner moves up as it is."""
    level = cut(leaves.select("idx", leaf_hash(F.col("body")).alias("hash")))
    out, n = [level], level.count()
    while n > 1:
        pair = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        up = level.groupBy(F.floor(F.col("idx") / 2).cast("long").alias("idx")).agg(pair.alias("p"))
        joined = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.col("p")[0]["hash"]), F.unhex(F.get(F.col("p"), 1)["hash"])), 256)
        level = cut(up.select("idx", F.when(F.size("p") == 2, joined).otherwise(F.col("p")[0]["hash"]).alias("hash")))
        out.append(level)
        n = (n + 1) // 2
    return out


def inclusion(levels_: list[DataFrame]) -> DataFrame:
    """Each leaf with whether its path of siblings leads to the root: idx, verified, steps."""
    root = levels_[-1].select(F.col("hash").alias("root"))
    p = levels_[0].select("idx", F.col("idx").alias("at"), "hash", F.lit(0).alias("steps"))
    for level in levels_[:-1]:
        sib = level.select(F.col("idx").alias("sib_at"), F.col("hash").alias("sib"))
        p = p.join(sib, F.col("at").bitwiseXOR(F.lit(1)) == F.col("sib_at"), "left")
        left, right = F.when(F.col("at") % 2 == 0, F.col("hash")).otherwise(F.col("sib")), F.when(F.col("at") % 2 == 0, F.col("sib")).otherwise(F.col("hash"))
        up = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)
        p = p.select("idx", F.floor(F.col("at") / 2).cast("long").alias("at"), F.when(F.col("sib").isNull(), F.col("hash")).otherwise(up).alias("hash"), (F.col("steps") + F.col("sib").isNotNull().cast("int")).alias("steps"))
    return p.crossJoin(F.broadcast(root)).select("idx", (F.col("hash") == F.col("root")).alias("verified"), "steps")  # one row


def consistent_prefix(leaves: DataFrame, stored: DataFrame, root_of: str = "root", size: str = "rows_before") -> DataFrame:
    """Whether the first rows (idx below the stored size) still have the stored root: size, consistent, rows_after. stored has
    one row, written when it was taken."""
    before = stored.first()
    m = int(before[size])
    again = merkle_levels(leaves.where(F.col("idx") < m))[-1].select(F.col("hash").alias("again"))
    return again.select(F.lit(m).cast("long").alias(size), (F.col("again") == F.lit(before[root_of])).alias("consistent")).crossJoin(F.broadcast(leaves.agg(F.count("*").alias("rows_after"))))  # one row each


def tag_edges(items: DataFrame, key: str, entity: str, order: str, most: int = 5) -> DataFrame:
    """Edges between items that follow each other under an entity, at most `most` an entity: kind, src, dst."""
    w = W.partitionBy(entity).orderBy(order)
    rows = items.select(entity, key, order).distinct().withColumn("n_", F.row_number().over(w)).withColumn("src", F.lag(key).over(w)).where((F.col("n_") > 1) & (F.col("n_") <= most + 1))
    return rows.where(F.col("src") != F.col(key)).select(F.lit("chain").alias("kind"), "src", F.col(key).alias("dst")).dropDuplicates(["kind", "src", "dst"])


def group_edges(items: DataFrame, key: str, group: str, order: str, source: Column, target: Column, most: int, kind: str) -> DataFrame:
    """Edges from all items of one kind of a topic group to the first `most` of another kind: kind, src, dst, none to itself."""
    first = items.where(target).select(group, F.col(key).alias("dst"), F.row_number().over(W.partitionBy(group).orderBy(order)).alias("n_")).where(F.col("n_") <= most)
    e = items.where(source).select(group, F.col(key).alias("src")).join(first, group).where("src <> dst")
    return e.select(F.lit(kind).alias("kind"), "src", "dst").dropDuplicates(["kind", "src", "dst"])
