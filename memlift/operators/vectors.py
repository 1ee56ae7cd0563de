"""Nearest vectors by an index of cells, exactly: a bound says which cells a question must still look at.

Items are dealt to the cell of their nearest centre. A cell knows its radius, the largest angle between its centre and an item. By
the triangle inequality of angles no item of a cell is nearer to a question than the angle to its centre less the radius. So a
question looks at its few nearest cells first, which gives it k items, and then only at those cells whose bound
isn't beyond the k-th of these. Results are those of comparing all with all; how many cells are left depends on how the
vectors cluster, and the worst case is every cell, in blocks.

Questions and items of a cell meet in blocks of bounded size: a cell that holds a third of all items is cut into parts by a hash,
and each part is compared with a part of the questions by one product of matrices inside a task. No pair is a row; a block
gives its k best a question. The centres (at most CENTRES, picked by hash) are all that is sent to tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlift.operators.graph import cut, drop
from memlift.operators.windows import top_k
from memlift.shipping import ship

CENTRES, FIRST_CELLS = 512, 4
#: Items and questions of one block.
BLOCK_ITEMS, BLOCK_QUESTIONS = 4096, 2048
#: Rows that a task's Python holds at once: questions scored against a block, and rows that go to cells.
SCORED, SENT_ROWS = 128, 8192
#: Scores count to so many places, and angles are compared with room for that.
PLACES = 6


def _unit(df: DataFrame, key: str, vec: str) -> DataFrame:
    """key, v of the vectors that have a direction: not null, finite, not zero, without null components."""
    v = F.col(vec).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias(key), v.alias("v")).where(sound & F.col(key).isNotNull())
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / most))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("v", F.transform("v", lambda x: x / norm))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _block_best(k: int):
    """The k best items of each question of a block, and ties at the k-th."""

    def run(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(items) or not len(asked):
            return pd.DataFrame({"q_id": [], "item_id": [], "score": []})
        items = items.sort_values("item_id", kind="stable")
        ids, at = items["item_id"].to_numpy(), _matrix(items["v"]).T
        out = []
        for first in range(0, len(asked), SCORED):
            some = asked.iloc[first : first + SCORED]
            score = np.round(_matrix(some["v"]) @ at, PLACES) + 0.0
            score[some["q_id"].to_numpy()[:, None] == ids[None, :]] = -9
            for q, row in zip(some["q_id"], score):
                best = np.argsort(-row, kind="stable")[:k]
                out += [(q, ids[i], row[i]) for i in best if row[i] > -9]
        return pd.DataFrame(out, columns=["q_id", "item_id", "score"])

    return run


def _compared(items: DataFrame, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """q_id, item_id, score from the cells that each question (q_id, v, cell) looks at."""
    run = _block_best(k)
    parts = cells.select("cell", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int").alias("parts"))
    turns = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUESTIONS).cast("int").alias("turns"))
    shape = cut(parts.join(turns.hint("merge"), "cell"))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row a cell that is looked at: at most CENTRES
    left = items.join(shape.hint("broadcast"), "cell").select("cell", place("item_id", "parts").alias("part"), whole("turns").alias("turn"), "item_id", "v")
    right = asked.join(shape.hint("broadcast"), "cell").select("cell", whole("parts").alias("part"), place("q_id", "turns").alias("turn"), "q_id", "v")
    key = ("cell", "part", "turn")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda x, y: run(x, y), "q_id long, item_id long, score double")


def nearest(items: DataFrame, questions: DataFrame, k: int, vec: str = "v") -> DataFrame:
    """(q_id, item_id, score, rank): the k items of greatest cosine of each question, not itself by id; ties to the smaller id.

    items: item_id and a vector, questions: q_id and a vector, all of one length. Vectors without a direction (null, zero,
    with null or non-finite components) are neither found nor answered. Ids are unique."""
    spark = items.sparkSession
    ship(spark)
    own, asked = cut(_unit(items, "item_id", vec)), cut(_unit(questions, "q_id", vec))
    picked = own.orderBy(F.xxhash64("item_id"), "item_id").limit(int(min(CENTRES, max(1, own.count() ** 0.5)))).collect()
    if not picked:
        return spark.createDataFrame([], "q_id long, item_id long, score double, rank int")
    centres = np.array([r.v for r in picked])

    def deal(batches):
        for part in batches:
            far = _angles(_matrix(part["v"]), centres) if len(part) else np.zeros((0, 1))
            yield part.assign(cell=far.argmin(1).astype(np.int32), far=far.min(1))

    filed = cut(own.mapInPandas(deal, "item_id long, v array<double>, cell int, far double"))
    cells = cut(filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")))
    radius = {r.cell: r.radius for r in cells.collect()}  # at most CENTRES
    live = np.array(sorted(radius))
    reach = np.array([radius[c] for c in live])

    def first_cells(x: np.ndarray) -> np.ndarray:
        return np.argsort(_angles(x, centres[live]), axis=1, kind="stable")[:, :FIRST_CELLS]

    def look(batches):
        for part in batches:
            if len(part):
                near = live[first_cells(_matrix(part["v"]))]
                yield part.loc[part.index.repeat(near.shape[1])].assign(cell=near.ravel().astype(np.int32))

    def look_further(batches):
        for part in batches:
            if len(part):
                x = _matrix(part["v"])
                bound = _angles(x, centres[live]) - reach
                worst = np.where(part["found"] < k, np.pi, np.arccos(np.clip(part["least"].fillna(-1.0) - 2 * 10.0**-PLACES, -1.0, 1.0)))
                need = bound <= worst.reshape(-1, 1) + 1e-7
                np.put_along_axis(need, first_cells(x), False, axis=1)
                row, at = np.nonzero(need)
                # a question may need every cell: its vector isn't repeated for a whole batch at once
                for first in range(0, len(row), SENT_ROWS):
                    some = slice(first, first + SENT_ROWS)
                    yield part[["q_id", "v"]].iloc[row[some]].assign(cell=live[at[some]].astype(np.int32))

    looked = "q_id long, v array<double>, cell int"
    order = [F.desc("score"), F.asc("item_id")]
    some = cut(top_k(_compared(filed, cut(asked.mapInPandas(look, looked)), cells, k), "q_id", order, k))
    edge = some.groupBy("q_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    open_ = asked.hint("merge").join(edge.hint("merge"), "q_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    more = _compared(filed, cut(open_.mapInPandas(look_further, looked)), cells, k)
    out = cut(top_k(some.select("q_id", "item_id", "score").unionByName(more), "q_id", order, k))
    drop(own, asked, filed, cells, some)
    return out
