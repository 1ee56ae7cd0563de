"""Near-duplicate embeddings by spherical caps: vectors that share a filter direction are compared.

Filter directions form a product code: the space is turned by a random rotation and cut into four blocks, each block has a
small random code of unit vectors, and a direction is one code word from each block. A vector is in the cap of a direction
when their inner product passes a threshold. List decoding finds all those directions for a vector from the sums of pairs of
blocks, without trying all of them. Two vectors at cosine 0.98 share most of their caps; unlike ones hardly any. Vectors are
joined on (label, direction), candidates are counted once and verified by cosine in double precision.

The code grows with the number of vectors (directions in proportion to it) and the threshold keeps about CAPS caps a
vector, so candidates grow in proportion to the vectors. At the threshold that N vectors need, a vector at cosine 0.98 is in
more than half of another's caps for any N up to 10^9 and beyond, so 24 caps rarely miss; vectors in fewer than MIN_CAPS caps
get theirs at a lower threshold. README has the recall that was measured.

Equal vectors with a label collapse into one class before the join, so a vector that a third of all rows repeat costs one
row; links count its copies. Vectors that are null, zero, or hold null or non-finite components link with nothing, neither
do those with a null label or of another length. Null and repeated ids: rows are kept one for one, and rows with one id and
vector count as copies; rows with one id and other vectors are other vectors, each with its own links and component. Extra columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import release, sized, stage, unstage
from memlift.llm.components import components
from memlift.shipping import ship

COSINE = 0.98
CAPS, MIN_CAPS = 24, 10
BLOCKS = 4
#: Sums of halves that are held to set the threshold.
PROBE_SUMS = 600_000


class ProductCode:
    """Random rotation, and BLOCKS codes of `words` unit vectors each."""

    def __init__(self, dim: int, n: int, seed: int = 11):
        rng = np.random.default_rng(seed + dim)
        self.dim, self.width = dim, max(4, -(-dim // BLOCKS))  # short vectors are turned into a longer space
        # directions in proportion to the vectors: words ** 4 is about 4 * n
        self.words = int(max(6, round((4 * max(n, 1)) ** 0.25)))
        q, _ = np.linalg.qr(rng.standard_normal((self.width * BLOCKS,) * 2))
        self.turn = q[:dim]
        code = rng.standard_normal((BLOCKS, self.words, self.width))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(BLOCKS)
        probe = rng.standard_normal((max(8, min(200, PROBE_SUMS // self.words**2)), dim))
        self.threshold = self._threshold(probe / np.linalg.norm(probe, axis=1, keepdims=True))

    def _threshold(self, probe: np.ndarray) -> float:
        """Where the probes are in CAPS caps on average. The caps are counted from sorted sums of halves, never made."""
        halves = [(np.sort(low), np.sort(high)) for low, high in map(self._halves, self._inner(probe))]
        target, lo, hi = min(CAPS, self.words**BLOCKS // 2) * len(halves), -2.0, 2.0
        for _ in range(30):
            mid = (lo + hi) / 2
            n = sum(int((len(high) - np.searchsorted(high, mid - low)).sum()) for low, high in halves)
            lo, hi = (mid, hi) if n > target else (lo, mid)
        return hi

    def _inner(self, x: np.ndarray) -> np.ndarray:
        y = (x @ self.turn).reshape(len(x), BLOCKS, self.width)
        return np.einsum("nbw,bkw->nbk", y, self.code)

    def _halves(self, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (inner[0][:, None] + inner[1]).ravel(), (inner[2][:, None] + inner[3]).ravel()

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Numbers of all directions whose caps hold each row of x (unit vectors)."""
        out, k2 = [], self.words**2
        for inner in self._inner(x):
            low, high = self._halves(inner)
            most, t = (low.max(), high.max()), self.threshold
            while True:  # only halves that the other half's best can lift over the threshold
                rows, order = np.flatnonzero(low >= t - most[1]), np.flatnonzero(high >= t - most[0])
                order = order[np.argsort(-high[order])]
                n = np.searchsorted(-high[order], low[rows] - t, side="right")
                if n.sum() >= MIN_CAPS or t < -4:
                    break
                t -= 0.02
            first = np.repeat(rows, n)
            second = order[np.concatenate([np.arange(c) for c in n])] if len(n) else np.empty(0, np.int64)
            out.append((first * k2 + second).astype(np.int64))
        return out


@lru_cache(64)
def code_of(dim: int, n: int) -> ProductCode:
    """The code for vectors of one length, kept by a Python worker."""
    return ProductCode(dim, n)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row a vector: its id, n_links, class_id (smallest id of its copies), component_id and kept."""
    spark = vectors.sparkSession
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"), vectors[label_col].alias("label"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are one value
    v = v.withColumn("sound", sound).withColumn("v", F.when(F.col("sound"), F.transform("v", lambda x: x + F.lit(0.0))))
    v = stage(v, "vectors")
    whole = v.where("sound")
    kept = whole.groupBy("label", "v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    # a class is known by a number of its own, written once: ids may repeat with other vectors
    kept = stage(kept.withColumn("class", F.monotonically_increasing_id()), "classes")
    n = kept.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    target = pa.schema([("key", pa.int64()), ("dim", pa.int32()), ("label", pa.string()), ("id", pa.int64())])

    def caps(batches):
        for batch in batches:
            values, at = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            keys, dim, lab, own = [], [], [], []
            for i in range(batch.num_rows):
                x = values[at[i] : at[i + 1]]
                x = x / np.abs(x).max()
                (hit,) = code_of(len(x), n).decode((x / np.linalg.norm(x))[None, :])
                keys.append(hit)
                dim += [len(x)] * len(hit)
                lab += [labels[i]] * len(hit)
                own += [ids[i]] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), pa.array(dim, pa.int32()), pa.array(lab, pa.string()), pa.array(own, pa.int64())], schema=target)

    ship(spark)
    classes = kept.select(F.col("class").alias("id"), "v", F.col("label").cast("string").alias("label"))
    filed = stage(classes.mapInArrow(caps, "key long, dim int, label string, id long"), "caps")
    a, b = filed.withColumnRenamed("id", "a"), filed.withColumnRenamed("id", "b")
    pairs = stage(a.hint("merge").join(b, ["key", "dim", "label"]).where("a < b").select("a", "b").distinct(), "pairs")
    links = stage(_verified(pairs, classes, cosine), "links")
    unstage(filed, pairs)
    release(spark)
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    size = kept.select("class", "copies", "first_id")
    out = both.join(size.select(F.col("class").alias("y"), "copies").hint("merge"), "y").groupBy(F.col("x").alias("class")).agg(F.sum("copies").alias("others"))
    group = size.join(stage(out, "others").hint("merge"), "class", "left").join(components(links).withColumnRenamed("id", "class").hint("merge"), "class", "left")
    group = stage(group.select("class", "first_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")), "groups")
    least = stage(group.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    group = stage(group.join(sized(least), "component"), "named")
    own = v.join(kept.select(F.col("label").alias("label_"), F.col("v").alias("v_"), "class").hint("merge"), (F.col("label") == F.col("label_")) & (F.col("v") == F.col("v_")), "left").select("id", "class")
    own = own.join(group.hint("merge"), "class", "left")
    return own.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Pairs whose cosine in double precision is at least `cosine`."""
    x = vectors.select("id", "v")
    both = pairs.join(x.select(F.col("id").alias("a"), F.col("v").alias("va")).hint("merge"), "a").join(x.select(F.col("id").alias("b"), F.col("v").alias("vb")).hint("merge"), "b").select("a", "b", "va", "vb")
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            va, vb = batch.column(2), batch.column(3)
            oa = va.offsets.to_numpy()
            ma, mb = va.values.to_numpy()[oa[0] : oa[n]], vb.values.to_numpy()[vb.offsets.to_numpy()[0] : vb.offsets.to_numpy()[n]]
            sizes = np.diff(oa)
            if (sizes == sizes[0]).all():
                ma, mb = ma.reshape(n, -1), mb.reshape(n, -1)
                ma, mb = ma / np.abs(ma).max(1, keepdims=True), mb / np.abs(mb).max(1, keepdims=True)
                cos = np.einsum("ij,ij->i", ma, mb) / np.sqrt(np.einsum("ij,ij->i", ma, ma) * np.einsum("ij,ij->i", mb, mb))
            else:
                cuts = np.cumsum(sizes)[:-1]
                unit = lambda x: x / np.abs(x).max()
                cos = np.array([float(np.dot(unit(p), unit(q)) / np.sqrt(np.dot(unit(p), unit(p)) * np.dot(unit(q), unit(q)))) for p, q in zip(np.split(ma, cuts), np.split(mb, cuts))])
            mask = pa.array(cos >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=target)

    ship(pairs.sparkSession)
    return both.mapInArrow(run, "a long, b long")
