"""Product codes of vectors: exact integer k-means over Hilbert-sorted blocks with boxes.

A component x becomes floor(1024 * x), a vector is cut into PARTS equal consecutive parts, and each part position has a codebook
of up to ENTRIES entries, which begins as that part of the vectors with the smallest ids. Each round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the floor of its parts' mean.

Parts of a position are put in the order of a Hilbert curve once, by a range shuffle, and cut into flat blocks of at most BLOCK
parts. A block is one row: its parts as one run of integers, the smallest and largest value of each component (its box), and its
sums. A round reads the blocks. The least and greatest distance of an entry to a box say which entries can be nearest for some
part in it: those no farther at least than the best is at most. If one entry is left, the block goes to it by its stored sums.
Else a small exact integer kernel compares the block's parts with the entries left. A task adds up its blocks before anything
is shuffled, so a round moves ENTRIES x components sums a task, and the codebooks are all that the driver sees. The order and the
boxes save work only; results are those of comparing every part with every entry.

Equal parts lie side by side in blocks without extent, and the range shuffle orders by row too, so a vector that a third of all
rows repeat is dealt out like others and costs one comparison of boxes a block.

Vectors that are null, or hold null or non-finite components, have no row in the result. Vectors of each length are coded by
themselves, with codebooks of their own; to a length that PARTS doesn't divide, zeros are appended. An empty vector has zero
error and the codes of entry 0. With fewer than ENTRIES vectors the codebooks have as many entries. Components beyond
±LIMIT / 1024 count as that, since squared distances must fit into a long. Null ids come after all others, equal ids in order of
their vectors; repeated rows are coded one by one. label_error is null where its sum doesn't fit into a long. Further columns
don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import arrow_rows, arrow_schema, sized, stage, unstage
from memlift.shipping import ship

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts in a block, and bits of a component in its place on the curve.
BLOCK, BITS = 256, 4
#: Largest size of an integer component: squared distances of 2,000 components fit into a long.
LIMIT = 1 << 25
#: Blocks in an Arrow batch.
BLOCK_ROWS = 64


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve as bytes, most significant first, for rows of integers from 0 to 2 ** bits - 1."""
    x = np.ascontiguousarray(x.T).astype(np.int64)
    if not len(x):
        return np.zeros((x.shape[1], 0), np.uint8)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):  # where the bit is set turn the first axis round, else swap it with this one
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that can be nearest to something in the box. Entries at equal distance stay."""
    gap = np.maximum(np.maximum(low - book, book - high), 0)
    reach = np.maximum(np.abs(book - low), np.abs(book - high))
    return np.flatnonzero((gap * gap).sum(1) <= (reach * reach).sum(1).min())


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lowest at equal distance) and its squared distance, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # all sums are whole numbers that doubles hold exactly
        x, book = x.astype(np.float64), book.astype(np.float64)
    far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best].astype(np.int64)


def _integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """rid (a number a row), id, label, v of the vectors that are kept."""
    whole = F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    value = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    pad = F.pmod(-F.size("v"), F.lit(PARTS))
    v = vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(vec_col, value).alias("v"))
    return v.select(F.monotonically_increasing_id().alias("rid"), "id", "label", F.concat("v", F.array_repeat(F.lit(0), pad)).alias("v"), F.size("v").alias("dim"))


def _smallest(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the n smallest ids. Ids are narrowed down by counts of bins first, so that no task sorts many rows."""
    while True:
        lo, hi, total = rows.agg(F.min("id"), F.max("id"), F.count("id")).first()
        if total <= 4 * n or lo == hi:
            break
        width = (hi - lo) // 1024 + 1
        seen = 0
        for at, c in sorted(rows.where("id is not null").groupBy(F.expr(f"(id - {lo}) div {width}").alias("at")).count().collect()):
            seen += c
            if seen >= n:
                break
        if at == (hi - lo) // width:  # the last bin is needed: no row can go by its id
            break
        rows = rows.where(F.col("id") < lo + (at + 1) * width)
    return [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(n).collect()]


def _spread(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and standard deviation of each component by length of the vectors. They set the steps of the curve."""
    ship(rows.sparkSession)
    schema = "dim int, at int, n long, s double, ss double"
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches):
        total: dict = defaultdict(lambda: 0.0)
        for batch in batches:
            for dim, x, _ in _matrices(batch, "dim", "v"):
                total[dim] = total[dim] + np.stack([np.full(x.shape[1], float(len(x))), x.sum(0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(0)])
        for dim, t in total.items():
            k = t.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, dim, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(t[0].astype(np.int64)), pa.array(t[1]), pa.array(t[2])], schema=target)

    found = rows.select("dim", "v").mapInArrow(run, schema).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.dim, r.at)):
        mean = r.s / r.n
        by[r.dim].append((mean, max(1.0, (r.ss / r.n - mean * mean)) ** 0.5))
    return {dim: tuple(np.array(x).T) for dim, x in by.items()}


def _matrices(batch: pa.RecordBatch, dim_col: str, vec_col: str):
    """The vectors of a batch as one matrix for each length: the length, the matrix, the places of its rows."""
    at = batch.column(vec_col)
    flat, dims = at.flatten().to_numpy(), batch.column(dim_col).to_numpy()
    sizes = -(-dims // PARTS) * PARTS
    begin = np.cumsum(sizes) - sizes
    for dim in np.unique(dims):
        rows, size = np.flatnonzero(dims == dim), -(-int(dim) // PARTS) * PARTS
        yield int(dim), flat[begin[rows][:, None] + np.arange(size)], rows


def _sorted_parts(rows: DataFrame, spread: dict) -> DataFrame:
    """dim, part, rid, data of every part in the order of the curve, within partitions by range of it."""
    schema = "dim int, part int, key binary, rid long, data binary"
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for dim, x, at in _matrices(batch, "dim", "v"):
                mean, sd = spread.get(dim, (np.zeros(0), np.ones(0)))
                steps = np.clip(((x - mean) / sd + 2) * 2 ** (BITS - 2), 0, 2**BITS - 1).astype(np.int64)
                for part, (own, place) in enumerate(zip(np.split(x, PARTS, axis=1), np.split(steps, PARTS, axis=1))):
                    keys = hilbert_keys(place, BITS)
                    data = np.ascontiguousarray(own, dtype=np.int32)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(rids[at]), pa.array([d.tobytes() for d in data], pa.binary())], schema=target)

    order = ["dim", "part", "key", "rid"]
    return rows.select("rid", "dim", "v").mapInArrow(run, schema).repartitionByRange(*order).sortWithinPartitions(*order)


BLOCKS = "dim int, part int, n int, low binary, high binary, total binary, rids binary, data binary"


def _blocks(parts: DataFrame) -> DataFrame:
    """One row a block, cut from the parts as they come."""
    target = arrow_schema(parts.sparkSession, BLOCKS)

    def cut(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for dim, part, rids, data in rows:
            x = np.frombuffer(b"".join(data), np.int32).reshape(len(rids), -1)
            wide = x.astype(np.int64)
            out.append((dim, part, len(rids), wide.min(0).tobytes(), wide.max(0).tobytes(), wide.sum(0).tobytes(), np.array(rids, np.int64).tobytes(), x.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), target)], schema=target)

    def run(batches):
        key, rids, data = None, [], []
        for batch in batches:
            done = []
            for dim, part, rid, d in zip(*(batch.column(c).to_pylist() for c in ("dim", "part", "rid", "data"))):
                if (dim, part) != key or len(rids) == BLOCK:
                    if rids:
                        done.append((*key, rids, data))
                    key, rids, data = (dim, part), [], []
                rids.append(rid)
                data.append(d)
            if done:
                yield cut(done)
        if rids:
            yield cut([(*key, rids, data)])

    return parts.select("dim", "part", "rid", "data").mapInArrow(run, BLOCKS)


def _read(batch: pa.RecordBatch):
    for dim, part, n, low, high, total, rids, data in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
        yield dim, part, n, *(np.frombuffer(x, np.int64) for x in (low, high, total, rids)), np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)


def _moved(blocks: DataFrame, books: dict) -> dict:
    """The codebooks after one round."""
    schema = "dim int, part int, entry int, sums array<long>"
    target = arrow_schema(blocks.sparkSession, schema)

    def run(batches):
        total: dict = {}
        for batch in batches:
            for dim, part, n, low, high, sums, _, x in _read(batch):
                book = books[dim][part]
                own = total.setdefault((dim, part), np.zeros((len(book), book.shape[1] + 1), np.int64))
                few = shortlist(low, high, book)
                if len(few) == 1:
                    own[few[0], :-1] += sums
                    own[few[0], -1] += n
                else:
                    hit = few[nearest(x, book[few])[0]]
                    np.add.at(own, hit, np.column_stack([x, np.ones(n, np.int64)]))
        for (dim, part), own in total.items():
            used = np.flatnonzero(own[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), dim, np.int32)), pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(own[used].tolist(), pa.list_(pa.int64()))], schema=target)

    flat = blocks.mapInArrow(run, schema).select("dim", "part", "entry", F.posexplode("sums").alias("at", "x"))
    found: dict = defaultdict(dict)
    for r in flat.groupBy("dim", "part", "entry", "at").agg(F.sum("x").alias("x")).collect():
        found[r.dim, r.part, r.entry][r.at] = r.x
    new = {dim: [book.copy() for book in of] for dim, of in books.items()}
    for (dim, part, entry), at in found.items():
        width = len(at) - 1
        new[dim][part][entry] = [at[i] // at[width] for i in range(width)]
    return new


def _assigned(blocks: DataFrame, books: dict) -> DataFrame:
    """rid, part, entry, far of every part."""
    schema = "rid long, part int, entry int, far long"
    target = arrow_schema(blocks.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for dim, part, n, low, high, _, rids, x in _read(batch):
                book = books[dim][part]
                few = shortlist(low, high, book)
                best, far = nearest(x, book[few])
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.full(n, part, np.int32)), pa.array(few[best].astype(np.int32)), pa.array(far)], schema=target)

    return blocks.mapInArrow(run, schema)


def digest(of: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, with commas between them."""
    return hashlib.sha256(",".join(str(c) for book in of for entry in book.tolist() for c in entry).encode()).hexdigest()


def fit(vectors: DataFrame, blocks: DataFrame, rounds: int = ROUNDS) -> dict:
    """The codebooks by length: for each part a matrix of entries."""
    books = {}
    for (dim,) in sorted(vectors.select("dim").distinct().collect()):
        first = np.array(_smallest(vectors.where(F.col("dim") == dim), ENTRIES), np.int64)
        books[dim] = np.split(first.reshape(len(first), -1), PARTS, axis=1)
    for _ in range(rounds):
        with arrow_rows(blocks.sparkSession, BLOCK_ROWS):
            books = _moved(blocks, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a kept vector: its id, code, error, label_error and codebooks_sha256."""
    spark = vectors.sparkSession
    rows = stage(_integers(vectors, id_col, vec_col, label_col), "integers")
    ship(spark)
    blocks = stage(_blocks(_sorted_parts(rows, _spread(rows))), "blocks")
    books = fit(rows, blocks)
    with arrow_rows(spark, BLOCK_ROWS):
        parts = stage(_assigned(blocks, books), "assigned")
    unstage(blocks)
    hexes = F.concat(*(F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == p, F.col("entry")))), 2, "0")) for p in range(PARTS)))
    coded = parts.groupBy("rid").agg(hexes.alias("code"), F.sum("far").alias("error"))
    coded = stage(rows.select("rid", "id", "label", "dim").join(coded.hint("merge"), "rid").drop("rid"), "coded")
    unstage(parts, rows)
    labels = stage(coded.groupBy(F.col("label").alias("label_")).agg(F.try_sum("error").alias("label_error")), "labels")
    sha = F.lit(hashlib.sha256(b"").hexdigest())
    for dim, of in books.items():
        sha = F.when(F.col("dim") == dim, digest(of)).otherwise(sha)
    out = coded.join(sized(labels), F.col("label").eqNullSafe(F.col("label_")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", sha.alias("codebooks_sha256"))
