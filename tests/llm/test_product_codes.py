"""Product codes against every part compared with every entry, in plain Python integers."""

import hashlib
from math import floor

import numpy as np

from memlift.llm import product_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows):
    """Codes of vectors of one length: (id, code, error, label_error, sha) of each row."""
    kept = [(i, [max(-product_codes.LIMIT, min(product_codes.LIMIT, floor(1024 * float(np.float32(x))))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kept = [(i, v + [0] * (-len(v) % 4), label) for i, v, label in kept]
    if not kept:
        return []
    w = len(kept[0][1]) // 4
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(4)]
    pick = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            of = {}
            for _, v, _ in kept:
                of.setdefault(pick(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        got = [pick(x, b) for x, b in zip(cut(v), books)]
        error = sum(d for d, _ in got)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in got), error, label, sha))
    return [(i, c, e, sums[label], s) for i, c, e, label, s in out]


def rows_of(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def wanted(*groups):
    return sorted((i is None, i or 0, c, e, le, s) for rows in groups for i, c, e, le, s in brute(rows))


def test_equals_every_entry_tried(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8))
    rows = [(int(i), [float(x) for x in (centres[i % 12] + 0.1 * rng.standard_normal(8)).astype(np.float32)], int(i % 3), "x") for i in rng.permutation(700)]
    rows += [(9000 + i, rows[0][1], None, "x") for i in range(300)]  # one vector in a third of the rows
    rows += [(9500, [0.5] * 8, 1, "x"), (9500, [-0.5] * 8, 1, "x"), (None, [0.25] * 8, None, "x"), (None, [0.25] * 8, None, "x")]
    rows += [(9600, None, 1, "x"), (9601, [1.0, None] + [0.0] * 6, 1, "x"), (9602, [float("nan")] + [0.0] * 7, 1, "x"), (9603, [float("inf")] + [0.0] * 7, 1, "x")]
    rows += [(9700, [-1e-9, 1e-9, -0.0, 0.0, 1023.99, -1023.99, 1 / 1024, -1 / 1024], 2, "x")]
    assert rows_of(product_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))) == wanted(rows)


def test_few_equal_odd_and_huge(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, ""), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 1, ""), (3, [3e38, -3e38, 0.0, 1.0, 2.0], None, "")]
    four = [(5, [1.0, -1.0, 2.0, -2.0], 7, ""), (4, [1.5, -1.5, 2.5, -2.5], 8, "")]
    got = rows_of(product_codes.compress(spark.createDataFrame(rows + four, SCHEMA)))
    assert got == wanted(rows, four)


def test_no_rows(spark):
    assert product_codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert product_codes.compress(spark.createDataFrame([(1, None, 1, ""), (2, [None], 1, "")], SCHEMA)).collect() == []
    (r,) = product_codes.compress(spark.createDataFrame([(1, [], 1, "")], SCHEMA)).collect()
    assert (r.code, r.error, r.label_error, r.codebooks_sha256) == ("00000000", 0, 0, hashlib.sha256(b",,,"[:0]).hexdigest())


def test_hilbert_neighbours():
    """Points next to each other on the curve differ by one in one component, and each point is met once."""
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = [bytes(k) for k in product_codes.hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(grid)
        path = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_leaves_out_no_nearest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, book = rng.integers(-50, 50, (20, 4)) // 10, rng.integers(-50, 50, (30, 4)) // 5
        few = product_codes.shortlist(x.min(0), x.max(0), book)
        best, far = product_codes.nearest(x, book)
        got, near = product_codes.nearest(x, book[few])
        assert (few[got] == best).all() and (near == far).all()


def test_smallest_ids_narrowed(spark):
    rows = spark.range(0, 60_000, 1, 4).selectExpr("id * 7 - 1000 as id", "array(cast(id as int)) as v")
    assert product_codes._smallest(rows, 256) == [[i] for i in range(256)]
