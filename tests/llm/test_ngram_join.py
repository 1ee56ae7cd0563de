import random
from collections import Counter, defaultdict

from memlift.llm import ngram_join


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Sizes and components by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    lists = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b, n in Counter(b for x in sets[a] for b in lists[x] if b < a).items():
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 as id", "'x' as key", "2 as component", "3 as n_shingles")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}


def versions(rng, base, n, edits, start):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice((40, 80, 150)))]
        rows += versions(rng, base, 40, rng.choice((1, 2, 3)), g * 100)  # some link, some are just too far apart
    passage = " ".join(word() for _ in range(60))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(120))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three four five six"), (2006, "x " * 20000)]
    rows += [(3000 + i, rows[0][1]) for i in range(60)]
    assert run(spark, rows, extra=True) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_null_ids_and_repeated_ids(spark):
    got = ngram_join.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got if r["doc_id"] is not None) == [(False, 1), (False, 1)]
    assert len(got) == 3
