"""The filter audit against every order applied to every document in plain Python."""

import re
from itertools import permutations

from memlift.llm import filter_audit

DOCS = "doc_id long, text string, lang string, quality int, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    good = {i for i, q, t, _ in labels if q == 1 and i is not None}
    toxic = {i for i, q, t, _ in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = {}
    for i, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in rows if f in r[0] and not r[0] & before]
                kept = sum(not r[0] & (before | {f}) for r in rows)
                share[f] += len(gone)
                out[part, "".join(order), k + 1] = [kept, len(gone), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(share[f])
    return out


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_every_order_applied(spark):
    words = " ".join(f"w{i}" for i in range(120))
    docs = [(i, t, lang, 0, 0) for i, (t, lang) in enumerate([(words, "en"), (words, "en"), (words + " # Ä", "de"), ("A B C", None), ("a " * 150, ""), ("", "en"), (None, "de"), (words.upper(), "en"), ("é" * 30 + "ABC", "fr"), ("é" * 30 + "ABCD", "fr")] * 3)]
    docs += [(4, "a " * 150, "", 0, 0), (None, words, "en", 0, 0), (None, words, "en", 0, 0), (7, "other", "xx", 0, 0), (0, words, "de", 0, 0), (-5, "\t\n#", None, 0, 0)]
    docs += [(100 + i, "copy of a text", "en" if i % 2 else "de", 0, 0) for i in range(60)]
    labels = [(i, i % 2, int(i % 3 == 0), "p") for i in range(0, 20)] + [(3, None, None, "p"), (3, 0, 1, "p"), (None, 1, 1, "p"), (500, 1, 1, "p"), (101, 1, None, "p")]
    assert got(filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))) == brute(docs, labels)


def test_many_parts(spark):
    """More rows than Spark's default limit of a recursion lets through."""
    docs = [(i, f"text {i} #", f"l{i % 150}", 0, 0) for i in range(300)] + [(1000 + i, "Many " * (i % 130), f"l{i % 150}", 0, 0) for i in range(1500)]
    assert got(filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))) == brute(docs, [])


def test_no_rows(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1, "p")], LABELS)).collect() == []
