"""Personal data: base spans against a plain version, further kinds on planted texts, clean texts left alone."""

import hashlib
import inspect
import re

import pyarrow.parquet as pq

from memlift.llm import personal_data

SCHEMA = "doc_id long, text string, n_email string, found int, spans int"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0])]
    said = ",".join(f"{name}:{a}:{b}" for a, k, name, b in sorted(found))
    return [sum(n == name for _, _, n, _ in found) for name, *_ in kinds], hashlib.sha256(said.encode()).hexdigest(), said


def check(rows, got):
    """The base columns and the base spans of every row; further spans overlap none of them."""
    left = sorted((i is None, i or 0, *map(str, base(t)[:2])) for i, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, str([r.n_email, r.n_ip, r.n_card, r.n_phone]), r.base_sha256) for r in got) == left
    for r in got:
        spans = [(int(a), names.index(k), k, int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans)
        own = [s for s in spans if s[1] < 4]
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in own).encode()).hexdigest() == r.base_sha256
        assert not any(a < d and c < b for a, k, _, b in spans if k >= 4 for c, _, _, d in own)


names = [k.name for k in personal_data.KINDS]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    check(rows, personal_data.find(docs).collect())


TRICKY = [
    "a@b.c_d@e.f x", "a@b", "@b.com", "a@b.com.", "é😀 jo@ex.org 😀 10.0.0.1", "a..b%+@x-y.z-w.q", "@@a@b.c@d.e", "a@b.c-d@e.f.", "x@y..z",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 0001.02.3.0255", "1.2.3", "1.2.3.4444444444444444444", "v1.2.3.4a",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111", "0" * 12, "0" * 19 + " " + "0" * 20, "411111111111-1111-", "1 2 3 4 5 6 7 8 9 0 1 2 3",
    "+1 (487) 555-7209", "+49..30..123456", "++1 555 555 5555 +", "+1()()-.555", "+123456789012345 +1234567890123456 x", "+1 555 555 5555, +1 555 555 5556",
    "", None, " \n\t", "+", "+1", "a@b.c\n+1 555\n555 5555",
]


def test_tricky_texts(spark):
    rows = [(i % 7 if i % 5 else None, t, "x", 1, 2) for i, t in enumerate(TRICKY * 2)]
    check(rows, personal_data.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def runs(n):
    return ["a" * n, "1" * n, "1." * (n // 2), "a." * (n // 2) + "@", "1 " * (n // 2), "a@" * (n // 2), "+1" * (n // 2), "1.1.1.1 " * (n // 20) + "a@b.c " * (n // 20), "Ab " * (n // 3), "x at " * (n // 5)]


def test_long_texts(spark):
    """Runs that look like the beginning of a span, as far as the plain version, which tries each place anew, gets."""
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(runs(8_000))]
    check(rows, personal_data.find(spark.createDataFrame(rows, SCHEMA)).collect())


def test_very_long_texts(spark):
    """The same with half a million characters, where anything but linear time would not end."""
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(runs(500_000))]
    got = {r.doc_id: r for r in personal_data.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[7].n_ip, got[7].n_email, got[2].n_ip, got[0].spans) == (25_000, 25_000, 62_500, "")


PLANTED = [
    ("write to jo.lee (at) mail (dot) org or ask", "masked_email", "jo.lee (at) mail (dot) org"),
    ("contact: max [at] firma.de bitte", "masked_email", "max [at] firma.de"),
    ("e-mail ann at example dot com today", "masked_email", "ann at example dot com"),
    ("call me at (415) 555-2671 tonight", "local_phone", "(415) 555-2671"),
    ("her social security number is 219-09-9999 they said", "national_id", "219-09-9999"),
    ("transfer to IBAN DE89 3704 0044 0532 0130 00 by noon", "iban", "DE89 3704 0044 0532 0130 00"),
    ("we met Dr. Maria Schmidt there, and Mr. Thomas Baker too", "name", "Thomas Baker"),
    ("ship it to 12 Old Mill Road as usual", "address", "12 Old Mill Road"),
]
CLEAN = ["see version 415.555.2671 of the build", "order 000-12-3456 was sent", "look at home. The door is open", "chapter 12 at page 3 dot dot", "code DE00 3704 0044 0532 0130 00 fails", "The Quick Brown fox", "In Old Town they said no", "the sum is 12345 in total"]


def test_further_kinds(spark):
    rows = [(i, t, "x", 1, 2) for i, (t, _, _) in enumerate(PLANTED)] + [(100 + i, t, "x", 1, 2) for i, t in enumerate(CLEAN)]
    got = {r.doc_id: r.spans for r in personal_data.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (text, kind, value) in enumerate(PLANTED):
        at = text.index(value)
        assert f"{kind}:{at}:{at + len(value)}" in got[i].split(","), (text, got[i])
    assert {got[100 + i] for i in range(len(CLEAN))} == {""}


def test_reliabilities_follow_the_votes(spark):
    """A labeler that agrees with the others ends up counting for more than one that votes at random."""
    make = lambda y, noise: sum(v * 3**i for i, v in enumerate((2 * y, 2 * y, 2 * noise, 1, 1)))
    cands = [(3, k, 9, False, make(y, noise), [1]) for k in (2,) for y in (0, 1) for noise in (0, 1) for _ in range(200)]
    found = spark.createDataFrame([(cands,)], f"found array<{personal_data.CANDIDATE}>")
    soft = personal_data.reliabilities(found)
    p = lambda a, b, c: soft[2 * personal_data.PATTERNS + a + 3 * b + 9 * c + 27 + 81]
    assert p(2, 2, 0) > 0.95 and p(0, 0, 2) < 0.05
    assert abs(p(2, 2, 0) - p(2, 2, 2)) < 0.05


def test_empty_table_and_reruns(spark):
    assert personal_data.find(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(i, t, "x", 1, 2) for i, (t, _, _) in enumerate(PLANTED)], SCHEMA)
    assert personal_data.find(rows).orderBy("doc_id").collect() == personal_data.find(rows.repartition(3)).orderBy("doc_id").collect()


def test_native(spark, sf_dir):
    """No Python runs on the executors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = personal_data.candidates(docs)._jdf.queryExecution().toString() + personal_data.find(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert not re.search(r"udf|pandas|Arrow\(|\.rdd", inspect.getsource(personal_data))
