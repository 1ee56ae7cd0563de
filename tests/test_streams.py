"""Streams that handle rows in order of time: one file against five shuffled ones, and each processor against a plain loop."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlift.plans.source_plans import folder
from memlift.shipping import ship
from memlift.streaming import monitors, ordered

DAY = 86_400_000
T0 = datetime.datetime(2024, 1, 1)


def drained(spark, rows, schema, key, processor, files, delay="100 days", shuffle=7):
    """What the processor gives for rows (at in minutes, number, key, ...) spread over so many files, each a batch of its own. A
    row of a key of its own, far later, closes the stream."""
    ship(spark)
    at = folder(spark)
    rows = [(T0 + datetime.timedelta(minutes=r[0]), *r[1:]) for r in rows]
    random.Random(shuffle).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    end = (T0 + datetime.timedelta(days=1000), -1, -1, *(None for _ in rows[0][3:]))
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    with ordered.keyed_states(spark):
        return [tuple(r) for r in monitors.drain(ordered.run(stream, key, processor, delay), f"{at}/q").collect()]


EVENTS = "at timestamp, number long, k long, value string"


def events(n=400):
    rng = random.Random(1)
    return [(m, i, rng.choice((1, 2, 3, 3, 3)), rng.choice("aab")) for i, m in enumerate(sorted(rng.randrange(5000) for _ in range(n)))]


def test_flips_from_one_file_and_from_five(spark):
    rows = events()
    held, wanted = {}, []
    for _, i, k, v in rows:
        if held.get(k, v) != v:
            wanted.append((i, k, held[k], v))
        held[k] = v
    for files in (1, 5):
        assert sorted(drained(spark, rows, EVENTS, "k", ordered.Flips(), files)) == sorted(wanted)


def test_rows_behind_the_delay_are_dropped(spark):
    """Without a delay the rows of later files that lie behind the watermark don't change what was believed in order."""
    rows = events()
    got = drained(spark, rows, EVENTS, "k", ordered.Flips(), 5, delay="0 seconds")
    assert 0 < len(got) and all(a != b for _, _, a, b in got)


def test_confidence_alerts_on_drops_only(spark):
    rng = random.Random(2)
    rows = [(m, i, rng.choice((1, 2, 2)), rng.random(), rng.random() < 0.3) for i, m in enumerate(sorted(rng.randrange(5000) for _ in range(200)))]
    rows.append((5001, 500, 1, None, True))
    mass, wanted = {}, []
    for _, i, k, w, bad in rows:
        s, c = mass.get(k, (0.0, 0.0))
        conf = lambda s, c: max(0.0, min(1.0, 0.5 + 0.15 * math.tanh(s) - 0.6 * math.tanh(c)))
        before, (s, c) = conf(s, c), (s, c + (w or 0.0)) if bad else (s + (w or 0.0), c)
        if before - conf(s, c) >= 0.05:
            wanted.append((i, k, before, conf(s, c)))
        mass[k] = (s, c)
    got = drained(spark, rows, "at timestamp, number long, k long, weight double, challenges boolean", "k", ordered.Confidence(0.05), 4)
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(wanted)] and len(got) > 3
    assert all(a == pytest.approx(b) for x, y in zip(sorted(got), sorted(wanted)) for a, b in zip(x[2:], y[2:]))


def as_of(facts, instant):
    return max(((e, n, v) for e, n, v in facts if e <= instant), default=(None, None, None))


FILED = "at timestamp, number long, k long, filed long, asks boolean, effect long, value double"


def filings(n=250):
    rng = random.Random(3)
    out = []
    for i, m in enumerate(sorted(rng.randrange(20_000) for _ in range(n))):
        filed = m * 60_000
        asks = i % 4 == 3
        out.append((m, i, rng.choice((1, 2)), filed, asks, filed - rng.choice((0, DAY, 3 * DAY)), None if asks else float(i)))
    return out


def test_late_facts_correct_past_answers(spark):
    """First answers know what was filed before them; corrections end at the answer that all facts give."""
    rows = filings()
    got = drained(spark, rows, FILED, "k", ordered.AsOf(100 * DAY), 3)
    facts = lambda k, upto: [(e, i, v) for _, i, kk, _, asks, e, v in rows if kk == k and not asks and i < upto]
    asks = {i: (k, e) for _, i, k, _, a, e, _ in rows if a}
    first = {r[0]: r[5] for r in got if r[0] is not None and r[2] is None}
    assert first == {i: as_of(facts(k, i), e)[2] for i, (k, e) in asks.items()}
    last = dict(first)
    for r in sorted((r for r in got if r[2] is not None), key=lambda r: r[2]):
        assert last[r[0]] == r[4]
        last[r[0]] = r[5]
    assert last == {i: as_of(facts(k, 10**9), e)[2] for i, (k, e) in asks.items()} and last != first


def test_too_late_for_the_stream_is_corrected_in_batch(spark):
    """With a short horizon questions are closed; what would change them comes out and a batch join gives the full answers."""
    rows = filings()
    got = drained(spark, rows, FILED, "k", ordered.AsOf(2 * DAY), 3)
    asks = {i: (k, e) for _, i, k, _, a, e, _ in rows if a}
    value = {i: v for _, i, _, _, a, _, v in rows if not a}
    effect = {i: e for _, i, _, _, a, e, _ in rows if not a}
    state = {}
    for r in sorted((r for r in got if r[0] is not None), key=lambda r: (r[2] is not None, r[2] or 0)):
        state[r[0]] = next((i for i, v in value.items() if v == r[5]), None)
    answers = [(q, *asks[q], effect.get(n), n, value.get(n)) for q, n in state.items()]
    late = [(r[1], r[2], r[3], r[5]) for r in got if r[0] is None]
    assert late
    out = ordered.correct_closed(spark.createDataFrame(answers, "question long, key long, instant long, effect long, number long, answer double"), spark.createDataFrame(late, "key long, number long, effect long, value double"))
    facts = lambda k: [(e, i, v) for _, i, kk, _, a, e, v in rows if kk == k and not a]
    assert {r.question: r.answer for r in out.collect()} == {q: as_of(facts(k), e)[2] for q, (k, e) in asks.items()}


def test_loops_in_a_large_graph(spark):
    """A hundred thousand edges of one graph that follow a hidden order, some turned round: each alarm closes a loop, and what is
    taken up has none."""
    rng = random.Random(4)
    hidden = list(range(5000))
    rng.shuffle(hidden)
    rows = []
    for i in range(100_000):
        a, b = sorted(rng.sample(range(5000), 2))
        if i > 50_000 and i % 1000 == 0:
            a, b = b, a
        rows.append((i // 100, i, 1, hidden[a], hidden[b]))
    rows += [(2000, 200_000, 2, 7, 7), (2000, 200_001, 2, 1, 2), (2001, 200_002, 2, 2, 3), (2001, 200_003, 2, 2, 1), (2002, 200_004, 2, 3, 1), (2002, 200_005, 2, 1, 3), (2003, 200_006, 2, None, 1)]
    got = drained(spark, rows, "at timestamp, number long, g long, src long, dst long", "g", ordered.Loops(), 3)
    assert sorted(r for r in got if r[1] == 2) == [(200_000, 2), (200_003, 2), (200_004, 2)]
    alarms = {r[0] for r in got if r[1] == 1}
    assert alarms
    taken = [(a, b) for _, i, g, a, b in rows if g == 1 and i not in alarms]
    known: dict = {}
    for _, i, g, a, b in rows:  # each alarm closes a loop with the edges taken up before it
        if g == 1 and i not in alarms:
            known.setdefault(a, []).append(b)
        elif g == 1:
            seen, todo = {b}, [b]
            while todo and a not in seen:
                new = [n for n in known.get(todo.pop(), ()) if n not in seen]
                seen.update(new)
                todo += new
            assert a in seen
    indegree, after = dict.fromkeys(range(5000), 0), {}
    for a, b in taken:
        after.setdefault(a, []).append(b)
        indegree[b] += 1
    todo = [n for n, d in indegree.items() if not d]
    done = 0
    while todo:
        done += 1
        for b in after.get(todo.pop(), ()):
            indegree[b] -= 1
            if not indegree[b]:
                todo.append(b)
    assert done == 5000  # no loop is left


def test_repeats_get_the_first_id(spark):
    ship(spark)
    at, schema = folder(spark), "id long, scope string, text string, at timestamp"
    day = lambda d: T0 + datetime.timedelta(days=d)
    for batch in ([(5, "s", "x", day(1)), (3, "s", "x", day(1)), (4, None, None, day(1)), (9, "s", "y", day(1))], [(1, "s", "x", day(2)), (7, "t", "x", day(2))], [(20, "z", "z", day(60))], [(21, "z", "z", day(61))], [(30, "s", "x", day(62)), (31, "z", "z", day(62))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    with ordered.keyed_states(spark):
        got = monitors.drain(ordered.first_seen(stream, "scope", "text", "id", at="at"), f"{at}/q")
    # id 30 comes after the content of id 3 was forgotten
    assert {(r.id, r.first_id, r["repeat"]) for r in got.collect()} == {(3, 3, False), (5, 3, True), (4, 4, False), (9, 9, False), (1, 3, True), (7, 7, False), (20, 20, False), (21, 20, True), (30, 30, False), (31, 20, True)}


class _Held(dict):
    """A map state, or a handle that gives such states and keeps timers."""

    exists, getValue, updateValue = dict.__len__, dict.get, dict.__setitem__
    removeKey = dict.__delitem__

    def getMapState(self, name, *schemas):
        return self.setdefault(name, _Held())

    def registerTimer(self, at):
        self.setdefault("timers", set()).add(at)

    def getCurrentWatermarkInMs(self):
        return self["now"]

    def getExpiryTimeInMs(self):
        return self["at"]


def test_many_contents_are_one_call(spark):
    """each distinct text was a Python call of its own. Batches of one bucket against a plain loop, with contents that are
    seen again before and after they are forgotten."""
    rng, seen, handle, number = random.Random(4), {}, _Held(), 0
    p = ordered.FirstSeen(30)
    p.init(handle)
    for batch in range(12):
        rows, wanted = [], []
        for _ in range(300):
            number += 1
            rows.append((T0 + datetime.timedelta(days=batch * 9, minutes=rng.randrange(1000)), rng.choice("st"), f"c{rng.randrange(600)}", number))
        for at, scope, content, n in sorted(rows):
            wanted.append((n, scope, content, seen.get((scope, content), (n,))[0], (scope, content) in seen))
            seen[scope, content] = (wanted[-1][3], at)
        parts = [pd.DataFrame(rows[i : i + 100], columns=["at", "scope", "content", "number"]) for i in range(0, 300, 100)]
        got = [t for part in p.handleInputRows((0,), iter(parts), None) for t in part.itertuples(index=False, name=None)]
        assert sorted(got) == sorted(wanted)
        now = max(r[0] for r in rows)
        seen = {c: x for c, x in seen.items() if x[1] + datetime.timedelta(days=30) > now}
        ms = (now - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1)
        while due := sorted(t for t in handle.get("timers", ()) if t <= ms):
            handle["timers"].remove(due[0])
            assert not any(len(x) for x in p.handleExpiredTimer((0,), _Held(now=ms), _Held(at=due[0])))
        assert handle["first"].keys() == seen.keys()


def test_buckets_change_no_row(spark):
    ship(spark)
    at, schema = folder(spark), "id long, scope string, text string"
    for batch in range(2):
        spark.createDataFrame([(i, "s", f"t{i % 70}") for i in range(batch * 100, batch * 100 + 100)], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    for buckets in (1, 50):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        with ordered.keyed_states(spark):
            got = monitors.drain(ordered.first_seen(stream, "scope", "text", "id", buckets=buckets), f"{at}/q{buckets}").collect()
        assert sorted((r.id, r.first_id, r["repeat"]) for r in got) == [(i, i % 70, i >= 70) for i in range(200)]


def test_null_times_have_no_place(spark):
    assert ordered.run(spark.readStream.format("rate").load().select(F.lit(None).cast("timestamp").alias("at"), F.col("value").alias("number"), F.lit(1).cast("long").alias("k"), F.lit("x").alias("value")), "k", ordered.Flips()).isStreaming


def test_expiry_goes_by_spans(spark):
    """each belief was a Python call of its own. One stated again in time holds to its later expiry; one stated again afterwards
    has expired before, whichever batch brings it."""
    day = lambda n: T0 + datetime.timedelta(days=n)
    rows = [(1, day(0), day(10)), (1, day(5), day(7)), (2, day(0), day(10)), (2, day(8), day(20)), (3, day(0), day(10)), (3, day(30), day(35)), (4, day(3), None), (5, day(4), day(1)), (6, day(95), day(200)), (7, day(100), day(101))]
    at = folder(spark)
    schema = "id long, at timestamp, expires_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in")
    with ordered.keyed_states(spark):
        got = monitors.drain(monitors.expiry_alerts(spark.readStream.schema(schema).parquet(f"{at}/in")), f"{at}/q").collect()
    assert sorted(tuple(r) for r in got) == [(1, day(10)), (2, day(20)), (3, day(10)), (3, day(35)), (5, day(1))]
