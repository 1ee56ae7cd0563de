"""Streams whose rows are handled in order of event time, whichever file brings them, with several keyed states.

Rows of a key wait in a list state until the watermark has passed them; a timer at the earliest one wakes the key. So a
step sees each row once, in order of (event time, number), from one file or from many shuffled ones, as long as no row
comes later than the delay. Rows behind the watermark are dropped by Spark, as they are of any stateful stream. Event times count in
milliseconds, as watermarks do; of rows in one millisecond the smaller number comes first.

A waiting list is as long as the rows of a key within the delay. States are RocksDB's, kept in the checkpoint folder, so an
executor that is lost costs the batch it was at.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_states(spark: SparkSession):
    """Streams begun inside keep their states in RocksDB, which stateful processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def milliseconds(at) -> F.Column:
    """A time in whole milliseconds, as watermarks count."""
    return F.timestamp_millis(F.unix_millis(at))


class InOrder(StatefulProcessor):
    """Gives step() the rows of a key in order once the watermark has passed them. Rows have `at`, `number` and what the
    subclass names in FIELDS (name and type); the key's column comes first in what step() yields."""

    FIELDS: tuple[tuple[str, str], ...] = ()
    OUT: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the new rows of a batch are one entry: a call and an encoding for each row took longer than the rows' own work
        self.waiting = handle.getListState("waiting", "rows binary")
        self.due = handle.getValueState("due", "at long")
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        """Makes the subclass's own states."""

    def step(self, key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        """rows: (number, *FIELDS) in order."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64")
            new += zip(at.tolist(), *(_plain(part[n], t) for n, t in (("number", "long"), *self.FIELDS)))
        yield self._go(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._go(key, [], timerValues.getCurrentWatermarkInMs(), True)

    def _go(self, key: tuple, new: list[tuple], now: int, expired: bool = False) -> pd.DataFrame:
        due = None if expired else _value(self.due)  # a timer that has gone off is the one that was due
        first = min([r[0] for r in new] + ([due] if due is not None else []), default=None)
        if first is not None and first > now:  # nothing is ready yet: the list only grows
            ready, later = [], None
            self.waiting.appendValue((pickle.dumps(new),))
        else:
            old = [] if due is None and not expired else [r for (part,) in self.waiting.get() for r in pickle.loads(part)]
            rows = sorted(old + new, key=lambda r: r[:2])
            ready, later = [r[1:] for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
            first = later[0][0] if later else None
            if later:
                self.waiting.put([(pickle.dumps(later),)])
            elif old:
                self.waiting.clear()
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
                self.due.update((first,))
            elif due is not None:
                self.due.clear()
        elif expired:
            self.due.clear()
        return pd.DataFrame(list(self.step(key, ready)) if ready else [], columns=list(self.OUT), dtype=object)


def _plain(column: pd.Series, kind: str) -> list:
    """The column's values as Python's own, with None for nulls (which make whole numbers come as floats)."""
    make = {"long": int, "double": float, "boolean": bool}.get(kind, str)
    return [None if v is None or v != v else make(v) for v in column.tolist()]


def _value(state, default=None):
    """What a value state holds, or the default."""
    found = state.get()
    return default if found is None else found[0]


class Flips(InOrder):
    """Whenever a key's value differs from the one believed; it is believed from then on."""

    FIELDS = (("value", "string"),)
    OUT = ("event_id", "key", "before", "now")
    SCHEMA = "event_id long, key long, before string, now string"

    def states(self, handle):
        self.believed = handle.getValueState("believed", "value string")

    def step(self, key, rows):
        believed = _value(self.believed)
        for number, value in rows:
            if value is None:
                continue
            if believed is not None and value != believed:
                yield number, key[0], believed, value
            believed = value
        if believed is not None:
            self.believed.update((believed,))


class Confidence(InOrder):
    """A belief's effective confidence, worked out anew with each piece of evidence from the mass of support and of challenge so
    far: an alert whenever it drops by delta or more. Rises and small drops give none. Before all evidence it is `base`."""

    FIELDS = (("weight", "double"), ("challenges", "boolean"))
    OUT = ("event_id", "key", "before", "now")
    SCHEMA = "event_id long, key long, before double, now double"

    def __init__(self, delta: float, base: float = 0.5):
        self.delta, self.base = delta, base

    def states(self, handle):
        self.support = handle.getValueState("support", "mass double")
        self.challenge = handle.getValueState("challenge", "mass double")

    def effective(self, support: float, challenge: float) -> float:
        return max(0.0, min(1.0, self.base + 0.15 * math.tanh(support) - 0.6 * math.tanh(challenge)))

    def step(self, key, rows):
        support, challenge = _value(self.support, 0.0), _value(self.challenge, 0.0)
        before = self.effective(support, challenge)
        for number, weight, challenges in rows:
            if challenges:
                challenge += weight or 0.0
            else:
                support += weight or 0.0
            now = self.effective(support, challenge)
            if before - now >= self.delta:
                yield number, key[0], before, now
            before = now
        self.support.update((support,))
        self.challenge.update((challenge,))


class Warnings(InOrder):
    """Hits of an actor, summed with exponential decay by the seconds since; rows: second, hit."""

    FIELDS = (("second", "double"), ("hit", "boolean"))
    OUT = ("event_id", "key", "level")
    SCHEMA = "event_id long, key long, level double"

    def __init__(self, decay: float):
        self.decay = decay

    def states(self, handle):
        self.level = handle.getValueState("level", "level double, second double")

    def step(self, key, rows):
        level, last = self.level.get() or (0.0, None)
        for number, second, hit in rows:
            level = (level * math.exp(-self.decay * (second - last)) if last is not None else 0.0) + float(bool(hit))
            last = second
            yield number, key[0], level
        self.level.update((level, last))


class AsOf(InOrder):
    """Questions as of an instant, answered when they are asked and corrected when a fact is filed late.

    Rows in order of filing are facts (effect, value) or questions (effect: the instant they ask about). A question is answered by
    the fact with the latest effect at or before its instant, ties to the later number. A fact filed afterwards that would
    have been the answer gives a correction: only questions of its key at or after its effect are looked at. Questions about
    instants more than `horizon` (ms) before the newest filing are closed and leave the state, and of the facts before that
    bound only the latest stays. A fact that takes effect before the bound could change closed questions: it comes out
    as a row without a question, for correct_closed() to run in batch."""

    FIELDS = (("filed", "long"), ("asks", "boolean"), ("effect", "long"), ("value", "double"))
    OUT = ("question", "key", "cause", "effect", "was", "answer")
    SCHEMA = "question long, key long, cause long, effect long, was double, answer double"

    def __init__(self, horizon: int):
        self.horizon = horizon

    def states(self, handle):
        self.facts = handle.getListState("facts", "effect long, number long, value double")
        self.open = handle.getListState("open", "instant long, question long, effect long, number long, answer double")
        self.latest = handle.getValueState("latest", "filed long")

    def step(self, key, rows):
        facts = sorted(tuple(r) for r in self.facts.get()) if self.facts.exists() else []
        asked = sorted((list(r) for r in self.open.get()), key=lambda r: r[:2]) if self.open.exists() else []
        latest = _value(self.latest)
        for number, filed, asks, effect, value in rows:
            latest = filed if latest is None else max(latest, filed)
            bound = latest - self.horizon
            if asks:
                at = bisect_right(facts, effect, key=lambda f: f[0])
                found = facts[at - 1] if at else (None, None, None)
                insort(asked, [effect, number, *found], key=lambda r: (r[0], r[1]))
                yield number, key[0], None, found[0], None, found[2]
                continue
            insort(facts, (effect, number, value), key=lambda f: f[:2])
            if effect < bound:
                yield None, key[0], number, effect, None, value
            for q in asked[bisect_left(asked, max(effect, bound), key=lambda r: r[0]) :]:
                if q[3] is None or (q[2], q[3]) < (effect, number):
                    yield q[1], key[0], number, effect, q[4], value
                    q[2:] = [effect, number, value]
        asked = asked[bisect_left(asked, latest - self.horizon, key=lambda r: r[0]) :]
        facts = facts[max(0, bisect_right(facts, latest - self.horizon, key=lambda f: f[0]) - 1) :]
        self.latest.update((latest,))
        for state, now in ((self.facts, facts), (self.open, [tuple(q) for q in asked])):
            if now:
                state.put(now)
            elif state.exists():
                state.clear()


def correct_closed(answers: DataFrame, late: DataFrame) -> DataFrame:
    """Answers (question, key, instant, effect, number, answer) with the facts (key, number, effect, value) that came too late
    for the stream: each question takes the latest of its own answer and its key's late facts by its instant."""
    facts = late.select(F.col("key").alias("key_"), F.struct(F.col("effect"), F.col("number"), F.col("value").alias("answer")).alias("f"))
    fits = (F.col("key") == F.col("key_")) & (F.col("f.effect") <= F.col("instant"))
    best = answers.hint("merge").join(facts, fits, "left").groupBy("question", "key", "instant", "effect", "number", "answer").agg(F.max("f").alias("f"))
    own = F.struct("effect", "number", "answer")
    newer = F.col("f").isNotNull() & (F.col("number").isNull() | (F.struct("f.effect", "f.number") > F.struct("effect", "number")))
    return best.withColumn("x", F.when(newer, F.col("f")).otherwise(own)).select("question", "key", "instant", "x.effect", "x.number", "x.answer")


class _Nodes:
    """A map state by node, read once a node and written once a step. Neighbours are held as sets."""

    def __init__(self, state, sets: bool):
        self.state, self.sets, self.held, self.changed = state, sets, {}, set()

    def get(self, node):
        if node not in self.held:
            found = self.state.getValue((node,))
            self.held[node] = set(found[0] if found else ()) if self.sets else found[0] if found else None
        return self.held[node]

    def set(self, node, value):
        self.held[node] = value
        self.changed.add(node)

    def add(self, node, other):
        self.get(node).add(other)
        self.changed.add(node)

    def save(self):
        for node in self.changed:
            self.state.updateValue((node,), (sorted(self.held[node]) if self.sets else self.held[node],))


class Loops(InOrder):
    """Edges (src, dst) of a graph that close a loop with those taken up before; such edges aren't taken up.

    The nodes are kept in a topological order that each edge changes only where it must (Pearce and Kelly): an edge that agrees with
    the order costs nothing. Else the nodes reached from its end, and those that reach its start, within the part of the order
    between the two, change places; if the start is reached, the edge closes a loop. Order and neighbours are map states by
    node, and a batch reads and writes those of the nodes that it touches."""

    FIELDS = (("src", "long"), ("dst", "long"))
    OUT = ("event_id", "key")
    SCHEMA = "event_id long, key long"

    def states(self, handle):
        self.rank = handle.getMapState("rank", "node long", "rank long")
        self.after = handle.getMapState("after", "node long", "nodes array<long>")
        self.ahead = handle.getMapState("ahead", "node long", "nodes array<long>")
        self.size = handle.getValueState("size", "n long")

    def step(self, key, rows):
        rank, after, ahead = _Nodes(self.rank, False), _Nodes(self.after, True), _Nodes(self.ahead, True)
        size = _value(self.size, 0)
        for number, a, b in rows:
            if a is None or b is None:
                continue
            if a == b:
                yield number, key[0]
                continue
            for node in (a, b):
                if rank.get(node) is None:
                    rank.set(node, size)
                    size += 1
            low, high = rank.get(b), rank.get(a)
            if low < high:
                reached = self._reach(b, after, lambda n: rank.get(n) <= high, a)
                if reached is None:
                    yield number, key[0]
                    continue
                reaching = self._reach(a, ahead, lambda n: rank.get(n) >= low, None)
                order = sorted(reaching, key=rank.get) + sorted(reached, key=rank.get)
                for node, place in zip(order, sorted(rank.get(n) for n in order)):
                    rank.set(node, place)
            after.add(a, b)
            ahead.add(b, a)
        for nodes in (rank, after, ahead):
            nodes.save()
        self.size.update((size,))

    @staticmethod
    def _reach(start: int, near: _Nodes, within, goal: int | None) -> set | None:
        """All nodes reached from start inside the part, or None once the goal is one."""
        seen, todo = {start}, [start]
        while todo:
            for n in near.get(todo.pop()):
                if n == goal:
                    return None
                if n not in seen and within(n):
                    seen.add(n)
                    todo.append(n)
        return seen


class FirstSeen(StatefulProcessor):
    """For each row (number) of a content the number of the first row with it; a repeat gets the existing one. State holds one
    number a content, forgotten `days` after its last row.

    The key is a bucket of contents, as a call for each content took longer than the contents' own work. Of a batch only the
    contents that are in it are read and written, however many the bucket holds. An event-time timer wakes the bucket for the
    contents that were new at one time; those seen again since wait for another."""

    SCHEMA = "id long, scope string, content string, first_id long, repeat boolean"
    OUT = ("id", "scope", "content", "first_id", "repeat")

    def __init__(self, days: float):
        self.lasts = int(days * 86_400_000)

    def init(self, handle):
        self.handle = handle
        self.first = handle.getMapState("first", "scope string, content string", "id long, forget long")
        self.due = handle.getMapState("due", "forget long", "contents binary")

    def handleInputRows(self, key, rows, timerValues):
        got: dict[tuple, list] = {}
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64")
            for scope, content, when, number in zip(part["scope"].tolist(), part["content"].tolist(), at.tolist(), part["number"].tolist()):
                got.setdefault((scope, content), []).append((when, number))
        empty = not self.first.exists()
        out, begun = [], {}
        for content, found in got.items():
            found.sort()
            later = found[-1][0] + self.lasts
            held = None if empty else self.first.getValue(content)
            first, forget = held or (found[0][1], None)
            if forget is None:
                begun.setdefault(later, []).append(content)
            if forget is None or later > forget:
                self.first.updateValue(content, (first, later))
            out += ((n, *content, first, held is not None or i > 0) for i, (_, n) in enumerate(found))
        self._wake(begun)
        yield pd.DataFrame(out, columns=list(self.OUT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        held = self.due.getValue(at)
        self.due.removeKey(at)
        again: dict[int, list] = {}
        for content in pickle.loads(held[0]):
            forget = self.first.getValue(content)[1]
            if forget > timerValues.getCurrentWatermarkInMs():
                again.setdefault(forget, []).append(content)
            else:
                self.first.removeKey(content)
        self._wake(again)
        yield pd.DataFrame(columns=list(self.OUT), dtype=object)

    def _wake(self, contents: dict[int, list]) -> None:
        """Sets timers for contents by the time when they are to be forgotten."""
        for at, some in contents.items():
            held = self.due.getValue((at,))
            if held is None:
                self.handle.registerTimer(at)
            self.due.updateValue((at,), (pickle.dumps((pickle.loads(held[0]) if held else []) + some),))


#: Keys among which first_seen() deals contents: so many Python calls a batch at most.
BUCKETS = 1024


def first_seen(rows: DataFrame, scope: str, text: str, number: str, at: str | None = None, days: float = 30, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """id, scope, content (hash), first_id, repeat of each row; null texts are one content, null numbers are left out. Without
    a column `at` the time of the batch counts."""
    when = F.current_timestamp() if at is None else F.col(at)
    slim = rows.select(milliseconds(when).alias("at"), F.coalesce(F.col(scope), F.lit("")).alias("scope"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("content"), F.col(number).alias("number"))
    dealt = slim.where("number is not null").withWatermark("at", delay).withColumn("bucket", F.pmod(F.xxhash64("scope", "content"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(FirstSeen(days), FirstSeen.SCHEMA, "append", "EventTime")


def run(rows: DataFrame, key: str, processor: InOrder, delay: str = "0 seconds") -> DataFrame:
    """rows: `at`, `number`, the key and the processor's fields. Gives the processor's rows; rows with a null time have no place in
    the order and are left out."""
    kept = rows.where("at is not null").withColumn("at", milliseconds("at")).withWatermark("at", delay)
    return kept.groupBy(key).transformWithStateInPandas(processor, processor.SCHEMA, "append", "EventTime")
