"""Seams for models and memories: a call that turns prompts into replies, retrievers, and auto-capture."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memlift.functions import text as T
from memlift.operators import retrieval as R
from memlift.operators import sampling as S


def first_sentence(prompt: str) -> str:
    """The rule that stands in for a model where none is given."""
    return (prompt or "").strip().split(". ")[0][:200]


def ask(make: Callable[[], Callable[[str], str]] = lambda: first_sentence) -> Callable[[Column], Column]:
    """A vectorised function from prompts to replies. make() is called once in a task, to open one client."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for prompts in batches:
            yield prompts.map(client)

    return run.asNondeterministic()


class Retriever(Protocol):
    """What every retrieval operator offers: the k best items for each question."""

    def topk(self, questions: DataFrame, items: DataFrame, k: int) -> DataFrame: ...


class Memory(Protocol):
    """A store that takes facts, answers from them, and may say unasked what a new fact undercuts. One without that answers
    surface() with None and is graded as lacking it, not as failing."""

    def write(self, facts: DataFrame) -> DataFrame: ...

    def surface(self, new: DataFrame, least: float) -> DataFrame | None: ...


class FactMemory:
    """Facts (subject, id, attribute, value) in a folder that the cluster shares."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, facts: DataFrame) -> DataFrame:
        """Appends the facts; id and receipt of each."""
        facts.write.mode("append").parquet(f"{self.folder}/facts")
        return facts.select("id", F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), "attribute").cast("binary"), 256), 1, 12).alias("receipt"))

    def surface(self, new: DataFrame, least: float) -> DataFrame:
        """subject, new_id, old_id: new facts that differ by more than `least` from what was held on subject and attribute just before."""
        held = new.sparkSession.read.schema(new.schema).parquet(f"{self.folder}/facts")
        w = W.partitionBy("subject", "attribute").orderBy("id")
        moved = held.select("subject", F.col("id").alias("new_id"), F.lag("id").over(w).alias("old_id"), F.abs(F.col("value") - F.lag("value").over(w)).alias("by"))
        return moved.where(F.col("by") > least).join(new.select(F.col("id").alias("new_id")), "new_id", "left_semi").select("subject", "new_id", "old_id")


class Bm25Retriever:
    def topk(self, questions: DataFrame, items: DataFrame, k: int) -> DataFrame:
        return R.best(R.bm25(questions, items, T.tokens(F.col("question")), T.tokens(F.col("body")), most=k), k)


def capture(turns: DataFrame, key: str, order: str, text: str, reader: Callable[[Column], Column]) -> DataFrame:
    """Facts of each run of eight turns: key, chunk, place, fact."""
    c = S.chunks(turns, key, order, text)
    facts = T.fact_list(reader(F.col("excerpt")))
    return c.select(key, "chunk", F.posexplode(facts).alias("place", "fact"))


def relation_lines(reply: Column) -> Column:
    """Edges (relation, target) that lines like `supersedes: 12` name; where one target is concerned and superseded too,
    it is concerned only."""
    found = F.regexp_extract_all(F.lower(reply), F.lit(r"(supersedes|contradicts|concerns|supports|refines)\s*:?\s*#?(\d+)"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("relation"), F.regexp_extract(x, r"(\d+)$", 1).cast("long").alias("target")))
    concerned = F.transform(F.filter(pairs, lambda p: p["relation"] == "concerns"), lambda p: p["target"])
    return F.array_distinct(F.filter(pairs, lambda p: (p["relation"] != "supersedes") | ~F.array_contains(concerned, p["target"])))


def structure_lines(reply: Column) -> Column:
    """Names in `order: a > b` or `collection: a, b` lines, shorter than 40."""
    rest = F.concat_ws(",", F.regexp_extract_all(reply, F.lit(r"(?im)^\s*(?:order|collection)\s*:\s*(.+)$"), F.lit(1)))
    return F.filter(F.transform(F.split(rest, r"[>,]"), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < 40))


def tolerant_facts(reply: Column) -> Column:
    """Facts of a reply in any of three shapes: a JSON array of strings, lines, or one blob."""
    listed = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<string>")
    return F.when(F.size(listed) > 0, listed).when(F.size(T.fact_list(reply)) > 0, T.fact_list(reply)).otherwise(F.array(F.trim(reply)))
