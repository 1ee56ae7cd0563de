"""A training corpus from the documents table in five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the compression-distance model calls toxic go.
2. near_duplicates: of each group that the exact n-gram Jaccard join links, the smallest doc_id stays.
3. secrets: spans that look like secrets are replaced by a mark; no document goes.
4. mixture: each document is repeated as often as the mixture to target weights takes it; copies keep its doc_id.
5. pieces: the texts as SentencePiece ids, with the scores of the best segmentations.

All but the last return the columns of documents. A stage sees only what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlift.llm import mixing, ngram_join, piece_lattice, secret_scan, toxicity
from memlift.llm.common import sized, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that the last stage's tasks keep (at most twice so many): by then the stages before have filled the executors' memory.
PIECE_WORDS = 90_000


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half. The model learns from labelled rows that are not held out.

    Each row is judged by its text alone: null and empty texts, null ids and repeated rows stay or go like others. Without
    labels all stay. An empty table gives an empty result; further columns go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model).select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id names the group. Documents without words stay, and rows with a null id
    too. Of rows that repeat an id and the words, one stays (the least by the other columns). An empty table gives an
    empty result; further columns go."""
    found = ngram_join.near_duplicates(docs)
    gone = stage(found.where("component_id != doc_id").select("doc_id").distinct(), "gone")
    kept = docs.select(*COLUMNS).join(sized(gone), "doc_id", "left_anti")
    again = stage(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated_ids")
    if not again.limit(1).count():
        return kept
    row = F.struct(*(F.col(c) for c in COLUMNS if c != "doc_id"))
    words = F.regexp_replace(F.trim(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     ")), " +", " ")
    one = kept.join(sized(again), "doc_id", "left_semi").groupBy("doc_id", F.md5(words).alias("words")).agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return kept.join(sized(again), "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars of what is left. Null texts stay null with their
    n_chars. Each row is handled by itself. An empty table gives an empty result; further columns go."""
    return secret_scan.redact_documents(docs.select(*COLUMNS), secret_scan.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it. Null ids, sources and texts are values like others, and rows with
    one id, source and number of words are taken alike. An empty table gives an empty result; further columns go."""
    key = ("doc_id", "source", "size")
    copies = mixing.mix(docs).where("copies > 0").select(*(F.col(c).alias(f"{c}_") for c in key), "copies").distinct()
    rows = docs.select(*COLUMNS, mixing.n_words(F.col("text")).alias("size"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]
    taken = rows.join(sized(stage(copies, "copies")), same[0] & same[1] & same[2])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the encoding of each row, its ids among it. A null text has no pieces. Each row is handled by
    itself. An empty table gives an empty result; further columns go."""
    return piece_lattice.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, carry=("lang", "source"), room=PIECE_WORDS)


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("secrets", secrets_out), ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in order."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no compression, lattices or search over inverted lists; tests/llm holds run() against a plain version.
ORACLE_SQL = None
