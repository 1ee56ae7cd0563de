"""What the operators of this folder share: text as bytes, Arrow batches, tables written to the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlift.shipping import ship

#: What separates words: space and the characters 9 to 13, as bytes.split() does.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in a batch that goes to Python, where the session has Spark's default: texts are long, and a batch stands in memory on
#: both sides.
TEXT_ROWS, DEFAULT_ROWS = 1000, "10000"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == DEFAULT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, one of our own, in local mode only: elsewhere
    each executor would write to a disk of its own."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='memlift-')}"
        sc.setCheckpointDir(given)
    return given


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors and gives joins a true size."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/memlift-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unstage(*frames: DataFrame) -> None:
    """Deletes what stage() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/memlift-" in str(folder):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Up to so many rows a table of ids or hashes goes to each task (10 MB at 32 bytes); beyond, both sides are dealt out.
BROADCAST_IDS = 300_000


def sized(keys: DataFrame) -> DataFrame:
    """keys (a written table of ids or hashes), hinted to be sent to each task where it is small and to be merged else."""
    return keys.hint("broadcast" if keys.count() <= BROADCAST_IDS else "merge")


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """For what runs inside: at most so many rows in a batch that goes to Python, for rows that hold whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with columns as Python lists. make() is called once in a task and returns what turns a batch, of so many
    rows at most, into a batch."""
    ship(df.sparkSession)
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            # pieces of bounded size, so that a batch of long texts stays small in memory
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def hash_share(*cols: Column) -> Column:
    """A fixed number from 0 up to 1 for each row, the same on every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sample_about(df: DataFrame, n: int, key: Column) -> DataFrame:
    """About n rows (all, where there are fewer), the same on every run. For fitting only."""
    total = df.count()
    return df if total <= n else df.where(hash_share(key) < F.lit(n / total))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
