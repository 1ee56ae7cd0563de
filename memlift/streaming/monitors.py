"""Standing jobs over streams. Each has a batch twin that gives the same rows; state is small and kept by key. What depends on
the order of events is in ordered.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files at a path, or over the one file."""
    return spark.readStream.schema(schema).parquet(f"{path}*")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def expiry_alerts(beliefs: DataFrame) -> DataFrame:
    """id, expired_at of beliefs (id, at, expires_at) once the stream's time, an hour behind the latest row seen, has passed
    their expiry. A belief is a session of its id from `at` to its expiry; one stated again before it expires goes on to the later
    expiry of the two, one stated again afterwards is a belief of its own. One that has expired when it is stated lasts a moment."""
    lasts = F.greatest(F.unix_micros("expires_at") - F.unix_micros("at"), F.lit(1))
    rows = beliefs.where("expires_at is not null").withWatermark("at", "1 hour")
    spans = rows.groupBy("id", F.session_window("at", F.concat(lasts.cast("string"), F.lit(" microseconds")))).agg(F.max("expires_at").alias("expired_at"))
    return spans.select(F.col("id").cast("long").alias("id"), "expired_at")


def ingest_turns(stream: DataFrame, folder: str) -> DataFrame:
    """Each micro-batch of turns is compared with the items so far, gives edges to the best earlier item of its
    conversation, and then joins the items. Batches that are run again replace what they wrote."""
    from memlift.operators import retrieval as R

    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        items = batch.select("conv_id", F.col("id").alias("item_id"), F.col("text").alias("body"))
        items.write.mode("overwrite").parquet(f"{folder}/items/batch={number}")
        so_far = spark.read.option("basePath", f"{folder}/items").parquet(f"{folder}/items").where(F.col("batch") <= number).drop("batch")
        q = batch.select("conv_id", F.col("id").alias("q_id"), F.col("text").alias("question"))
        score = R.overlap_scores(q, so_far, ["conv_id"]).where("item_id < q_id")
        R.best(score, 1).select(F.col("q_id").alias("src"), F.col("item_id").alias("dst")).write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/edges").select("src", "dst")
