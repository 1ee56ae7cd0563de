"""Sinks: corpora by source, transcripts with manifests, verdicts, and insert-only publication."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_corpus(segments: DataFrame, events: DataFrame, path: str) -> None:
    """Segments by source; events clustered by conversation."""
    segments.write.mode("overwrite").partitionBy("source").parquet(f"{path}/segments")
    events.repartition("conversation_id").sortWithinPartitions("conversation_id", "seq").write.mode("overwrite").parquet(f"{path}/events")


def write_transcript(rows: DataFrame, manifest: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(f"{path}/transcript")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_verdicts(verdicts: DataFrame, summary: DataFrame, manifest: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").json(f"{path}/verdicts")
    kept = verdicts.sparkSession.read.schema(verdicts.schema).json(f"{path}/verdicts")
    kept.count()
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/judge")


class Publication:
    """An insert-only table in a shared folder, with commits that happen whole or not at all.

    Rows are written aside first, in a folder of their own that no reader looks into. Then they are held against what is
    published (an id that is there already, in the rows themselves or in the table, or a parent that isn't there, refuses
    the whole insert). Last, a commit file with the next number and the folder's name is put in its place by one rename that
    never replaces a file. If another writer took that number meanwhile, the rows are checked against the new state and the next
    number is tried. Readers see the folders that commits name, so a writer that dies leaves nothing visible."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri() if "://" in self.path else self._fs.getUri(), conf)

    def commits(self) -> list[str]:
        """The folders that commits name, in order; the next commit's number is their count."""
        if not self._fs.exists(self._path(f"{self.path}/commits")):
            return []
        rows = self.spark.read.text(f"{self.path}/commits").select(F.input_file_name().alias("file"), "value").collect()  # a line a commit
        return [r.value for r in sorted(rows, key=lambda r: r.file)]

    def read(self, schema: StructType | str) -> DataFrame:
        there = [f"{self.path}/rows/{name}" for name in self.commits()]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def insert(self, new: DataFrame, key: str, parents: DataFrame | Publication | None = None, parent: str | None = None) -> int:
        """Publishes the rows and returns how many. parents: where the ids in the column `parent` must stand as its first column, or
        a publication's rows by the same name; rows without a parent id need none."""
        name = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/rows/{name}")
        rows = self.spark.read.schema(new.schema).parquet(f"{self.path}/rows/{name}")
        try:
            n, ids = rows.agg(F.count("*"), F.countDistinct(key)).first()
            if ids != n:
                raise ValueError(f"{key} is null or repeated in the rows themselves")
            if parent is not None:
                known = parents.read(f"{parent} {new.schema[parent].dataType.simpleString()}") if isinstance(parents, Publication) else parents.select(F.col(parents.columns[0]).alias(parent))
                orphan = rows.where(F.col(parent).isNotNull()).join(known.select(parent).hint("merge"), parent, "left_anti").first()
                if orphan:
                    raise ValueError(f"{parent} {orphan[parent]} isn't published")
            seen = 0
            while True:
                done = self.commits()
                for part in done[seen:]:  # each commit is looked at once
                    if rows.join(self.spark.read.schema(new.schema).parquet(f"{self.path}/rows/{part}").select(key).hint("merge"), key, "left_semi").limit(1).count():
                        raise ValueError(f"{key} is there already")
                seen = len(done)
                if self._commit(seen, name):
                    return n
        except BaseException:
            self._fs.delete(self._path(f"{self.path}/rows/{name}"), True)
            raise

    def _commit(self, number: int, name: str) -> bool:
        """Whether this writer got the number. The file is written aside and renamed; a name that is taken is never replaced."""
        aside, commit = self._path(f"{self.path}/aside/{name}"), self._path(f"{self.path}/commits/{number:012d}")
        out = self._fs.create(aside, True)
        out.write(name.encode())
        out.close()
        self._fs.mkdirs(commit.getParent())
        sc = self.spark.sparkContext
        try:
            self._context.rename(aside, commit, sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(aside, False)
            return False
        return True
