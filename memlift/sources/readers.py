"""Sources: JSON lines, nested chats, CSV, logs, XML, whole files; all with given schemas, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string,time_anchor:string>"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are kept in _bad, or fail the read where strict."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their file and line (from 1), the schema's columns, and _bad, the text of lines that don't parse.

    Lines are numbered without sorting them: rows have their place in their part of a file, and the parts' sizes give the
    offsets."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id_"), "value").withColumn("part_", F.shiftright("id_", 33))
    parts = t.groupBy("file", "part_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy("file").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = t.join(parts.withColumn("before_", before).drop("n_").hint("broadcast"), ["file", "part_"])  # one row a part of a file
    x = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("file", (F.col("id_") - F.col("first_") + F.col("before_") + 1).alias("line"), x.alias("x_")).select("file", "line", "x_.*")


def scenarios(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(events, segments) of scenario documents with arrays of these names, each row with its document's key."""
    return docs.select(key, F.explode("events").alias("x")).select(key, "x.*"), docs.select(key, F.explode("segments").alias("x")).select(key, "x.*")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows with scenarios; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("type = 'result' and scenarios is not null")


def nested_chats(chats: DataFrame) -> DataFrame:
    """conversation_id, seq, role, text, ts, session_id from chat array<array<turn>>; seq runs over all sessions."""
    s = chats.select("conversation_id", F.posexplode("chat").alias("session_id", "turns"))
    t = s.select("conversation_id", "session_id", F.posexplode("turns").alias("ti", "t"))
    w = W.partitionBy("conversation_id").orderBy("session_id", "ti")
    return t.select("conversation_id", (F.row_number().over(w) - 1).alias("seq"), F.col("t.role").alias("role"), F.col("t.content").alias("text"), F.col("t.time_anchor").alias("ts"), "session_id")


def parallel_sessions(rows: DataFrame) -> DataFrame:
    """As nested_chats, from parallel arrays of sessions and dates."""
    z = rows.select("conversation_id", F.posexplode(F.arrays_zip("sessions", "dates")).alias("session_id", "z"))
    t = z.select("conversation_id", "session_id", F.col("z.dates").alias("ts"), F.posexplode("z.sessions").alias("ti", "t"))
    w = W.partitionBy("conversation_id").orderBy("session_id", "ti")
    return t.select("conversation_id", (F.row_number().over(w) - 1).alias("seq"), F.col("t.role").alias("role"), F.col("t.content").alias("text"), "ts", "session_id")


def probing_questions(rows: DataFrame) -> DataFrame:
    """conversation_id, ability, question, answer from a JSON column that is a map by ability or a list with abilities."""
    item = "struct<question:string,answer:string,ability:string>"
    by_key = F.from_json("probing", f"map<string,array<{item}>>")
    as_list = F.from_json("probing", f"array<{item}>")
    is_list = F.ltrim("probing").startswith("[")
    a = rows.where(~is_list).select("conversation_id", F.explode(by_key).alias("ability", "qs")).select("conversation_id", "ability", F.explode("qs").alias("q")).select("conversation_id", F.coalesce("ability", "q.ability").alias("ability"), "q.question", "q.answer")
    b = rows.where(is_list).select("conversation_id", F.explode(as_list).alias("q")).select("conversation_id", "q.ability", "q.question", "q.answer")
    return a.unionByName(b)


def append_missing(have: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """have, and of more the rows whose key have lacks."""
    return have.unionByName(more.join(have.select(key).distinct(), key, "left_anti"))


def log_levels(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path)
    level = F.regexp_extract("value", r"\b(INFO|WARN|ERROR)\b", 1)
    return t.select(F.when(level == "", "INFO").otherwise(level).alias("level"), F.col("value").alias("line"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """title, summary and up to four authors of each entry of a feed."""
    schema = "title string, summary string, author array<struct<name:string>>"
    x = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return x.select(F.trim("title").alias("title"), F.trim("summary").alias("summary"), F.slice(F.col("author.name"), 1, 4).alias("authors"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name and names of dependencies of a package manifest."""
    m = spark.read.schema("name string, dependencies map<string,string>").json(path, multiLine=True)
    return m.select("name", F.array_sort(F.map_keys("dependencies")).alias("dependencies"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, title (the first line of 8 characters or more) and body of each file."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 8)
    return t.select("path", F.get(lines, 0).alias("title"), "body")


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst between files (path, body): imports by a relative name of a file that is there."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.\w+$", "")
    named = files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)(?:from|import|require\()\s*['\"]?\.{0,2}/?([\w./-]+)"), F.lit(1))).alias("name"))
    own = files.select(F.col("path").alias("dst"), stem(F.col("path")).alias("stem"))
    return named.withColumn("stem", stem(F.col("name"))).hint("merge").join(own, "stem").where("src <> dst").select("src", "dst").distinct()


def published(rows: DataFrame, status: str, score: str, submitted: str, limit: int) -> DataFrame:
    """Published rows, best first: filter and limit reach the scan and the sort."""
    return rows.where(F.col(status) == "published").orderBy(F.desc(score), submitted).limit(limit)
