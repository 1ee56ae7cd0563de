"""Queries of sources and sinks: tables are written in the format in question to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.plans.registry import query, table
from memlift.sources import readers as R
from memlift.sources import sinks


def folder(spark) -> str:
    """A new folder where the cluster shares files, or a temporary one in local mode where spark.checkpoint.dir is unset."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    top = top or f"file://{tempfile.mkdtemp(prefix='memlift-')}"
    return f"{top.rstrip('/')}/memlift-{uuid.uuid4().hex}"


@query("select event_id // 1000 as part, row_number() over (partition by event_id // 1000 order by event_id) as line, case when event_id % 50 = 0 then null else event_id end as event_id, case when event_id % 50 = 0 then null else user_id end as user_id, case when event_id % 50 = 0 then '{broken ' || event_id::varchar || ' ' || user_id::varchar end as bad from events")
def src1_jsonl(spark, sf_dir):
    """Every fiftieth line is broken and must be kept with its text and its number in its file."""
    at = folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 1000).alias("part"))
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_id"), F.lit(" "), F.col("user_id"))).otherwise(F.to_json(F.struct("event_id", "user_id")))
    # one file a part, in order
    e.select("part", "event_id", line.alias("value")).repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(at)
    r = R.numbered_jsonl(spark, at, "event_id long, user_id long")
    return r.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", "event_id", "user_id", F.col("_bad").alias("bad"))


@query("select user_id, count(*) as scenarios from events where event_type = 'signup' and event_id % 7 <> 0 group by user_id")
def src2_journal(spark, sf_dir):
    at = folder(spark)
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.when(F.col("event_type") == "signup", "result").otherwise("log").alias("type"), "user_id", F.array("event_id").alias("scenarios")))
    e.select(F.when(F.col("event_id") % 7 == 0, "{not json").otherwise(line).alias("value")).write.text(at)
    j = R.journal(spark, at, "type string, user_id long, scenarios array<long>")
    return j.groupBy("user_id").agg(F.sum(F.size("scenarios")).alias("scenarios"))


_NESTED = "select conv_id as conversation_id, row_number() over (partition by conv_id order by turn) - 1 as seq, role, md5(text) as text_md5, turn // 4 as session_id from conversations"


def chats(spark, sf_dir):
    """Conversations nested in sessions of four turns."""
    t = table(spark, sf_dir, "conversations").withColumn("session", F.floor(F.col("turn") / 4))
    turn = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("time_anchor"))
    s = t.groupBy("conv_id", "session").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["time_anchor"].alias("time_anchor")))
    s = s.select("conv_id", "session", plain.alias("turns"))
    per = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("session", "turns"))).alias("x"))
    return per.select(F.col("conv_id").alias("conversation_id"), F.transform("x", lambda y: y["turns"]).alias("chat"), F.transform("x", lambda y: y["session"].cast("string")).alias("dates"))


@query(_NESTED)
def src3_nested_chats(spark, sf_dir):
    at = folder(spark)
    chats(spark, sf_dir).select("conversation_id", "chat").write.parquet(at)
    return R.nested_chats(spark.read.parquet(at)).select("conversation_id", F.col("seq").cast("long").alias("seq"), "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("session_id").cast("long").alias("session_id"))


@query("select conv_id as conversation_id, case when conv_id % 2 = 0 then 'recall' else 'order' end as ability, count(*) as n from conversations where role = 'user' group by all")
def src4_probing(spark, sf_dir):
    """Questions as a map by ability in even conversations, as a list in odd ones."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text").alias("question"), F.lit("a").alias("answer"), F.lit("order").alias("ability"))).alias("qs"))
    probing = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"recall": '), F.to_json("qs"), F.lit("}"))).otherwise(F.to_json("qs"))
    p = R.probing_questions(q.select(F.col("conv_id").alias("conversation_id"), probing.alias("probing")))
    return p.groupBy("conversation_id", "ability").agg(F.count("*").alias("n"))


@query(_NESTED + "")
def src5_parallel_arrays(spark, sf_dir):
    at = folder(spark)
    chats(spark, sf_dir).select("conversation_id", F.col("chat").alias("sessions"), "dates").write.json(at)
    r = spark.read.schema(f"conversation_id long, sessions array<array<{R.TURN}>>, dates array<string>").json(at)
    return R.parallel_sessions(r).select("conversation_id", F.col("seq").cast("long").alias("seq"), "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("session_id").cast("long").alias("session_id"))


@query(
    "select conv_id as conversation_id, 'event' as kind, turn as seq, role, md5(text) as body from conversations union all select conv_id, 'segment', turn, 'ability ' || (turn % 3)::varchar, md5(text || ' -> ' || nxt) from (select *, lead(text) over w as nxt, lead(role) over w as nrole from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nrole = 'assistant'"
)
def src6_scenarios(spark, sf_dir):
    """Scenario documents, one a conversation with its questions and its turns, written as JSON and flattened to events and
    segments by two explodes of one scan."""
    at, w = folder(spark), W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(w)).withColumn("nrole", F.lead("role").over(w))
    asks = F.when((F.col("role") == "user") & (F.col("nrole") == "assistant"), F.struct(F.concat(F.lit("ability "), (F.col("turn") % 3).cast("string")).alias("ability"), F.col("text").alias("question"), F.col("nxt").alias("gold"), F.col("turn").alias("at")))
    doc = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("events"), F.array_sort(F.array_compact(F.collect_list(asks))).alias("segments"))
    doc.write.json(at)
    r = spark.read.schema("conv_id long, events array<struct<turn:long,role:string,text:string>>, segments array<struct<ability:string,question:string,gold:string,at:long>>").json(at)
    events, segments = R.scenarios(r, "conv_id")
    md5 = lambda x: F.md5(x.cast("binary")).alias("body")
    a = events.select(F.col("conv_id").alias("conversation_id"), F.lit("event").alias("kind"), F.col("turn").alias("seq"), "role", md5(F.col("text")))
    b = segments.select(F.col("conv_id").alias("conversation_id"), F.lit("segment").alias("kind"), F.col("at").alias("seq"), F.col("ability").alias("role"), md5(F.concat_ws(" -> ", "question", "gold")))
    return a.unionByName(b)


@query("select lang, source from documents where doc_id % 2 = 0 group by all union select lang, source from (select distinct lang, source from documents where lang not in (select lang from documents where doc_id % 2 = 0))")
def src7_append_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    have, more = d.where("doc_id % 2 = 0").select("lang", "source").distinct(), d.select("lang", "source").distinct()
    return R.append_missing(have, more, "lang")


@query("select count(*) as n, round(avg(p_retailprice), 4) as mean_price, max(p_size) as largest from part")
def src8_csv(spark, sf_dir):
    at = folder(spark)
    table(spark, sf_dir, "part").write.option("header", True).csv(at)
    p = spark.read.schema(table(spark, sf_dir, "part").schema).csv(at, header=True)
    return p.agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.max("p_size").alias("largest"))


@query("select case event_type when 'error' then 'ERROR' when 'view' then 'WARN' else 'INFO' end as level, count(*) as n from events group by all")
def src9_log(spark, sf_dir):
    at = folder(spark)
    level = F.when(F.col("event_type") == "error", " ERROR ").when(F.col("event_type") == "view", " WARN ").otherwise(" ")
    table(spark, sf_dir, "events").select(F.concat(F.col("ts").cast("string"), level, F.lit("user "), F.col("user_id").cast("string")).alias("value")).write.text(at)
    return R.log_levels(spark, at).groupBy("level").agg(F.count("*").alias("n"))


@query("select s_name as title, 2 as authors from supplier")
def src10_atom(spark, sf_dir):
    at = folder(spark)
    name = lambda x: F.struct(F.lit(x).alias("name"))
    e = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.lit("s").alias("summary"), F.array(name("a"), name("b")).alias("author"))
    e.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(at)
    return R.atom_entries(spark, at).select("title", F.size("authors").alias("authors"))


@query("select n_name as name, count(*) as dependencies from nation join supplier on s_nationkey = n_nationkey group by n_name")
def src11_json_document(spark, sf_dir):
    at = folder(spark)
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = j.groupBy(F.col("n_name").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("s_name", F.lit("1.0").alias("v")))).alias("dependencies"))
    m.write.json(at)
    one = spark.read.schema("name string, dependencies map<string,string>").json(at)
    return one.select("name", F.size(F.map_keys("dependencies")).cast("long").alias("dependencies"))


@query("select count(*) as files from (select distinct n_name from nation)")
def src12_whole_files(spark, sf_dir):
    """One file a nation; the first long line is its title."""
    at = folder(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.concat(F.lit("x\n"), F.col("n_name"), F.lit(" is a nation\nend")).alias("value"))
    n.repartition(F.col("k")).write.partitionBy("k").text(at)
    return R.whole_files(spark, f"{at}/*").where("title is not null").agg(F.count("*").alias("files"))


@query("select n_nationkey::varchar as src, ((n_nationkey + 1) % 25)::varchar as dst from nation")
def src13_import_edges(spark, sf_dir):
    """Each file imports the next one."""
    nxt = (F.col("n_nationkey") + 1) % 25
    f = table(spark, sf_dir, "nation").select(F.concat(F.lit("lib/m"), F.col("n_nationkey"), F.lit(".py")).alias("path"), F.concat(F.lit("import ./m"), nxt, F.lit("\n")).alias("body"))
    e = R.import_edges(f)
    num = lambda c: F.regexp_extract(c, r"m(\d+)", 1)
    return e.select(num("src").alias("src"), num("dst").alias("dst"))


@query("select s_suppkey, s_acctbal from supplier where s_nationkey % 2 = 0 order by s_acctbal desc, s_suppkey limit 20")
def src14_published(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("status", F.when(F.col("s_nationkey") % 2 == 0, "published").otherwise("draft"))
    return R.published(s, "status", "s_acctbal", "s_suppkey", 20).select("s_suppkey", "s_acctbal")


@query("select source, count(*) as n from documents group by source")
def snk1_corpus(spark, sf_dir):
    at = folder(spark)
    d = table(spark, sf_dir, "documents")
    sinks.write_corpus(d.select("doc_id", "source", "lang"), d.select(F.col("doc_id").alias("conversation_id"), F.lit(0).alias("seq"), "n_chars"), at)
    return spark.read.parquet(f"{at}/segments").groupBy("source").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n from events group by event_type")
def snk2_transcript(spark, sf_dir):
    at = folder(spark)
    e = table(spark, sf_dir, "events")
    sinks.write_transcript(e, e.agg(F.count("*").alias("rows")), at)
    return spark.read.schema("event_type string").json(f"{at}/transcript").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def snk3_verdicts(spark, sf_dir):
    at = folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_verdicts(o, o.groupBy("o_orderstatus").count(), o.agg(F.count("*").alias("rows")), at)
    return spark.read.schema("o_orderstatus string, count long").json(f"{at}/summary").select("o_orderstatus", F.col("count").alias("n"))


@query("select count(*) as n, (select count(*) from orders where o_custkey in (select c_custkey from customer where c_custkey % 2 = 0)) as children, true as refused, true as orphans_refused from customer")
def snk4_publish(spark, sf_dir):
    """Customers are published in two halves, and orders as their children: those of the first half while only it is there, where all
    orders are refused for parents that are missing. An insert with known ids is refused whole."""
    at = folder(spark)
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    parents, children = sinks.Publication(spark, f"{at}/customers"), sinks.Publication(spark, f"{at}/orders")

    def refused(publication, *given) -> bool:
        try:
            publication.insert(*given)
        except ValueError:
            return True
        return False

    parents.insert(c.where("c_custkey % 2 = 0"), "c_custkey")
    orphans = refused(children, o, "o_orderkey", parents, "c_custkey")
    children.insert(o.where("c_custkey % 2 = 0"), "o_orderkey", parents, "c_custkey")
    parents.insert(c.where("c_custkey % 2 = 1"), "c_custkey")
    again = refused(parents, c.where("c_custkey % 3 = 0"), "c_custkey")
    held = children.read(o.schema).count()
    return parents.read(c.schema).agg(F.count("*").alias("n")).select("n", F.lit(held).cast("long").alias("children"), F.lit(again).alias("refused"), F.lit(orphans).alias("orphans_refused"))
