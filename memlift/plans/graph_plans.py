"""Queries of graphs and integrity."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.operators import graph as G
from memlift.plans.registry import query, table
from memlift.plans.source_plans import folder

# user by user: an edge from a value's number to the next one's
_E = "select user_id as g, k as src, nk as dst, event_id as seq from (select user_id, event_id, json_extract_string(props, '$.k')::bigint as k, lead(json_extract_string(props, '$.k')::bigint) over (partition by user_id order by event_id) as nk from events) where nk is not null and k <> nk"
# edges of a sparser graph, which closes a loop late or never
_SPARSE = f"select * from ({_E}) where src % 10 < dst % 10 or (src + dst) % 5 = 0"


def edges(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), k.alias("src"), F.lead(k).over(W.partitionBy("user_id").orderBy("event_id")).alias("dst"), F.col("event_id").alias("seq"))
    return e.where("dst is not null and src <> dst")


@query(f"with recursive e as (select * from ({_SPARSE})), r as (select g, seq, src, dst as node from e union select r.g, r.seq, r.src, e.dst from r join e on e.g = r.g and e.src = r.node and e.seq < r.seq) select g, min(seq) as closing from r where src = node group by g")
def gr1_cycles(spark, sf_dir):
    """Graphs that hold a cycle, and the edge that closed the first one. The graph is sparse, so that loops close late or never."""
    return G.closing_edges(edges(spark, sf_dir).where("src % 10 < dst % 10 or (src + dst) % 5 = 0"))


# Edges that follow each other without a break are a walk, and a walk that comes to a node of its own again has made a loop: later
# edges of the graph can't close the first one. Where no walk does, all edges are looked at.
_LOOPED = "c as (select *, sum(broken) over (partition by g order by seq) as run from (select *, (lag(dst) over (partition by g order by seq) is distinct from src)::int as broken from e)), n as (select a.g, min(a.seq) as last from c a join c b on a.g = b.g and a.run = b.run and a.dst = b.src and b.seq < a.seq group by a.g)"


@query(f"with recursive e as (select * from ({_E})), {_LOOPED}, f as (select e.* from e left join n using (g) where seq <= coalesce(last, seq)), r as (select g, seq, src, dst as node from f union select r.g, r.seq, r.src, f.dst from r join f on f.g = r.g and f.src = r.node and f.seq < r.seq) select g, min(seq) as closing from r where src = node group by g")
def gr1_cycles_whole(spark, sf_dir):
    """The same over all edges."""
    return G.closing_edges(edges(spark, sf_dir))


_DAG = "select o_custkey as g, a as src, b as dst from (select o_custkey, o_orderkey as a, lead(o_orderkey, 1) over w as b, lead(o_orderkey, 3) over w as c from orders window w as (partition by o_custkey order by o_orderkey)) where b is not null union select o_custkey, a, c from (select o_custkey, o_orderkey as a, lead(o_orderkey, 3) over w as c from orders window w as (partition by o_custkey order by o_orderkey)) where c is not null"


@query(f"with recursive e as (select distinct * from ({_DAG})), r as (select g, src as node, 0 as level from e where src not in (select dst from e) union all select e.g, e.dst, r.level + 1 from r join e on r.g = e.g and r.node = e.src where e.dst = (select min(x.dst) from e x where x.src = e.src)) select g, node, max(level)::int as level from r group by g, node")
def gr2_levels(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders")
    e = [o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("src"), F.lead("o_orderkey", n).over(w).alias("dst")).where("dst is not null") for n in (1, 3)]
    return G.levels(e[0].unionByName(e[1]))


@query("select g, node as terminal from (select o_custkey as g, max(o_orderkey) as node, count(*) as n from orders group by o_custkey) where n > 1")
def gr3_terminal(spark, sf_dir):
    """Where each customer's chain of orders ends."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")
    h = G.heads(o.select("src", "dst"))
    return o.join(h, o["src"] == h["id"]).groupBy("g").agg(F.max("head").alias("terminal"))


@query("select o_orderkey as id, max(o_orderkey) over (partition by o_custkey) as head from orders qualify o_orderkey <> max(o_orderkey) over (partition by o_custkey)")
def gr4_heads(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")
    return G.heads(e)


@query(f"select node, count(*) as degree from (select src as node from ({_E}) union all select dst from ({_E})) group by node")
def gr5_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query("select l_partkey, max_by(l_returnflag, [verified, ups, -ascii(l_returnflag)]) as choice from (select l_partkey, l_returnflag, max((l_tax > 0.07)::int) as verified, count(distinct l_suppkey) as ups from lineitem group by all) group by l_partkey")
def gr6_trust(spark, sf_dir):
    """A verified claim beats any number of mirrors; mirrors of one supplier count once."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max((F.col("l_tax") > 0.07).cast("int")).alias("verified"), F.countDistinct("l_suppkey").alias("ups"))
    return c.groupBy("l_partkey").agg(F.max_by("l_returnflag", F.struct("verified", "ups", -F.ascii("l_returnflag"))).alias("choice"))


@query("select user_id, max_by(value, event_id) filter (event_type <> 'error') as official from events group by user_id")
def gr7_official(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.when(F.col("event_type") != "error", F.col("event_id"))).alias("official"))


@query("select c_custkey, coalesce(max(o_orderpriority) filter (o_orderstatus = 'P'), 'UNKNOWN') as answer from customer left join orders on c_custkey = o_custkey group by c_custkey")
def gr8_exact_or_unknown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit("UNKNOWN")).alias("answer"))


_CHAIN = "select distinct 'chain' as kind, src, dst from (select *, lag(l_orderkey) over w as src, l_orderkey as dst, row_number() over w as n from (select distinct l_partkey, l_orderkey from lineitem) window w as (partition by l_partkey order by l_orderkey)) where n > 1 and n <= 6 and src <> dst"
_TOPIC = "select distinct 'supports' as kind, a.l_orderkey as src, b.l_orderkey as dst from (select * from lineitem where l_returnflag = 'R') a join (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as n from lineitem where l_returnflag = 'A') b on a.l_suppkey = b.l_suppkey and b.n <= 2 where a.l_orderkey <> b.l_orderkey"


@query(f"select kind, count(*) as n from (({_CHAIN}) union all ({_TOPIC})) group by kind")
def gr9_tag_edges(spark, sf_dir):
    """Chains of orders that share a part, and edges from a supplier's returned lines to its first two accepted ones."""
    lines = table(spark, sf_dir, "lineitem")
    chain = G.tag_edges(lines.select("l_partkey", "l_orderkey", F.col("l_orderkey").alias("ord")), "l_orderkey", "l_partkey", "ord")
    items = lines.select("l_orderkey", "l_suppkey", "l_returnflag", F.struct("l_orderkey", "l_linenumber").alias("ord"))
    topic = G.group_edges(items, "l_orderkey", "l_suppkey", "ord", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", 2, "supports")
    return chain.unionByName(topic).groupBy("kind").agg(F.count("*").alias("n"))


def customer_leaves(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.concat_ws("|", "c_name", "c_mktsegment").alias("body"))


_LEAVES = "select list(sha256('\\x00'::blob || encode(concat_ws('|', c_name, c_mktsegment))) order by c_custkey) as h from customer"
_PAIR = "list_transform(range(1, len(h) + 1, 2), lambda i: case when i + 1 <= len(h) then sha256('\\x01'::blob || unhex(h[i]) || unhex(h[i + 1])) else h[i] end)"


@query(f"with recursive m as ({_LEAVES} union all select {_PAIR} from m where len(h) > 1) select h[1] as root from m where len(h) = 1")
def int1_merkle_root(spark, sf_dir):
    return G.merkle_levels(customer_leaves(spark, sf_dir))[-1].select(F.col("hash").alias("root"))


@query(
    "with recursive p as (select c_custkey as idx, c_custkey as spot, count(*) over () as n, 0 as steps from customer union all select idx, spot // 2, (n + 1) // 2, steps + (xor(spot, 1) < n)::int from p where n > 1) "
    "select idx, true as verified, steps from p where n = 1"
)
def int2_inclusion(spark, sf_dir):
    return G.inclusion(G.merkle_levels(customer_leaves(spark, sf_dir)))


@query("select case_, m as rows_before, consistent, rows_after, absent from (values ('appended', true), ('rewritten', false)) t(case_, consistent), (select count(*) as rows_after, count(*) // 2 as m from customer), (select count(*) as absent from supplier where s_suppkey not in (select c_custkey from customer where c_custkey < (select count(*) // 2 from customer)))")
def int3_append_only(spark, sf_dir):
    """The root over the first half of the rows is stored, then the other half comes: appended rows keep the root, a row
    rewritten in the old half doesn't. absent: ids that the old half, by its sorted rows, can't have held."""
    all_, at = customer_leaves(spark, sf_dir), folder(spark)
    old = all_.where(F.col("idx") < all_.count() // 2)
    G.merkle_levels(old)[-1].select(F.col("hash").alias("root")).crossJoin(F.broadcast(old.agg(F.count("*").alias("rows_before")))).write.parquet(at)  # one row each
    stored = spark.read.schema("root string, rows_before long").parquet(at)
    tampered = all_.withColumn("body", F.when(F.col("idx") == 3, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    absent = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx")).join(old.select("idx"), "idx", "left_anti").agg(F.count("*").alias("absent"))
    both = G.consistent_prefix(all_, stored).withColumn("case_", F.lit("appended")).unionByName(G.consistent_prefix(tampered, stored).withColumn("case_", F.lit("rewritten")))
    return both.crossJoin(F.broadcast(absent)).select("case_", "rows_before", "consistent", "rows_after", "absent")  # one row


@query("select c_custkey, sha256(c_name) = sha256(case when c_custkey % 97 = 0 then lower(c_name) else c_name end) as revealed from customer")
def int4_commit_reveal(spark, sf_dir):
    body = F.when(F.col("c_custkey") % 97 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
    h = lambda c: F.sha2(c.cast("binary"), 256)
    return table(spark, sf_dir, "customer").select("c_custkey", (h(F.col("c_name")) == h(body)).alias("revealed"))


@query("select source, sha256(string_agg(doc_id::varchar, chr(10) order by doc_id)) as digest from documents group by source")
def int5_selection_digest(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.array_join(ids, "\n").cast("binary"), 256).alias("digest"))


@query("select count(*) as n, count(*) filter (length(text) = n_chars) as same, count(*) filter (regexp_matches(text, '[^\\x00-\\x7F]')) as non_ascii from documents")
def int6_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.length("text") == F.col("n_chars")).alias("same"), F.count_if(F.col("text").rlike(r"[^\x00-\x7F]")).alias("non_ascii"))


@query("select o_custkey, string_agg(o_orderkey::varchar, '>' order by o_orderkey) as line from orders group by o_custkey")
def top6_topological_order(spark, sf_dir):
    """The one order of a customer's chain of orders, by levels; a single order is its own."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("node"), F.lead("o_orderkey").over(w).alias("dst"))
    lev = G.levels(o.where("dst is not null").select("g", F.col("node").alias("src"), "dst"))
    every = o.select("g", "node").join(lev, ["g", "node"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct("level", "node")))
    return every.groupBy(F.col("g").alias("o_custkey")).agg(F.array_join(F.transform(rows, lambda x: x["node"].cast("string")), ">").alias("line"))
