"""Queries of joins, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlift.operators import graph as G
from memlift.operators import joins as J
from memlift.operators import sampling as S
from memlift.plans.registry import query, table

# Area names by number, and the names that a label may begin with, in order of trial.
AREAS = (
    "adoption attribution anteriority authority reader-independence contradiction set-integrity calibration reactivity concurrency supersession "
    "temporality deep-contradiction retrieval-fidelity adversarial-robustness endurance federation modality"
).split()
NAMED = (
    "adoption attribution anteriority authority reader-independence supersession set-integrity calibration reactivity temporality modality concurrency "
    "endurance federation deep-contradiction retrieval-fidelity adversarial contradiction"
).split()
TRIPWIRES = ("abstention", "contradiction-resolution", "knowledge-update", "belief-revision-audit", "trust-discrimination", "poisoned-memory-quarantine")
HITS = "(select event_id, user_id, value from events where value > 50)"


@query("select event_id, c_name, value from events join customer on user_id = c_custkey where value > 50")
def jn1_hits_to_rows(spark, sf_dir):
    hits = table(spark, sf_dir, "events").where("value > 50")
    return hits.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "value")


@query("select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderkey) as n from customer left join orders on c_custkey = o_custkey) where n <= 5")
def jn2_left_expand(spark, sf_dir):
    from memlift.operators.windows import top_k

    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"]), F.col("c_custkey") == F.col("o_custkey"), "left")
    return top_k(j, "c_custkey", [F.asc("o_orderkey")], 5).select("c_custkey", "o_orderkey")


@query("select o_orderkey, l_linenumber, l_partkey from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'")
def jn4_support_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")


@query("select event_id, user_id from events e where not exists (select 1 from (select lag(event_id) over (partition by user_id, event_type order by event_id) as dst from events) s where s.dst = e.event_id)")
def jn5_heads_only(spark, sf_dir):
    """Each event supersedes the one of its user and type before."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    edges = e.select(F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("event_id")).alias("dst")).where("dst is not null")
    return J.heads_only(e.select("event_id", "user_id"), edges, "event_id")


@query("select h.event_id, f.event_id as later from events h join events f on h.user_id = f.user_id and f.event_type = 'error' and f.event_id > h.event_id where h.event_type = 'signup'")
def jn6_concerns(spark, sf_dir):
    """Errors that come after a sign-up of the same user concern it."""
    e = table(spark, sf_dir, "events")
    h = e.where("event_type = 'signup'").select("user_id", "event_id")
    f = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("later"))
    return h.join(f, "user_id").where("later > event_id").select("event_id", "later")


_PATH = r"regexp_replace(url, '^https?://|[?#].*$', '', 'g')"


@query(
    f"""with p as (select page_id, {_PATH} as path from pages), r as (select distinct string_split(path, '/')[1] as prefix from p union select distinct string_split(path, '/')[1] || '/' || string_split(path, '/')[2] from p where page_id % 3 = 0 and string_split(path, '/')[2] is not null)
select page_id, coalesce(max_by('db:' || prefix, length(prefix)), 'default') as db from p left join r on path = prefix or starts_with(path, prefix || '/') group by page_id"""
)
def jn7_nearest_ancestor(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    parts = F.split("path", "/")
    r = p.select(parts[0].alias("prefix")).unionByName(p.where("page_id % 3 = 0").where(F.size(parts) > 1).select(F.concat_ws("/", parts[0], F.get(parts, 1)).alias("prefix"))).distinct()
    return J.nearest_ancestor(p, "path", r.withColumn("db", F.concat(F.lit("db:"), "prefix")), "prefix", "db", "default", "page_id")


@query("select coalesce(o_orderkey, l_orderkey) as k, case when l_orderkey is null then 'missing' when o_orderkey is null then 'extra' when na > 1 or nb > 1 then 'repeated' else 'both' end as state from (select o_orderkey, count(*) as na from orders group by all) full join (select l_orderkey, count(*) as nb from lineitem group by all) on o_orderkey = l_orderkey")
def jn8_alignment(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return J.align(a, b, ["k"])


@query("select event_id, coalesce(c_name, s_name) as parent, (c_name is null) = (s_name is null) as faulty from events left join customer on user_id = c_custkey and event_id % 2 = 0 left join supplier on user_id = s_suppkey and event_id % 2 = 1")
def jn9_one_parent(spark, sf_dir):
    """Exactly one of two parents is expected; anything else is a fault."""
    e, c, s = (table(spark, sf_dir, n) for n in ("events", "customer", "supplier"))
    j = e.join(c, (F.col("user_id") == F.col("c_custkey")) & (F.col("event_id") % 2 == 0), "left").join(s, (F.col("user_id") == F.col("s_suppkey")) & (F.col("event_id") % 2 == 1), "left")
    return j.select("event_id", F.coalesce("c_name", "s_name").alias("parent"), (F.col("c_name").isNull() == F.col("s_name").isNull()).alias("faulty"))


@query("select c_custkey, d as at, (select o_totalprice from orders o where o.o_custkey = c.c_custkey and o_orderdate <= d order by o_orderdate desc, o_orderkey desc limit 1) as as_of from customer c, (values (timestamp '1995-01-01'), (timestamp '1997-06-15'), (timestamp '1999-12-31')) t(d)")
def jn10_as_of(spark, sf_dir):
    """The price of a customer's order in effect at three times; orders with one date go by number."""
    times = F.array(*(F.lit(d).cast("timestamp_ntz") for d in ("1995-01-01", "1997-06-15", "1999-12-31")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.explode(times).alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("since"), "o_orderkey", "o_totalprice")
    c = c.withColumn("when", F.col("at"))
    return J.as_of(c, o, "c_custkey", "when", "since", "o_orderkey", "o_totalprice").select("c_custkey", "at", "as_of")


@query(
    "with recursive link as (select 's' || s_suppkey::varchar as src, 'n' || s_nationkey::varchar as dst from supplier union all select 'n' || n_nationkey::varchar, 'r' || n_regionkey::varchar from nation union all select 'c' || c_custkey::varchar, case when c_custkey % 3 = 0 then 'n' || c_nationkey::varchar else 'c' || (c_custkey - 1)::varchar end from customer where c_custkey > 0), "
    "walk as (select src, dst, 1 as hops from link union all select w.src, l.dst, w.hops + 1 from walk w join link l on l.src = w.dst) select src, max_by(dst, hops) as terminal, max(hops)::bigint as hops from walk group by src"
)
def jn11_chain(spark, sf_dir):
    """Links of several tables, followed until each chain ends: suppliers to nations to regions, and customers that refer to
    the one before or to a nation."""
    one = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    s = table(spark, sf_dir, "supplier").select(one("s", "s_suppkey").alias("src"), one("n", "s_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(one("n", "n_nationkey").alias("src"), one("r", "n_regionkey").alias("dst"))
    before = F.concat(F.lit("c"), (F.col("c_custkey") - 1).cast("string"))
    c = table(spark, sf_dir, "customer").where("c_custkey > 0").select(one("c", "c_custkey").alias("src"), F.when(F.col("c_custkey") % 3 == 0, one("n", "c_nationkey")).otherwise(before).alias("dst"))
    return G.heads(s.unionByName(n).unionByName(c), with_hops=True).select(F.col("id").alias("src"), F.col("head").alias("terminal"), "hops")


#: A knowledge base: what family a kind of part belongs to. A fixed table.
_KB = (("ring", "jewel"), ("bolt", "fastener"), ("gear", "machine"), ("widget", "machine"))
_KB_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _KB) + ") kb(member, family)"


@query(
    f"select o_orderkey, count(*) as facts, count(*) filter (hit) as contradicted, min(why) filter (hit) as why from (select *, why is not null as hit from (select o_orderkey, case when belief = 'class' and family = 'machine' then 'class' when belief = 'budget' and l_extendedprice > 50000 then 'budget' when belief = 'place' and s_nationkey <> c_nationkey then 'place' end as why "
    f"from (select *, case o_orderkey % 3 when 0 then 'class' when 1 then 'budget' else 'place' end as belief from orders) join customer on o_custkey = c_custkey join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey left join {_KB_SQL} on member = string_split(p_name, ' ')[-1])) group by o_orderkey"
)
def jn12_entailment(spark, sf_dir):
    """Each order holds a belief: against a class of materials (by the knowledge base), a budget, or a place. Its lines are
    facts; those that entail the contrary contradict it."""
    kb = spark.createDataFrame(_KB, "member string, family string")
    belief = F.when(F.col("o_orderkey") % 3 == 0, "class").when(F.col("o_orderkey") % 3 == 1, "budget").otherwise("place")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", belief.alias("belief")).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("member")).join(F.broadcast(kb), "member", "left")  # five rows
    j = lines.join(o, "o_orderkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(part, "p_partkey")
    is_ = lambda b: F.col("belief") == b
    why = F.when(is_("class") & (F.col("family") == "machine"), "class").when(is_("budget") & (F.col("l_extendedprice") > 50000), "budget").when(is_("place") & (F.col("s_nationkey") != F.col("c_nationkey")), "place")
    return j.groupBy("o_orderkey").agg(F.count("*").alias("facts"), F.count(why).alias("contradicted"), F.min(why).alias("why"))


@query("select l_partkey, min(l_returnflag) as low, max(l_returnflag) as high, count(distinct l_returnflag) as n_values, count(distinct l_suppkey) as n_sources from lineitem group by l_partkey having count(distinct l_returnflag) > 1 and count(distinct l_suppkey) > 1")
def jn13_conflicts(spark, sf_dir):
    return J.conflicts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


_W = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) >= 3)"


@query(f"select p_partkey, t.kind from part, (select distinct lower(string_split(p_type, ' ')[1]) || ' ' || lower(string_split(p_name, ' ')[1]) as kind from part) t where contains(lower(p_name), t.kind) or contains(t.kind, lower(p_name)) or list_has_any({_W('p_name')}, {_W('t.kind')})")
def jn14_attribute_match(spark, sf_dir):
    """Parts and attributes (kind and first word of names) that share a word or contain one another. Each word and each whole
    attribute is a key; containment inside a word takes the attributes' words against the parts', both distinct."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.element_at(F.split("p_type", " "), 1)).alias("k"))
    kinds = p.select(F.concat_ws(" ", "k", F.element_at(F.split("name", " "), 1)).alias("kind")).distinct()
    return J.attribute_matches(p, "p_partkey", "name", kinds, "kind")


@query("select c_custkey, coalesce(bool_or(rank <= 3), false) as served from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) on c_custkey = o_custkey and o_orderpriority = '1-URGENT' group by c_custkey")
def jn15_target_in_pool(spark, sf_dir):
    from memlift.operators.windows import top_k

    best = top_k(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("served", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").withColumn("served", F.coalesce("served", F.lit(False)))


@query("select conv_id, turn, coalesce(nullif(case when turn % 3 = 0 then '' else role end, ''), nullif(case when turn % 2 = 0 then 'speaker' else '' end, ''), 'from') as speaker, coalesce(nullif('', ''), text) as body from conversations")
def prj1_first_non_empty(spark, sf_dir):
    full = lambda c: F.nullif(c, F.lit(""))
    role = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role"))
    other = F.when(F.col("turn") % 2 == 0, "speaker").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(full(role), full(other), F.lit("from")).alias("speaker"), F.coalesce(full(F.lit("")), "text").alias("body"))


@query("select event_id, case when contains(event_type, 'error') or ends_with(event_type || '_' || user_id::varchar, '_7') then 'abstention' else 'novel' end as tag from events")
def prj2_tag(spark, sf_dir):
    t = F.col("event_type").contains("error") | F.concat_ws("_", "event_type", F.col("user_id").cast("string")).endswith("_7")
    return table(spark, sf_dir, "events").select("event_id", F.when(t, "abstention").otherwise("novel").alias("tag"))


_LABEL = "case event_id % 4 when 0 then 'Area ' || (event_id % 20)::varchar || ' notes' when 1 then (" + str(NAMED).replace("'", "''").replace('"', "'").replace("''", "'") + ")[(event_id % 18 + 1)::int] || ' checks' when 2 then '' else event_type || ' of day' end"


@query(
    f"with a as (select event_id, lower({_LABEL}) as label from events) select event_id, coalesce(case when regexp_extract(label, '\\b(\\d{{1,2}})\\b', 1) <> '' then ({AREAS})[regexp_extract(label, '\\b(\\d{{1,2}})\\b', 1)::int + 1] end, "
    + "case "
    + " ".join(f"when starts_with(label, '{n}') then '{'adversarial-robustness' if n == 'adversarial' else n}'" for n in NAMED)
    + " end, nullif(trim(regexp_replace(label, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'area') as ability from a"
)
def prj3_ability(spark, sf_dir):
    """Area number first, then a name the label begins with, then a slug."""
    e = F.col("event_id")
    label = F.when(e % 4 == 0, F.concat(F.lit("Area "), (e % 20).cast("string"), F.lit(" notes")))
    label = label.when(e % 4 == 1, F.concat(F.element_at(F.array(*(F.lit(n) for n in NAMED)), (e % 18 + 1).cast("int")), F.lit(" checks"))).when(e % 4 == 2, "").otherwise(F.concat("event_type", F.lit(" of day")))
    low = F.lower(label)
    number = F.regexp_extract(low, r"\b(\d{1,2})\b", 1)
    by_number = F.when(number != "", F.get(F.array(*(F.lit(a) for a in AREAS)), number.cast("int")))
    named = F.lit(None).cast("string")
    for n in reversed(NAMED):
        named = F.when(low.startswith(n), "adversarial-robustness" if n == "adversarial" else n).otherwise(named)
    slug = F.trim(F.regexp_replace(low, "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(by_number, named, F.nullif(slug, F.lit("")), F.lit("area")).alias("ability"))


@query("select user_id, count(*) filter (event_type = 'error') as n_model, count(*) filter (event_type <> 'error') as n_external from events group by user_id")
def prj4_provenance(spark, sf_dir):
    """Items of a user with their origin: external unless said to be a model's."""
    items = F.collect_list(F.struct("event_id", F.when(F.col("event_type") == "error", "model").alias("origin")))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(items.alias("items"))
    norm = F.transform("items", lambda x: F.struct(x["event_id"], F.coalesce(x["origin"], F.lit("external")).alias("origin")))
    u = u.select("user_id", norm.alias("items"))
    count = lambda o: F.size(F.filter("items", lambda x: x["origin"] == o)).cast("long")
    return u.select("user_id", count("model").alias("n_model"), count("external").alias("n_external"))


@query("select o_orderkey, l_partkey, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey) - 1 as context_index from orders join lineitem on o_orderkey = l_orderkey")
def prj5_served_items(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    per = j.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return per.select("o_orderkey", F.posexplode("items").alias("context_index", "x")).select("o_orderkey", F.col("x.l_partkey").alias("l_partkey"), F.col("context_index").cast("long").alias("context_index"))


@query("select o_orderkey from orders where o_orderstatus <> 'F' and (o_orderkey % 3 = 0 or o_orderdate > timestamp '1997-01-01')")
def flt1_active(spark, sf_dir):
    """Not deleted, and no expiry or one to come."""
    expires = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & (expires.isNull() | (expires > F.lit("1997-01-01").cast("timestamp_ntz")))).select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'")
def flt2_status_validity(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'P') and o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'").select("o_orderkey")


@query("select event_id from events where nullif(event_type, 'view') is not distinct from null")
def flt3_scope(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.nullif(F.col("event_type"), F.lit("view")).eqNullSafe(F.lit(None))).select("event_id")


@query("select l_orderkey, count(*) as n_actual from lineitem where list_contains(['modal:' || case when l_returnflag = 'N' then 'actual' else 'hypothetical' end, l_linestatus], 'modal:actual') group by l_orderkey")
def flt4_modality(spark, sf_dir):
    topics = F.array(F.concat(F.lit("modal:"), F.when(F.col("l_returnflag") == "N", "actual").otherwise("hypothetical")), "l_linestatus")
    return table(spark, sf_dir, "lineitem").where(F.array_contains(topics, "modal:actual")).groupBy("l_orderkey").agg(F.count("*").alias("n_actual"))


@query("select l_orderkey, l_linenumber from lineitem where l_linestatus = 'O' and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O')")
def flt5_published(spark, sf_dir):
    up = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").join(up, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query(f"select event_id from (select event_id, ({list(TRIPWIRES)} || ['adoption', 'authority'])[(event_id % 8 + 1)::int] as ability from events) where ability in {TRIPWIRES}")
def flt6_tripwire(spark, sf_dir):
    a = F.element_at(F.array(*(F.lit(x) for x in (*TRIPWIRES, "adoption", "authority"))), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").where(a.isin(*TRIPWIRES)).select("event_id")


@query("select event_id from (select event_id, event_type = 'error' as flagged, row_number() over (partition by user_id, event_type = 'error' order by event_id) - 1 as n, greatest(1, ceil(count(*) over (partition by user_id, event_type = 'error') / 10.0)) as stride from events) where flagged or n % stride = 0")
def flt7_bounded_stride(spark, sf_dir):
    return S.keep_flagged_stride(table(spark, sf_dir, "events").withColumn("flagged", F.col("event_type") == "error"), "user_id", "event_id", "flagged", 10).select("event_id")
