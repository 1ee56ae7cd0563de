"""Queries of windows, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.functions import text as T
from memlift.operators import sampling as S
from memlift.operators import retrieval as R
from memlift.operators import graph as G
from memlift.operators import windows as O
from memlift.plans.registry import query, table


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as seq from conversations")
def win1_sequence(spark, sf_dir):
    return O.sequence(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("seq").cast("long").alias("seq"))


_H = "sha256('s1:' || lang || ':' || doc_id::varchar)"


@query(f"select doc_id, lang, rn from (select doc_id, lang, row_number() over (partition by lang order by {_H}, doc_id) as rn from documents) order by rn, lang limit 200")
def win2_stratified_sample(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", "s1", limit=200).select("doc_id", "lang", F.col("round").cast("long").alias("rn"))


@query("select doc_id, rep, array_to_string(list_transform([0, 1, 2, 3], lambda i: 'T' || ((doc_id + rep + i) % 4 + 1)::varchar), ',') as tiers from documents, (values (0), (1), (2)) r(rep)")
def win3_balanced_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("rep", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    return d.select("doc_id", "rep", F.array_join(S.tier_order(["T1", "T2", "T3", "T4"], F.col("doc_id") + F.col("rep")), ",").alias("tiers"))


@query("select conv_id, n // 8 as chunk, count(*) as n, md5(string_agg(substr(text, 1, 800), chr(10) order by n)) as excerpt_md5 from (select *, row_number() over (partition by conv_id order by turn) - 1 as n from conversations) group by all")
def win4_chunks(spark, sf_dir):
    return S.chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "chunk", "n", F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"))


@query("select event_id, user_id, before, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) where before <> event_type")
def win5_value_flips(spark, sf_dir):
    return O.flips(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "before", "event_type")


@query("select event_id, coalesce(abs(value - lag(value) over (partition by user_id order by event_id)) >= 20, false) as tripped from events")
def win6_watch(spark, sf_dir):
    return O.watch(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 20).select("event_id", "tripped")


@query(
    "select user_id, min(case when trip then n end) - min(case when flip then n end) as ticks from (select user_id, row_number() over w as n, abs(value - lag(value) over w) >= 20 as trip, event_type <> lag(event_type) over w as flip from events window w as (partition by user_id order by event_id)) group by user_id"
)
def win7_detection_latency(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("n"), (F.abs(F.col("value") - F.lag("value").over(w)) >= 20).alias("trip"), (F.col("event_type") != F.lag("event_type").over(w)).alias("flip"))
    return e.groupBy("user_id").agg((F.min(F.when(F.col("trip"), F.col("n"))) - F.min(F.when(F.col("flip"), F.col("n")))).alias("ticks"))


@query(
    "select user_id, max(case when r = 1 then value end) as current, max(case when r = 2 then value end) as previous from (select *, row_number() over (partition by user_id order by event_id desc) as r from events where event_type <> 'error') where r <= 2 group by user_id"
)
def win8_current_previous(spark, sf_dir):
    """Errors are retractions."""
    return O.current_and_previous(table(spark, sf_dir, "events").where("event_type <> 'error'"), "user_id", "event_id", "value")


@query(
    "select o_custkey, max_by(o_totalprice, o_orderkey) as current, max_by(before, o_orderkey) as previous, max(o_orderkey) as evidence from (select *, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before from orders where o_orderstatus <> 'F') group by o_custkey"
)
def win9_revision_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    o = o.withColumn("before", F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_totalprice", "before")).alias("x"))
    return last.select("o_custkey", F.col("x.o_totalprice").alias("current"), F.col("x.before").alias("previous"), F.col("x.o_orderkey").alias("evidence"))


@query("select s_suppkey, rank() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rank from supplier")
def win10_board_rank(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("rank"))


@query("select user_id, newest_rank, newest_rank <= 30 as in_pool from (select user_id, max_by(r, event_id) as newest_rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) group by user_id)")
def win11_newest_rank(spark, sf_dir):
    r = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long"))
    return r.groupBy("user_id").agg(F.max_by("r", "event_id").alias("newest_rank")).withColumn("in_pool", F.col("newest_rank") <= 30)


@query("select user_id, event_type, min_by(value, ts) as first_value from events group by user_id, event_type")
def win12_earlier(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("value", "ts").alias("first_value"))


@query("select doc_id, md5(text) as text_md5, channel from (select *, row_number() over (partition by text order by channel_ord, doc_id) as n from (select doc_id, text, case when doc_id % 2 = 0 then 'custom' else 'auto' end as channel, doc_id % 2 as channel_ord from documents)) where n = 1")
def win13_merge_served(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("channel", F.when(F.col("doc_id") % 2 == 0, "custom").otherwise("auto"))
    return O.keep_first(d, ["text"], [F.col("doc_id") % 2, "doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "channel")


@query(
    """with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn) as n, least(length(text), 700) + case when length(text) > 700 then 1 else 0 end as len from conversations),
g as (select conv_id, n, case when len <= 2000 then len else 0 end as used, len <= 2000 as kept from t where n = 1
  union all select t.conv_id, t.n, case when g.used + t.len <= 2000 then g.used + t.len else g.used end, g.used + t.len <= 2000 from g join t on t.conv_id = g.conv_id and t.n = g.n + 1)
select conv_id, count(*) filter (kept) as n_kept, max(used)::bigint as used from g group by conv_id"""
)
def win14_greedy_budget(spark, sf_dir):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("items"))
    kept = per.select("conv_id", O.greedy_budget(F.col("items"), 700, 2000).alias("kept"))
    return kept.select("conv_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0), lambda s, x: s + F.length(x["text"])).cast("long").alias("used"))


@query("select conv_id, row_number() over (partition by conv_id order by pos) - 1 as turn, role from (select conv_id, turn::double as pos, role from conversations union all select conv_id, max(turn) // 2 + 0.5, 'injected' from conversations group by conv_id)")
def win15_splice(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    extra = c.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("turn")).withColumn("role", F.lit("injected"))
    return O.splice(c, extra, "conv_id", "turn").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")


@query("select conv_id, turn, k from (select conv_id, count(*) as n from conversations group by conv_id) c, range(0, 3) r(k), lateral (select floor((k + 0.5) * (n / 3))::bigint as turn) where turn < n")
def win16_spread_positions(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    k = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("turn", F.floor((F.col("k") + 0.5) * (F.col("n") / 3)))
    return k.where("turn < n").select("conv_id", "turn", F.col("k").cast("long").alias("k"))


@query("select t // f as n, event_type as label, count(*) as seen, max(value) as best from (select *, row_number() over (order by event_id) as place, count(*) over () as t from events), (values (8), (4), (2), (1)) p(f) where place <= t // f group by all")
def win17_scaling_curve(spark, sf_dir):
    """A metric at an eighth, a quarter, a half and all of the events in their order."""
    e = S.numbered(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    sizes = e.agg(F.count("*").alias("t")).select("t", F.explode(F.array(*(F.lit(f) for f in (8, 4, 2, 1)))).alias("f")).select(F.floor(F.col("t") / F.col("f")).alias("n"))
    return e.join(F.broadcast(sizes), F.col("place") < F.col("n")).groupBy("n", F.col("event_type").alias("label")).agg(F.count("*").alias("seen"), F.max("value").alias("best"))  # four rows


@query("select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events where value > 0) where rank <= 8")
def top1_top_k(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "events").where("value > 0"), "user_id", [F.desc("value"), F.asc("event_id")], 8).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case left(o_orderpriority, 1) when '1' then 3 when '2' then 2 else 1 end desc, o_orderdate desc, o_orderkey) as rank from orders) where rank <= 3")
def top2_priority(spark, sf_dir):
    p = F.when(F.col("o_orderpriority").startswith("1"), 3).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(1)
    return O.top_k(table(spark, sf_dir, "orders"), "o_custkey", [F.desc(p), F.desc("o_orderdate"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("select user_id, event_id, stage from (select *, min(stage) over (partition by user_id) as f from (select user_id, event_id, case when event_type = 'purchase' and value > 60 then 1 when value > 40 then 2 else 3 end as stage from events)) where stage = f")
def top3_cascade(spark, sf_dir):
    s = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), 1).when(F.col("value") > 40, 2).otherwise(3)
    return O.first_stage(table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("stage")), "user_id", "stage")


@query(
    "with q as (select conv_id, turn, lower(string_split(text, ' ')[1]) as term, lower(text) as phrase from conversations), hit as (select q.conv_id, q.turn, d.item_id, case when contains(lower(d.text), q.phrase) then 1 else 2 end as stage from q join benchmark d on contains(lower(d.text), q.term)) select conv_id, turn, item_id, stage from (select *, min(stage) over (partition by conv_id, turn) as f from hit) where stage = f"
)
def top4_phrase_first(spark, sf_dir):
    """Whole question as a phrase, else its first term. Distinct terms are looked up by their first three letters, then each
    hit is tried with the questions that begin so."""
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.element_at(F.split("text", " "), 1)).alias("term"), F.lower("text").alias("phrase"))
    d = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("body"))
    hit = R.contained(d, "body", q.select("term").distinct(), "term").hint("merge").join(q, "term")
    hit = hit.withColumn("stage", F.when(F.col("body").contains(F.col("phrase")), 1).otherwise(2))
    first = F.min("stage").over(W.partitionBy("conv_id", "turn"))
    return hit.withColumn("f", first).where("stage = f").select("conv_id", "turn", "item_id", "stage")


@query("select o_custkey, l_orderkey, l_linenumber from (select o_custkey, l_orderkey, l_linenumber, row_number() over (partition by o_custkey order by orank, l_linenumber) as n from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as orank from orders) o join lineitem on o_orderkey = l_orderkey where orank <= 2) where n <= 5")
def top5_expand_cap(spark, sf_dir):
    best = O.top_k(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).withColumnRenamed("rank", "orank")
    lines = best.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return O.top_k(lines, "o_custkey", [F.asc("orank"), F.asc("l_linenumber")], 5).select("o_custkey", "l_orderkey", "l_linenumber")


@query("select p_brand, min_by(p_partkey, [case when p_type like '%STEEL%' then 0 else 1 end::double, p_retailprice, p_partkey]) as choice from part where p_size >= 5 and p_type not like '%COPPER%' group by p_brand")
def top7_constrained_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part").where((F.col("p_size") >= 5) & ~F.col("p_type").contains("COPPER"))
    return p.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.when(F.col("p_type").contains("STEEL"), 0).otherwise(1), "p_retailprice", "p_partkey")).alias("choice"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9_-]+'), lambda w: length(w) >= 3)"
_T8 = f"list_filter({_WORDS}, lambda x, i: list_position({_WORDS}, x) = i)[1:8]"


@query(
    f"with q as (select conv_id, turn, lower(text) as phrase, {_T8} as terms from conversations where role = 'user'), full_ as (select conv_id, turn, item_id from q join benchmark b on contains(lower(b.text), q.phrase)), "
    "t as (select conv_id, turn, terms[i] as term, i from (select *, unnest(range(1, len(terms) + 1)) as i from q) where (conv_id, turn) not in (select conv_id, turn from full_)), "
    "h as (select conv_id, turn, i, item_id, row_number() over (partition by conv_id, turn, i order by item_id) as r from t join benchmark b on contains(lower(b.text), t.term)), k as (select conv_id, turn, item_id, i, r, row_number() over (partition by conv_id, turn, item_id order by i, r) as f from h where r <= 5) "
    "select conv_id, turn, item_id, 'term' as route from (select *, row_number() over (partition by conv_id, turn order by i, r) as n from k where f = 1) where n <= 6 union all select conv_id, turn, item_id, 'full' from (select *, row_number() over (partition by conv_id, turn order by item_id) as n from full_) where n <= 6"
)
def top8_term_merge(spark, sf_dir):
    """The whole question first; only where it finds nothing, one search for each of its first eight terms, five hits each, of
    which the first six seen stay."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower("text").alias("phrase"))
    terms = F.slice(F.array_distinct(F.filter(F.split("phrase", "[^a-z0-9_-]+"), lambda w: F.length(w) >= 3)), 1, 8)
    d = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("body"))
    whole = R.phrase_hits(q, d, "phrase", "body").select("conv_id", "turn", "item_id").distinct()
    t = q.join(whole.hint("merge"), ["conv_id", "turn"], "left_anti").select(F.struct("conv_id", "turn").alias("q_id"), F.posexplode(terms).alias("i", "term"))
    h = R.contained(d, "body", t.select("term").distinct(), "term").select("item_id", "term").hint("merge").join(t, "term")
    h = O.top_k(h, ["q_id", "i"], [F.asc("item_id")], 5).withColumnRenamed("rank", "r")
    k = O.top_k(O.keep_first(h, ["q_id", "item_id"], ["i", "r"]), "q_id", [F.asc("i"), F.asc("r")], 6).select("q_id.*", "item_id", F.lit("term").alias("route"))
    return k.unionByName(O.top_k(whole, ["conv_id", "turn"], [F.asc("item_id")], 6).select("conv_id", "turn", "item_id", F.lit("full").alias("route")))


@query("select 'customer:' || c_custkey::varchar as id, c_acctbal as value from customer union all select 'supplier:' || s_suppkey::varchar, s_acctbal from supplier")
def set1_federated_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("value"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_acctbal").alias("value"))
    return c.unionByName(s)


_A, _B = "select 'c' || c_nationkey::varchar || ':' || c_mktsegment as id, c_acctbal as v from customer", "select 'c' || s_nationkey::varchar || ':' || upper('building') as id, s_acctbal as v from supplier"
_IDS = lambda *xs: " union ".join(f"select id from ({x})" for x in xs)


@query(f"select (select count(*) from ({_IDS(_A, _B)})) as ids, (select count(*) from (({_IDS(_A, _B)}) except ({_IDS(_B, _A)}))) as one_way, (select count(*) from (({_IDS(_B, _A)}) except ({_IDS(_A, _B)}))) as other_way, (select count(*) from (({_IDS(_A, _B)}) except (select id from ({_A}) where not starts_with(id, 'c3:')))) as sabotaged")
def set2_order_independence(spark, sf_dir):
    """The ids of two stores' union, made in both orders with the first of equal ids kept, and of a union that lost rows."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit(":"), "c_mktsegment").alias("id"), F.col("c_acctbal").alias("v"))
    b = s.select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string"), F.lit(":BUILDING")).alias("id"), F.col("s_acctbal").alias("v"))

    def union(first, second):
        rows = first.withColumn("at", F.lit(0)).unionByName(second.withColumn("at", F.lit(1)))
        return rows.groupBy("id").agg(F.min_by("v", "at").alias("v")).select("id")

    one, two = union(a, b), union(b, a)
    counts = {"ids": one, "one_way": one.exceptAll(two), "other_way": two.exceptAll(one), "sabotaged": one.exceptAll(a.where("not startswith(id, 'c3:')").select("id").distinct())}
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), (d.agg(F.count("*").alias(n)) for n, d in counts.items()))  # one row each


@query("select user_id, array_to_string(list_sort(list(k)), ',') as members, count(*) as n from (select user_id, k, max_by(event_type, event_id) as last from (select *, json_extract_string(props, '$.k') as k from events) group by user_id, k) where last <> 'error' group by user_id")
def set3_fold(spark, sf_dir):
    """The last action on a member decides; an error removes it."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    last = e.groupBy("user_id", "k").agg(F.max_by("event_type", "event_id").alias("last")).where("last <> 'error'")
    return last.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("members"), F.count("*").alias("n"))


@query("select o_custkey, list_sort(list(distinct o_orderpriority)) = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] as all_there, len(list_filter(['1-URGENT', '5-LOW'], lambda x: list_contains(list(o_orderpriority), x))) = 2 as both_sides from orders group by o_custkey")
def set4_unordered_equality(spark, sf_dir):
    wanted = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("own"))
    return o.select("o_custkey", (F.col("own") == wanted).alias("all_there"), F.forall(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), lambda x: F.array_contains("own", x)).alias("both_sides"))


@query("select lang, n from (select lang, count(*) as n from documents group by lang) except all select lang, n from (select lang, count(*) as n from documents join labels using (doc_id) group by lang)")
def set5_distribution_difference(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n")).exceptAll(known.groupBy("lang").agg(F.count("*").alias("n")))


_K = "json_extract_string(props, '$.k')::bigint % 10"


@query(
    f"with recursive ke as (select distinct user_id as g, k as src, dst from (select user_id, event_type, {_K} as k, lead({_K}) over (partition by user_id order by event_id) as dst from events) where event_type = 'purchase' and k <> dst), "
    "kr as (select g, src as a, dst as b from ke union select kr.g, kr.a, ke.dst from kr join ke on ke.g = kr.g and ke.src = kr.b), "
    "km as (select x.g, min(x.b) as place, 'cycle ' || string_agg(x.b::varchar, '-' order by x.b) as body from kr x join kr y on x.g = y.g and x.a = y.b and x.b = y.a group by x.g, x.a), "
    "f as (select *, lag(event_id) over w as past, lag(value) over w as old from events window w as (partition by user_id, event_type order by event_id)), "
    "c as (select user_id, event_id, past, row_number() over (partition by user_id order by event_id) as r from f where abs(value - old) > 60), "
    "h as (select *, row_number() over (partition by user_id order by event_id desc) as r from events), o as (select user_id, min(event_id) as oldest from h where r <= 5 group by user_id), "
    "s as (select g as user_id, 0 as source, place, body from km union all select user_id, 1, event_id, 'conflict ' || past::varchar || '-' || event_id::varchar from c where r <= 3 "
    "union all select user_id, 2, event_id, 'update ' || event_type || ':' || floor(value)::bigint::varchar from events join o using (user_id) where event_type = 'error' and event_id > oldest "
    "union all select user_id, 3, r, event_type || ':' || floor(value)::bigint::varchar from h where r <= 5 union all select user_id, 4, event_id, event_type || ':' || floor(value)::bigint::varchar from events where value < 5), "
    "m as (select user_id, body, min(struct_pack(s := source, p := place)) as spot from s group by all) select user_id, string_agg(body, '|' order by spot, body) as merged, count(*) as n from m group by user_id"
)
def set6_support_merge(spark, sf_dir):
    """What a user's five latest events (the hits) are served with, each text once: cycles on which the user's items lie, up to three
    conflicts, later errors that concern the hits, the hits, and the members of the collection of small values."""
    e = table(spark, sf_dir, "events")
    k, user = F.get_json_object("props", "$.k").cast("long") % 10, W.partitionBy("user_id").orderBy("event_id")
    fact = F.concat_ws(":", "event_type", F.floor("value").cast("string"))
    order = e.select(F.col("user_id").alias("g"), "event_type", k.alias("src"), F.lead(k).over(user).alias("dst"))
    on = G.strong_components(order.where("event_type = 'purchase' and src <> dst"))
    cycles = on.groupBy(F.col("g").alias("user_id"), F.col("component").alias("place")).agg(F.concat(F.lit("cycle "), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), "-")).alias("body"))
    same = W.partitionBy("user_id", "event_type").orderBy("event_id")
    flips = e.select("user_id", "event_id", F.lag("event_id").over(same).alias("past"), F.abs(F.col("value") - F.lag("value").over(same)).alias("by")).where("by > 60")
    conflicts = O.top_k(flips, "user_id", [F.asc("event_id")], 3).select("user_id", F.col("event_id").alias("place"), F.format_string("conflict %d-%d", "past", "event_id").alias("body"))
    hits = O.top_k(e, "user_id", [F.desc("event_id")], 5)
    oldest = hits.groupBy("user_id").agg(F.min("event_id").alias("oldest"))
    concerns = e.where("event_type = 'error'").hint("merge").join(oldest, "user_id").where("event_id > oldest").select("user_id", F.col("event_id").alias("place"), F.concat(F.lit("update "), fact).alias("body"))
    small = e.where("value < 5").select("user_id", F.col("event_id").alias("place"), fact.alias("body"))
    merged = O.merge_support([cycles, conflicts, concerns, hits.select("user_id", F.col("rank").alias("place"), fact.alias("body")), small], "user_id")
    return merged.select("user_id", F.array_join("merged", "|").alias("merged"), "n")


@query("select o_orderkey, list_sort(list(l_linenumber)) = list_transform(range(1, count(*) + 1), lambda x: x::int) as same from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def set7_membership(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg((F.array_sort(F.collect_list("l_linenumber")) == F.sequence(F.lit(1), F.count("*").cast("int"))).alias("same"))
