"""Queries of streams and of the seams for models. Streams run over the table's files until they are drained; the SQL is
the batch twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.functions import models as M
from memlift.plans.attribution_plans import BASE, sql
from memlift.plans.registry import query, table
from memlift.plans.retrieval_plans import documents, long_rank, questions, ranked, BM25
from memlift.plans.source_plans import folder
from memlift.plans.text_plans import sql_tokens
from memlift.shipping import ship
from memlift.streaming import monitors, ordered


def follow(spark, sf_dir, name):
    ship(spark)
    return monitors.follow(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def events_in_order(spark, sf_dir, processor, *fields):
    """The processor over the events of each user in order of time, drained, with the user's column back."""
    e = follow(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), "user_id", *fields)
    with ordered.keyed_states(spark):
        return monitors.drain(ordered.run(e, "user_id", processor), folder(spark)).withColumnRenamed("key", "user_id")


@query('select event_id, user_id, before, event_type as "now" from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before <> event_type')
def str1_belief_monitor(spark, sf_dir):
    return events_in_order(spark, sf_dir, ordered.Flips(), F.col("event_type").alias("value"))


@query(
    "with m as (select *, sum(case when event_type <> 'error' then value / 100 else 0 end) over w as s, sum(case when event_type = 'error' then value / 100 else 0 end) over w as c from events window w as (partition by user_id order by ts, event_id)), "
    "e as (select *, greatest(0.0, least(1.0, 0.5 + 0.15 * tanh(s) - 0.6 * tanh(c))) as conf from m), "
    "d as (select *, lag(conf, 1, 0.5) over (partition by user_id order by ts, event_id) as past from e) "
    'select event_id, user_id, round(past, 6) as before, round(conf, 6) as "now" from d where past - conf >= 0.05'
)
def str2_confidence_watch(spark, sf_dir):
    """Each user is a belief, errors challenge it and other events support it by their value; drops of 0.05 or more."""
    r = events_in_order(spark, sf_dir, ordered.Confidence(0.05), (F.col("value") / 100).alias("weight"), (F.col("event_type") == "error").alias("challenges"))
    return r.select("event_id", "user_id", F.round("before", 6).alias("before"), F.round("now", 6).alias("now"))


@query(
    "select o_orderkey as id, o_orderdate + interval 90 day as expired_at from orders where o_orderdate + interval 90 day <= (select max(o_orderdate) - interval 1 hour from orders)"
)
def str3_expiry_sweep(spark, sf_dir):
    """Orders are beliefs that expire after 90 days; each is a session of that length, which gives its alert once the stream has
    passed its end."""
    o = follow(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    alerts = monitors.expiry_alerts(o.withColumn("expires_at", F.col("at") + F.expr("interval 90 days")))
    with ordered.keyed_states(spark):
        return monitors.drain(alerts, folder(spark))


@query(
    "with recursive e as (select event_id, user_id as g, row_number() over (partition by user_id order by ts, event_id) as i, (json_extract(props, '$.k')::bigint) % 10 as src, floor(value)::bigint % 10 as dst from events where (json_extract(props, '$.k')::bigint) % 10 <> floor(value)::bigint % 10), "
    "r as (select g, 0::bigint as i, null::bigint as event_id, false as closes, list_transform(range(10), lambda n: 1::bigint << n) as reach from (select distinct g from e) union all "
    "select e.g, e.i, e.event_id, (r.reach[e.dst + 1] & (1::bigint << e.src)) > 0, case when (r.reach[e.dst + 1] & (1::bigint << e.src)) > 0 then r.reach else list_transform(r.reach, lambda x: case when x & (1::bigint << e.src) > 0 then x | r.reach[e.dst + 1] else x end) end from r join e on e.g = r.g and e.i = r.i + 1) "
    "select event_id, g from r where closes"
)
def str4_cycle_alarm(spark, sf_dir):
    """An edge by event, from a user's number modulo 10 to the value's; which ones close a loop. The SQL carries, edge by
    edge, what each node reaches."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = follow(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), F.col("user_id").alias("g"), (k % 10).alias("src"), (F.floor("value") % 10).alias("dst")).where("src <> dst")
    with ordered.keyed_states(spark):
        return monitors.drain(ordered.run(e, "g", ordered.Loops()), folder(spark)).withColumnRenamed("key", "g")


@query("select doc_id as id, coalesce(source, '') as scope, sha256(coalesce(text, '')) as content, min(doc_id) over w as first_id, doc_id > min(doc_id) over w as repeat from documents window w as (partition by coalesce(source, ''), sha256(coalesce(text, '')))")
def str5_ingest_once(spark, sf_dir):
    """Each document with the id under which its text is held in its source."""
    with ordered.keyed_states(spark):
        return monitors.drain(ordered.first_seen(follow(spark, sf_dir, "documents"), "source", "text", "doc_id"), folder(spark))


@query("select user_id, count(*) as hits, max(event_id) as last_event from events group by user_id")
def str6_access_statistics(spark, sf_dir):
    """Counts by item, kept up to date; the last state of each is the answer."""
    at = folder(spark)
    s = follow(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("hits"), F.max("event_id").alias("last_event"))
    q = s.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.parquet(f"{at}/out")
    return r.groupBy("user_id").agg(F.max_by(F.struct("hits", "last_event"), "batch").alias("x")).select("user_id", "x.hits", "x.last_event")


@query(
    "with e as (select *, event_id % 5 = 3 as asks, epoch_us(ts) // 1000 - case when event_id % 5 = 3 then 172800000 when event_id % 7 = 0 then 400000000 else 0 end as eff from events), "
    "q as (select a.event_id as question, a.user_id, f.event_id as cause, f.eff as effect, f.value, f.event_id > a.event_id as late from e a join e f on a.user_id = f.user_id and a.asks and not f.asks and f.eff <= a.eff), "
    "first as (select question, max_by(cause, [effect, cause]) as c from q where not late group by question), "
    "m as (select *, max(struct_pack(e := effect, c := cause)) over (partition by question order by cause rows between unbounded preceding and 1 preceding) as past from q), "
    "fix as (select question, user_id, cause, effect, value as answer, past.c as was from m where late and (past is null or struct_pack(e := effect, c := cause) > past)) "
    "select event_id as question, user_id, null::bigint as cause, f.eff as effect, null::double as was, f.value as answer from (select * from e where asks) a left join first on question = event_id left join (select event_id as c, eff, value from e) f using (c) "
    "union all select question, fix.user_id, cause, effect, e.value as was, answer from fix left join e on e.event_id = was"
)
def str7_late_facts(spark, sf_dir):
    """Every fifth event of a user asks for the value of two days before. Of the others, every seventh takes effect days before it was
    filed, so it corrects answers given since: all first answers, and all corrections with what they replace."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    asks = F.col("event_id") % 5 == 3
    effect = ms - F.when(asks, 172_800_000).when(F.col("event_id") % 7 == 0, 400_000_000).otherwise(0)
    return events_in_order(spark, sf_dir, ordered.AsOf(30 * 86_400_000), ms.alias("filed"), asks.alias("asks"), effect.alias("effect"), "value").where("question is not null")


@query("select b.event_id, b.user_id, round(sum((a.event_type = 'error')::int * exp(-0.00001 * (epoch_us(b.ts) // 1000000 - epoch_us(a.ts) // 1000000))), 6) as level from events a join events b on a.user_id = b.user_id and a.event_id <= b.event_id group by all")
def str8_escalating_warning(spark, sf_dir):
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    return events_in_order(spark, sf_dir, ordered.Warnings(0.00001), second.alias("second"), (F.col("event_type") == "error").alias("hit")).withColumn("level", F.round("level", 6))


@query(
    f"with {BASE.split('segs as')[0]}qt as (select conv_id, q_id, unnest(list_distinct(ts)) as token, len(list_distinct(ts)) as size from (select conv_id, id as q_id, {sql_tokens('text')} as ts from turns)), it as (select conv_id, id as item_id, unnest(list_distinct({sql_tokens('text')})) as token from turns), "
    "sc as (select q_id, item_id, count(*) / any_value(size)::double as score from qt join it using (conv_id, token) where item_id < q_id group by all) select q_id as src, item_id as dst from (select *, row_number() over (partition by q_id order by round(score, 9) desc, item_id) as rank from sc) where rank = 1"
)
def str9_turn_pipeline(spark, sf_dir):
    t = follow(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000000 + F.col("turn"))
    return monitors.ingest_turns(t, folder(spark))


@query("select conv_id, turn, substr(string_split(trim(text, ' ' || chr(10)), '. ')[1], 1, 200) as reply from conversations")
def udf1_model_call(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.ask()(F.col("text")).alias("reply"))


@query(ranked(BM25, 3))
def udf2_retriever(spark, sf_dir):
    return long_rank(M.Bm25Retriever().topk(questions(spark, sf_dir), documents(spark, sf_dir), 3))


@query("select b.user_id, b.event_id as new_id, a.event_id as old_id, substr(sha256(b.event_id::varchar || ':' || b.event_type), 1, 12) as receipt from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) a join (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) b on a.user_id = b.user_id and a.event_type = b.event_type and b.n = a.n + 1 where abs(a.value - b.value) > 50")
def udf2_memory_contract(spark, sf_dir):
    """The rest of the contract: facts are written for receipts, and those that undercut what was held before are surfaced unasked."""
    memory = M.FactMemory(folder(spark))
    facts = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), F.col("event_type").alias("attribute"), "value")
    receipts = memory.write(facts)
    told = memory.surface(facts, 50)
    return told.join(receipts, told["new_id"] == receipts["id"]).select(F.col("subject").alias("user_id"), "new_id", "old_id", "receipt")


@query()
def udf3_auto_capture(spark, sf_dir):
    ship(spark)
    return M.capture(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", M.ask())


_LINES = "case event_type when 'error' then 'supersedes: ' || user_id::varchar || chr(10) || 'concerns #' || user_id::varchar when 'view' then 'supports ' || user_id::varchar || ' and refines: 7' else 'none' end"


@query("select event_id, 'concerns' as relation, user_id as target from events where event_type = 'error' union all select event_id, 'supports', user_id from events where event_type = 'view' union all select event_id, 'refines', 7 from events where event_type = 'view'")
def udtf1_relation_lines(spark, sf_dir):
    u = F.col("user_id").cast("string")
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("Supersedes: "), u, F.lit("\nconcerns #"), u)).when(F.col("event_type") == "view", F.concat(F.lit("supports "), u, F.lit(" and refines: 7"))).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", F.explode(M.relation_lines(said)).alias("e")).select("event_id", "e.relation", "e.target")


@query("select user_id, count(*) filter (event_type <> 'signup') as n_edges from events where event_type in ('error', 'view') group by user_id")
def fn19_relation_counts(spark, sf_dir):
    said = F.concat(F.lit("concerns: "), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'view')").select("user_id", F.explode(M.relation_lines(said)).alias("e"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_edges"))


@query("select user_id, event_type || '|' || user_id::varchar as names from events group by all")
def fn20_structure_lines(spark, sf_dir):
    said = F.concat(F.lit("note\nOrder: "), F.col("event_type"), F.lit(" > "), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("user_id", F.array_join(M.structure_lines(said), "|").alias("names")).distinct()


@query("select event_id, case event_id % 3 when 0 then event_type || '|second' when 1 then 'one fact|two facts' else 'x' end as facts from events")
def fn22_tolerant_facts(spark, sf_dir):
    e = F.col("event_id") % 3
    said = F.when(e == 0, F.concat(F.lit('sure: ["'), F.col("event_type"), F.lit('", "second"]'))).when(e == 1, "- one fact\n2) two facts").otherwise(" x ")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(M.tolerant_facts(said), "|").alias("facts"))


@query("select source, list_sort(list(n_chars))[floor(0.9 * (count(*) - 1))::bigint + 1] as p90 from documents group by source")
def udaf1_percentile_by_index(spark, sf_dir):
    from memlift.operators.sampling import at_share

    return at_share(table(spark, sf_dir, "documents"), ["source"], "n_chars", 0.9, "p90")


