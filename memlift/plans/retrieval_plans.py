"""Queries of retrieval. Questions are the benchmark's texts or conversations' user turns; items are documents or turns."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlift.functions import text as T
from memlift.operators import graph as G
from memlift.operators import retrieval as R
from memlift.operators import vectors as V
from memlift.operators import windows as O
from memlift.plans.attribution_plans import sql
from memlift.plans.registry import query, table
from memlift.plans.text_plans import sql_tokens

QT = f"select item_id as q_id, unnest(list_distinct({sql_tokens('text')})) as token, len(list_distinct({sql_tokens('text')})) as size from benchmark"
DT = f"select doc_id as item_id, unnest({sql_tokens('text')}) as token from documents"
OVERLAP = f"(select q_id, item_id, count(*) / any_value(size)::double as score from ({QT}) q join (select distinct * from ({DT})) d using (token) group by q_id, item_id)"


def bm25_sql(q: str, d: str) -> str:
    return f"""(with q as ({q}), d as ({d}), p as (select token, item_id, count(*) as tf from d group by all), l as (select item_id, sum(tf) as dl from p group by all), n as (select count(*) as n from documents), m as (select sum(dl) as s from l),
f as (select token, count(*) as df from p group by token)
select q_id, item_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (m.s / n.n)))) as score from (select distinct q_id, token from q) q join f using (token) join p using (token) join l using (item_id), n, m group by q_id, item_id)"""


BM25 = bm25_sql(QT, DT)


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"), "lang", "source")


def overlap(spark, sf_dir, most=None):
    return R.overlap_scores(questions(spark, sf_dir), documents(spark, sf_dir), [], most=most)


def bm25(spark, sf_dir, most=None, summed=False):
    return R.bm25(questions(spark, sf_dir), documents(spark, sf_dir), T.tokens(F.col("question")), T.tokens(F.col("body")), most=most, summed=summed)


def ranked(scores, k: int):
    return f"select q_id, item_id, rank from (select q_id, item_id, row_number() over (partition by q_id order by round(score, 9) desc, item_id) as rank from {scores} where score > 0) where rank <= {k}"


def long_rank(df):
    return df.select("q_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(f"select q_id, item_id, score from {OVERLAP}")
def jn3_similarity_join(spark, sf_dir):
    return overlap(spark, sf_dir)


@query(ranked(OVERLAP, 8))
def ret1_overlap_top(spark, sf_dir):
    return long_rank(R.best(overlap(spark, sf_dir, 8), 8))


@query(ranked(BM25, 10))
def ret2_bm25_top(spark, sf_dir):
    return long_rank(R.best(bm25(spark, sf_dir, 10), 10))


_GRAMS = "list_filter(list_transform(list_zip(c, c[2:], c[3:]), lambda z: z[1] || z[2] || z[3]), lambda g: g is not null)"


_FIVE = "lower(concat_ws(' | ', text, lang, source, 'doc ' || doc_id::varchar, 'len ' || n_chars::varchar))"


@query(
    f"with d as (select item_id, unnest({_GRAMS}) as g from (select doc_id as item_id, string_split({_FIVE}, '') as c from documents)), q as (select item_id as q_id, unnest(list_distinct({_GRAMS})) as g from (select item_id, string_split(lower(text), '') as c from benchmark)), p as (select item_id, g, count(*) as tf from d group by all), l as (select item_id, sum(tf) as dl from p group by all), n as (select count(*) as n from documents), m as (select sum(dl) as s from l), f as (select g, count(*) as df from p group by g), "
    "s as (select q_id, item_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (m.s / n.n)))) as score from q join f using (g) join p using (g) join l using (item_id), n, m group by q_id, item_id) "
    "select q_id, item_id from (select *, row_number() over (partition by q_id order by round(score, 6) desc, item_id) as r from s) where r <= 3"
)
def ret3_trigrams(spark, sf_dir):
    """BM25 over the trigrams of five fields put together."""
    fields = F.concat_ws(" | ", "text", "lang", "source", F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.concat(F.lit("len "), F.col("n_chars").cast("string")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), fields.alias("body"))
    s = R.bm25(questions(spark, sf_dir), d, R.trigrams(F.col("question")), R.trigrams(F.col("body")), most=3, runs=F.lower("body"))
    return O.top_k(s, "q_id", [F.desc(F.round("score", 6)), F.asc("item_id")], 3).select("q_id", "item_id")


_TERMS = "['tion', 'the', 'erth', 'and']"


# the question's own terms: distinct words of three letters or more, the first eight, of the first turn of each conversation
_TERMS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_-]+'), lambda w: length(w) >= 3))"


def terms_of(spark, sf_dir):
    """q_id and terms of the benchmark's questions."""
    t = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_-]+"), lambda w: F.length(w) >= 3))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), t.alias("terms"))


@query(f"with q as (select item_id as q_id, unnest({_TERMS}) as t from benchmark) select q_id, conv_id, turn, score from (select *, row_number() over (partition by q_id order by score desc, conv_id, turn) as r from (select q_id, conv_id, turn, sum(contains(lower(text), t)::int + contains(lower(role), t)::int)::bigint as score from conversations join q on contains(lower(text), t) or contains(lower(role), t) group by all)) where r <= 5")
def ret4_like_score(spark, sf_dir):
    """How many of a question's terms occur in the text and in the role; the five best turns. Terms are looked up by their first
    three letters among the trigrams of a turn and tried only where these are."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.lower("text"), F.lower("role")).alias("bodies"))
    s = R.term_scores(terms_of(spark, sf_dir), rows, ["conv_id", "turn"], 5, True)
    return O.top_k(s, "q_id", [F.desc("score"), F.asc("conv_id"), F.asc("turn")], 5).select("q_id", "conv_id", "turn", "score")


@query("select distinct d.doc_id, b.item_id from documents d join benchmark b on contains(lower(d.text), lower(b.text))")
def ret5_phrase(spark, sf_dir):
    """Documents that hold a question whole. A phrase is looked up by its longest word, as a whole word or not, and then tried;
    phrases without words of three letters can't occur here."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("phrase"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body"))
    return R.phrase_hits(b, d, "phrase", "body").select("doc_id", "item_id").distinct()


_ENT = f"select source as item_id, unnest({sql_tokens('text')}) as token from documents"


@query(f"with s as (select q_id, item_id, count(*) as score from (select distinct q_id, token from ({QT})) q join (select distinct * from ({_ENT})) d using (token) group by all), t as (select *, row_number() over (partition by q_id order by score desc, item_id) as r from s) select q_id, doc_id from (select q_id, doc_id, row_number() over (partition by q_id order by r, doc_id) as n from t join documents on source = item_id where r <= 2) where n <= 6")
def ret6_entity_rank(spark, sf_dir):
    """Sources are ranked first, then their documents are listed up to six."""
    q = questions(spark, sf_dir).select("q_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("token"))
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("source").alias("item_id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).distinct()
    s = q.hint("merge").join(e, "token").groupBy("q_id", "item_id").agg(F.count("*").alias("score"))
    best = O.top_k(s, "q_id", [F.desc("score"), F.asc("item_id")], 2).withColumnRenamed("rank", "r")
    return O.top_k(best.hint("merge").join(d, F.col("source") == F.col("item_id")), "q_id", [F.asc("r"), F.asc("doc_id")], 6).select("q_id", "doc_id")


@query(f"select q_id, item_id as source, count(*) as shared from (select distinct q_id, token from ({QT})) q join (select distinct * from ({_ENT})) d using (token) group by all")
def ret7_entity_overlap(spark, sf_dir):
    q = questions(spark, sf_dir).select("q_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("token"))
    e = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).distinct()
    return q.hint("merge").join(e, "token").groupBy("q_id", "source").agg(F.count("*").alias("shared"))


_COS = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(d.embedding, lambda x: x::double * x::double))))"


@query(f"select q_id, item_id, rank from (select q_id, item_id, row_number() over (partition by q_id order by round(s, 6) desc, item_id) as rank from (select q.vec_id as q_id, d.vec_id as item_id, {_COS} as s from embeddings q join embeddings d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0)) where rank <= 5")
def ret8_vector_top(spark, sf_dir):
    """Nearest vectors of each vector whose number is divisible by 100, the stated set of questions, against all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    found = V.nearest(e, e.where("item_id % 100 = 0").withColumnRenamed("item_id", "q_id"), 5)
    return long_rank(found.select("q_id", "item_id", "rank"))


@query(f"select coalesce(a.q_id, b.q_id) as q_id, coalesce(a.item_id, b.item_id) as item_id, a.rank as rank_a, b.rank as rank_b from ({ranked(OVERLAP, 5)}) a full join ({ranked(BM25, 5)}) b using (q_id, item_id)")
def ret9_hybrid(spark, sf_dir):
    return R.hybrid(long_rank(R.best(overlap(spark, sf_dir, 5), 5)), long_rank(R.best(bm25(spark, sf_dir, 5), 5)))


_LISTING = r"\b(how many|list|all|every|in order|order|total|the|les|der|los)\b"


@query(rf"with col as (select source, unnest([source, lang]) as keyword from documents group by source, lang), asks as (select item_id as q_id, string_split(lower(text), ' ') as w, lower(text) as t from benchmark where regexp_matches(lower(text), '{_LISTING}')), k as (select lang, source, left(min(lower(string_split(trim(text), ' ')[1])), 4) as keyword from documents where len(trim(text)) > 3 group by lang, source) select q_id, k.source as collection, k.lang, doc_id as member from asks join k on contains(t, keyword) and length(keyword) > 1 join documents d on d.source = k.source and d.lang = k.lang")
def ret10_enumeration(spark, sf_dir):
    """A question of a listing kind gets all members of each collection (language and source) whose keyword it contains."""
    d = table(spark, sf_dir, "documents")
    word = F.lower(F.element_at(F.split(F.trim("text"), " "), 1))
    k = d.where(F.length(F.trim("text")) > 3).groupBy("lang", "source").agg(F.substring(F.min(word), 1, 4).alias("keyword")).where(F.length("keyword") > 1)
    asks = table(spark, sf_dir, "benchmark").where(F.lower("text").rlike(_LISTING)).select(F.col("item_id").alias("q_id"), F.lower("text").alias("t"))
    hit = R.contained(asks, "t", k, "keyword").select("q_id", "lang", "source")
    return hit.hint("merge").join(d.select("lang", "source", "doc_id"), ["lang", "source"]).select("q_id", F.col("source").alias("collection"), "lang", F.col("doc_id").alias("member"))


_NOTED = """select event_id, user_id, event_type, value, lead(event_id) over w as later, lead(value) over w as next_value, lag(value) over w as last_value from events window w as (partition by user_id, event_type order by event_id)"""


@query(
    f"""with recursive n as ({_NOTED}), conf as (select event_id, 'conflicts with ' || b_id::varchar as note, row_number() over (partition by event_id order by b_id) as r from (select a.event_id, b.event_type, min(b.event_id) as b_id from events a join events b on a.user_id = b.user_id and floor(a.value) = floor(b.value) and a.event_type <> b.event_type and b.event_id > a.event_id where a.value > 60 group by all)),
c as (select event_id, string_agg(note, '; ' order by r) as notes from conf where r <= 3 group by event_id),
ke as (select distinct user_id as g, k as src, dst from (select user_id, event_type, json_extract_string(props, '$.k')::bigint % 10 as k, lead(json_extract_string(props, '$.k')::bigint % 10) over (partition by user_id order by event_id) as dst from events) where event_type = 'purchase' and k <> dst),
kr as (select g, src as a, dst as b from ke union select kr.g, kr.a, ke.dst from kr join ke on ke.g = kr.g and ke.src = kr.b),
km as (select x.g, x.a as node, 'cycle ' || string_agg(x.b::varchar, '-' order by x.b) as note from kr x join kr y on x.g = y.g and x.a = y.b and x.b = y.a group by x.g, x.a),
k as (select event_id, km.note from events join km on g = user_id and node = json_extract_string(props, '$.k')::bigint % 10)
select event_id, concat_ws('; ', k.note, c.notes, case when later is not null and abs(next_value - value) > 50 then 'updated by ' || later::varchar end) as note from n left join k using (event_id) left join c using (event_id) where k.note is not null or c.notes is not null or (later is not null and abs(next_value - value) > 50)"""
)
def ret11_notes(spark, sf_dir):
    """Notes for hits, in the order that tells a reader most: the cycle that the hit's item lies on, of any length (items are the last
    digits of k, ordered by a user's purchases: the members of its strongly connected component), conflicts (with the next fact of
    each other type under the same whole value, three at most), and an update by a later fact."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value"))
    w = W.partitionBy("user_id", "event_type").orderBy("event_id")
    n = e.select("event_id", F.when(F.abs(F.lead("value").over(w) - F.col("value")) > 50, F.concat(F.lit("updated by "), F.lead("event_id").over(w).cast("string"))).alias("update"))
    by = W.partitionBy("user_id", "v").orderBy("event_id").rowsBetween(1, W.unboundedFollowing)
    kinds = ("click", "error", "purchase", "signup", "view")
    each = [F.when(F.col("event_type") != t, F.first(F.when(F.col("event_type") == t, F.col("event_id")), ignorenulls=True).over(by)) for t in kinds]
    three = F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, 3)
    c = e.select("event_id", "value", "event_type", three.alias("x")).where("value > 60 and size(x) > 0")
    c = c.select("event_id", F.array_join(F.transform("x", lambda y: F.concat(F.lit("conflicts with "), y.cast("string"))), "; ").alias("conflicts"))
    items = e.withColumn("k", F.get_json_object("props", "$.k").cast("long") % 10).select("event_id", F.col("user_id").alias("g"), "event_type", F.col("k").alias("node"), F.lead("k").over(W.partitionBy("user_id").orderBy("event_id")).alias("dst"))
    on = G.strong_components(items.where("event_type = 'purchase' and node <> dst").select("g", F.col("node").alias("src"), "dst"))
    members = on.groupBy("g", "component").agg(F.concat(F.lit("cycle "), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), "-")).alias("cycle"))
    o = items.hint("merge").join(on.join(members, ["g", "component"]), ["g", "node"]).select("event_id", "cycle")
    note = F.concat_ws("; ", "cycle", "conflicts", "update")
    return n.join(o, "event_id", "left").join(c, "event_id", "left").select("event_id", note.alias("note")).where("note <> ''")


@query(f"with s as {BM25} select q.item_id as q_id, count(s.item_id) as hits, coalesce(round(max(s.score), 6), 0) as top from benchmark q left join s on s.q_id = q.item_id group by q.item_id")
def ret12_absent_probe(spark, sf_dir):
    s = bm25(spark, sf_dir, summed=True)
    return questions(spark, sf_dir).select("q_id").join(s.hint("merge"), "q_id", "left").groupBy("q_id").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.round(F.max("top"), 6), F.lit(0.0)).alias("top"))


_TRIALS = "select user_id, user_id % 4 as d, event_id, value, event_type, row_number() over (partition by user_id order by event_id desc) as back from events"
_ARMS = f"(select user_id, d, arm, event_id, value, back, case when arm = 'none' then true when arm = 'supersede' then back = 1 or back > d + 2 else back <> 2 end as live from ({_TRIALS}), (values ('none'), ('supersede'), ('contradicts')) t(arm) where back <= d + 2)"


@query(f"select arm, d, count(*) as trials, avg(current::int) as accuracy, avg(in_pool::int) as newest_in_pool from (select arm, d, user_id, max_by(back, [value, -back]) filter (live) = 1 as current, bool_or(back = 1 and rank <= 3) as in_pool from (select *, row_number() over (partition by arm, user_id order by value desc, back) as rank from {_ARMS}) group by all) group by arm, d")
def ret13_supersession_distance(spark, sf_dir):
    """Each user is a trial: the newest event is the update, d + 1 events before it restate the old value. How often the top hit
    by score is the update, by arm: without edges, with superseded items hidden, with the last restatement contradicted."""
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    t = table(spark, sf_dir, "events").select("user_id", (F.col("user_id") % 4).alias("d"), "value", back.alias("back")).where("back <= d + 2")
    a = t.withColumn("arm", F.explode(F.array(F.lit("none"), F.lit("supersede"), F.lit("contradicts"))))
    live = F.when(F.col("arm") == "none", F.lit(True)).when(F.col("arm") == "supersede", F.col("back") == 1).otherwise(F.col("back") != 2)
    a = a.withColumn("live", live).withColumn("rank", F.row_number().over(W.partitionBy("arm", "user_id").orderBy(F.desc("value"), "back")))
    one = a.groupBy("arm", "d", "user_id").agg((F.max_by("back", F.when(F.col("live"), F.struct("value", -F.col("back")))) == 1).alias("current"), F.bool_or((F.col("back") == 1) & (F.col("rank") <= 3)).alias("in_pool"))
    return one.groupBy("arm", "d").agg(F.count("*").alias("trials"), F.avg(F.col("current").cast("int")).alias("accuracy"), F.avg(F.col("in_pool").cast("int")).alias("newest_in_pool"))


@query(sql("select tag, count(*) filter (tier = 'T4' and verdict = 'correct') - count(*) filter (tier = 'T1' and verdict = 'correct') as lift, tag <> 'novel' as flagged from v group by tag"))
def ret14_known_split(spark, sf_dir):
    from memlift.plans.attribution_plans import verdicts

    right = lambda t: F.count_if((F.col("tier") == t) & (F.col("verdict") == "correct"))
    return verdicts(spark, sf_dir).groupBy("tag").agg((right("T4") - right("T1")).alias("lift")).withColumn("flagged", F.col("tag") != "novel")


@query(f"with q as (select item_id as q_id, unnest({_TERMS}) as t from benchmark) select q_id, conv_id, turn, score from (select *, row_number() over (partition by q_id order by score desc, conv_id desc, turn desc) as r from (select q_id, conv_id, turn, sum(length(t))::bigint as score from conversations join q on contains(lower(role || ' ' || text), t) group by all)) where r <= 5")
def ret15_length_score(spark, sf_dir):
    """Lengths of the question's terms that occur in role and text put together; newest first on ties."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.lower(F.concat_ws(" ", "role", "text"))).alias("bodies"))
    s = R.term_scores(terms_of(spark, sf_dir), rows, ["conv_id", "turn"], 5, False, by_length=True)
    return O.top_k(s, "q_id", [F.desc("score"), F.desc("conv_id"), F.desc("turn")], 5).select("q_id", "conv_id", "turn", "score")

