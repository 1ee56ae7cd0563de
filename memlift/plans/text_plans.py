"""Queries of the text and policy functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memlift.functions import policy as P
from memlift.functions import text as T
from memlift.functions.unicode import nfkc
from memlift.operators import sampling
from memlift.plans.registry import query, table
from memlift.shipping import ship


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


def sql_tokens(x: str, stop=T.STOP) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) > 2 and not list_contains({sql_list(stop)}, w))"


def sql_jaccard(a: str, b: str) -> str:
    return f"(case when len(list_distinct(list_concat({a}, {b}))) = 0 then 0.0 else len(list_intersect(list_distinct({a}), list_distinct({b})))::double / len(list_distinct(list_concat({a}, {b}))) end)"


PAIRS = "(select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations)"


def turn_pairs(spark, sf_dir):
    """Each turn with the next one of its conversation."""
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), nxt.alias("b")).where("b is not null")


@query(f"select conv_id, turn, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select conv_id, turn, {sql_tokens('text')} as t from conversations)")
def fn1_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(
    rf"""select conv_id, turn, array_to_string(list_slice(u, 1, 10), ' ') as terms from (
  select conv_id, turn, list_filter(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]), lambda w: true) as u from (
    select conv_id, turn, list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(regexp_replace(w, '[^\p{{L}}\p{{N}}_-]', '', 'g'), '^[_-]+|[_-]+$', '', 'g')), lambda w: length(w) >= 3 and not list_contains({sql_list(T.QUERY_STOP)}, w)) as t from conversations))"""
)
def fn2_query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


_A, _B = sql_tokens("a", ("the", "and", "for", "her", "was", "had")), sql_tokens("b", ("the", "and", "for", "her", "was", "had"))
_C, _D = sql_tokens("a", T.CONTRADICTION_STOP), sql_tokens("b", T.CONTRADICTION_STOP)


@query(
    rf"""select conv_id, turn, round(j, 6) as similarity, js >= 0.4 and na <> '' and nb <> '' and na <> nb as strict,
  j >= 0.3 or coalesce(ma <> '' and mb <> '' and try_cast(ma as hugeint) <> try_cast(mb as hugeint), false) as loose
from (select *, {sql_jaccard('ta', 'tb')} as j, {sql_jaccard('sa', 'sb')} as js from (
  select conv_id, turn, {_A} as sa, {_B} as sb, {_C} as ta, {_D} as tb, regexp_extract(a, '(\d+)', 1) as na, regexp_extract(b, '(\d+)', 1) as nb,
    replace(regexp_extract(a, '(\d[\d,]*)', 1), ',', '') as ma, replace(regexp_extract(b, '(\d[\d,]*)', 1), ',', '') as mb from {PAIRS} where b is not null))"""
)
def fn3_literal_contradiction(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    j = T.jaccard(T.tokens(a, T.CONTRADICTION_STOP), T.tokens(b, T.CONTRADICTION_STOP))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(j, 6).alias("similarity"), T.strict_contradiction(a, b).alias("strict"), T.loose_contradiction(a, b).alias("loose"))


@query(
    r"""select item_id, upper(replace(regexp_replace(regexp_replace(trim(replace(regexp_replace(t, '(?i)```(?:json|text)?', '', 'g'), '```', ''), ' ' || chr(9) || chr(10) || chr(13)), '^[''"`]+|[''"`]+$', '', 'g'), '\s+', '', 'g'), 'ß', 'SS')) as answer from (select item_id, translate(replace(case when item_id % 3 = 0 then translate(text, 'aeno', 'ａｅｎｏ') when item_id % 3 = 1 then replace(text, 'fi', 'ﬁ') else text end, 'ﬁ', 'fi'), 'ａｅｎｏ', 'aeno') as t from benchmark)"""
)
def fn4_normal_answer(spark, sf_dir):
    """Answers come in wide letters, with ligatures, or plain; NFKC makes them one."""
    k = F.col("item_id") % 3
    given = F.when(k == 0, F.translate("text", "aeno", "ａｅｎｏ")).when(k == 1, F.replace("text", F.lit("fi"), F.lit("ﬁ"))).otherwise(F.col("text"))
    ship(spark)
    return table(spark, sf_dir, "benchmark").select("item_id", T.normal_answer(nfkc(given)).alias("answer"))


@query(
    r"""select conv_id, turn, upper(replace(regexp_replace(regexp_replace(trim(text, ' ' || chr(10)), '^[''"`]+|[''"`.,;:!?]+$', '', 'g'), '^\s+|\s+$', '', 'g'), 'ß', 'SS')) as exact,
  regexp_replace(lower(text), '[\s\p{P}\p{S}]+', '', 'g') as leak from conversations"""
)
def fn5_normal_exact_leak(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normal_exact(F.col("text")).alias("exact"), T.normal_leak(F.col("text")).alias("leak"))


@query(
    r"""select conv_id, turn, len(hits) as n_hits, array_to_string(hits, '|') as hits from (
  select conv_id, turn, list_filter(p, lambda v: v <> '' and (contains(lower(b), lower(v)) or (length(regexp_replace(lower(v), '[\s\p{P}\p{S}]+', '', 'g')) >= 8 and contains(regexp_replace(lower(b), '[\s\p{P}\p{S}]+', '', 'g'), regexp_replace(lower(v), '[\s\p{P}\p{S}]+', '', 'g'))))) as hits
  from (select conv_id, turn, b, string_split(a, ' ') as p from """
    + PAIRS
    + """ where b is not null))"""
)
def fn6_literal_leak(spark, sf_dir):
    d = turn_pairs(spark, sf_dir).withColumn("p", F.split("a", " "))
    hits = T.leaked(F.col("b"), F.col("p"))
    return d.select("conv_id", "turn", F.size(hits).cast("long").alias("n_hits"), F.array_join(hits, "|").alias("hits"))


@query(rf"select doc_id, regexp_matches(text, '{T.VALUE_LEAK}') as leaks from documents")
def fn7_value_leak(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(T.VALUE_LEAK).alias("leaks"))


_INJECT = "(?i)" + "|".join(P.INJECTION).replace("'", "''")


@query(rf"select doc_id, regexp_matches(text, '{_INJECT}') as injected, md5(case when regexp_matches(text, '{_INJECT}') then '{P.FLAG}' || text else text end) as body_md5 from documents")
def fn8_injection_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.injected(F.col("text")).alias("injected"), F.md5(P.flagged(F.col("text")).cast("binary")).alias("body_md5"))


@query()
def fn9_sensitivity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.sensitivity(F.col("text")).alias("sensitivity"), F.size(P.cards(F.col("text"))).cast("long").alias("n_cards"))


_NOTE = "case o_orderkey % 4 when 0 then 'valid through ' || strftime(o_orderdate, '%B') || ' ' || strftime(o_orderdate, '%Y') when 1 then 'review in Q' || ((month(o_orderdate) - 1) // 6 + 1)::varchar when 2 then 'the mayor signs in 20' || lpad((o_orderkey % 100)::varchar, 2, '0') else 'no date' end"
_MONTH = "case when regexp_matches(n, '\\bq1\\b') then 3 when regexp_matches(n, '\\bq2\\b') then 6 " + " ".join(f"when contains(n, '{m}') then {i + 1}" for i, m in enumerate(P.MONTHS)) + " end"
_EXPIRY = f"select *, case when m is not null then strftime(last_day(make_date(y, m, 1)), '%Y-%m-%d') || 'T23:59:59.999Z' end as expires_at from (select *, {_MONTH} as m, case when regexp_extract(n, '\\b(20\\d{{2}})\\b', 1) <> '' then regexp_extract(n, '\\b(20\\d{{2}})\\b', 1)::int else year(o_orderdate)::int end as y from (select *, lower({_NOTE}) as n from orders))"


def noted_orders(spark, sf_dir):
    """Orders with a note about when they end."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    note = F.when(key % 4 == 0, F.concat(F.lit("valid through "), F.date_format(day, "MMMM"), F.lit(" "), F.date_format(day, "yyyy")))
    note = note.when(key % 4 == 1, F.concat(F.lit("review in Q"), F.floor((F.month(day) - 1) / 6 + 1).cast("string")))
    note = note.when(key % 4 == 2, F.concat(F.lit("the mayor signs in 20"), F.lpad((key % 100).cast("string"), 2, "0"))).otherwise("no date")
    return table(spark, sf_dir, "orders").withColumn("note", note).withColumn("expires_at", P.expiry(F.col("note"), day))


@query(f"select o_orderkey, expires_at from ({_EXPIRY})")
def fn10_expiry(spark, sf_dir):
    return noted_orders(spark, sf_dir).select("o_orderkey", "expires_at")


@query(f"select o_orderkey, coalesce(expires_at <= '1998-06-30T00:00:00.000Z', false) as expired from ({_EXPIRY})")
def fn11_expired(spark, sf_dir):
    return noted_orders(spark, sf_dir).select("o_orderkey", P.expired(F.col("expires_at"), F.lit("1998-06-30T00:00:00.000Z")).alias("expired"))


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9_-]', '-', 'g'), '-') as slug from part")
def fn12_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query(
    "select c_custkey, upper(substr(sha256(c_name), 1, 8)) as token, ('0x' || substr(sha256(c_name), 1, 8))::bigint % 7 as pick, "
    "list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(c_name, ''), lambda ch: ascii(ch)::hugeint)), lambda h, ch: (xor(h::bigint, ch::bigint)::hugeint * 16777619) % 4294967296)::bigint as fnv from customer"
)
def fn13_hash_token(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.hash_token(n).alias("token"), T.hash_pick(n, 7).alias("pick"), T.fnv1a(n).alias("fnv"))


_M32 = "4294967295"


def sql_times(a: str, b: str) -> str:
    return f"(({a})::hugeint * ({b})::hugeint % 4294967296)::bigint"


_STATE = "((1095582281 + k::hugeint * 1831565813) % 4294967296)::bigint"
_T1 = sql_times("xor(a, a >> 15)", "a | 1")
_T2 = f"xor(t, ((t + {sql_times('xor(t, t >> 7)', 't | 61')}) & {_M32}))"
SQL_DRAWS = f"(select k, (xor(t2, t2 >> 14) & {_M32}) / 4294967296.0::double as u from (select k, {_T2} as t2 from (select k, {_T1} as t from (select k, {_STATE} as a from (select l_orderkey * 8 + l_linenumber as k from lineitem)))))"


@query(f"select k, u from {SQL_DRAWS}")
def fn14_draws(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return k.select("k", sampling.draw(F.col("k")).alias("u"))


@query("select source, floor(980 / sqrt(count(*)) + 0.5) / 10 as margin from documents group by source")
def fn15_tier_margin(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg((T.js_round(980 / F.sqrt(F.count("*"))) / 10).alias("margin"))


@query("select doc_id, md5(case when length(text) > 700 then substr(text, 1, 700) || '…' else text end) as clip_md5, least(length(text), 701)::bigint as n from documents")
def fn16_clip(spark, sf_dir):
    c = T.clip(F.col("text"), 700)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c.cast("binary")).alias("clip_md5"), F.length(c).cast("long").alias("n"))


_REPLY = "case event_id % 5 when 0 then 'so: {\"verdict\": \"' || (case when value > 10 then 'wrong' else 'correct' end) || '\", \"reason\": \"x\"}' when 1 then 'that looks CORRECT to me' when 2 then 'gullible, not correct' when 3 then '{\"verdict\": \"maybe\"} wrong' else event_type end"


def replies(spark, sf_dir):
    """Judge replies of several shapes, from events."""
    e = F.col("event_id") % 5
    said = F.concat(F.lit('so: {"verdict": "'), F.when(F.col("value") > 10, "wrong").otherwise("correct"), F.lit('", "reason": "x"}'))
    reply = F.when(e == 0, said).when(e == 1, "that looks CORRECT to me").when(e == 2, "gullible, not correct").when(e == 3, '{"verdict": "maybe"} wrong').otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("reply", reply)


@query(f"select event_id, case when regexp_extract(r, '\"verdict\": \"(\\w+)\"', 1) in ('correct', 'wrong', 'gullible') then regexp_extract(r, '\"verdict\": \"(\\w+)\"', 1) when contains(lower(r), 'gullible') then 'gullible' when contains(lower(r), 'correct') then 'correct' else 'wrong' end as verdict from (select event_id, {_REPLY} as r from events)")
def fn17_parse_verdict(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", T.parse_verdict(F.col("reply")).alias("verdict"))


@query(
    r"""select conv_id, turn, array_to_string(list_slice(list_filter(list_transform(string_split(trim('- ' || replace(text, '. ', chr(10) || '2) '), ' ' || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''), ' ')), lambda x: length(x) > 3 and upper(x) <> 'NONE'), 1, 6), '|') as facts from conversations"""
)
def fn18_fact_list(spark, sf_dir):
    reply = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit("\n2) ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.fact_list(reply), "|").alias("facts"))


@query("select conv_id, md5(string_agg(role || ': ' || text || case when turn % 3 = 0 then ' [image: ' || turn::varchar || ']' else '' end, chr(10) order by turn)) as transcript_md5 from conversations group by conv_id")
def fn21_transcript(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" [image: "), F.col("turn").cast("string"), F.lit("]"))).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").cast("binary")).alias("transcript_md5"))


@query(
    """select conv_id, turn, len(list_filter(g, lambda x: contains(h, x))) > 0 as any_gold, len(list_filter(g, lambda x: contains(h, x))) = len(g) as all_gold
from (select conv_id, turn, regexp_replace(lower(b), '\\s+', '', 'g') as h, list_transform(string_split(a, ' '), lambda x: regexp_replace(lower(x), '\\s+', '', 'g')) as g from """
    + PAIRS
    + " where b is not null)"
)
def fn23_containment(spark, sf_dir):
    d = turn_pairs(spark, sf_dir)
    bare = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    gold = F.transform(F.split("a", " "), bare)
    return d.select("conv_id", "turn", bare(F.col("b")).alias("h"), gold.alias("g")).select("conv_id", "turn", F.exists("g", lambda x: F.col("h").contains(x)).alias("any_gold"), F.forall("g", lambda x: F.col("h").contains(x)).alias("all_gold"))


@query("select s_suppkey, upper(reverse(s_name)) || '-' || n_name as code from supplier join nation on s_nationkey = n_nationkey")
def fn24_encode(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.concat_ws("-", F.upper(F.reverse("s_name")), "n_name").alias("code"))


@query(
    """select event_id, sha256('{"actor":{"id":' || user_id::varchar || ',"kind":"' || event_type || '"},"event_id":' || event_id::varchar || ',"props":{"k":' || json_extract_string(props, '$.k') || '}}') as digest from events"""
)
def fn25_canonical_json(spark, sf_dir):
    """Digest of each event as JSON with the keys of all levels sorted, from fields that come unsorted and nested."""
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("id")).alias("actor"), F.col("event_id")).alias("x"))
    return e.select("event_id", F.sha2(F.to_json(T.sorted_struct(F.col("x"), e.schema["x"].dataType)).cast("binary"), 256).alias("digest"))


@query(
    r"""select doc_id, md5(regexp_replace(text, '(\d)-(\d)', '\1 \2')) as spaced, md5(case when regexp_extract(text, '[01]') = '0' then regexp_replace(text, '0', 'O') else regexp_replace(text, '1', 'l') end) as one_alike,
  md5(case regexp_extract(text, '[01][01]') when '00' then regexp_replace(text, '00', 'OO') when '01' then regexp_replace(text, '01', 'Ol') when '10' then regexp_replace(text, '10', 'lO') when '11' then regexp_replace(text, '11', 'll') else text end) as pair_alike,
  md5(translate(text, '0123456789', '０１２３４５６７８９')) as wide from documents"""
)
def fn26_distortions(spark, sf_dir):
    """The ladder of distortions of a text's digits: a separator swapped, the first 0 or 1 as a letter, the first pair of them as
    letters, all digits wide."""
    t = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", md5(T.separator_swapped(t)).alias("spaced"), md5(T.look_alike(t, 1)).alias("one_alike"), md5(T.look_alike(t, 2)).alias("pair_alike"), md5(F.translate(t, "0123456789", "０１２３４５６７８９")).alias("wide"))


_UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"


@query(f"select o_orderpriority, count(distinct sha256(regexp_replace('run ' || ({_UUID}) || ' ' || o_orderpriority, '{T.UUID}', '<uuid>', 'g'))) as digests from (select *, md5(o_orderkey::varchar) as m from orders) group by o_orderpriority")
def fn27_masked_digest(spark, sf_dir):
    m = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    d = table(spark, sf_dir, "orders").withColumn("body", F.concat_ws(" ", F.lit("run"), uuid, "o_orderpriority"))
    return d.groupBy("o_orderpriority").agg(F.countDistinct(T.masked_digest(F.col("body"))).alias("digests"))


@query("select o_orderkey, date_diff('day', o_orderdate, timestamp '1998-06-30') > 30 as old from orders")
def fn28_older_than_30_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(F.lit("1998-06-30").cast("date"), "o_orderdate") > 30).alias("old"))
