"""The queries of this folder's operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlift.llm import embed_dedup, filter_audit, html_extract, mixing, ngram_join, para_dedup, personal_data, piece_lattice, product_codes, quality_rules, secret_scan, token_counts, toxicity
from memlift.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).drop("class_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_para_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return para_dedup.dedup_paragraphs(table(spark, sf_dir, "documents"), least_words=para_dedup.MIN_RUN)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embed_dedup, op3_quality_rules, op4_secret_scan, op5_mixing, op6_para_dedup, op7_html_extract, op8_piece_lattice, op9_ngram_join, op10_token_counts, op11_product_codes, op12_filter_audit, op13_personal_data)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double))"

#: All pairs compared in plain SQL; the other operators can't be said in SQL and are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_embed_dedup": f"""with recursive v as (select vec_id, embedding as e, label from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where {_DOT.format("a.e", "b.e")} / sqrt({_DOT.format("a.e", "a.e")} * {_DOT.format("b.e", "b.e")}) >= 0.98),
c as (select vec_id as id, vec_id as r from embeddings union select p.b, c.r from c join p on c.id = p.a),
m as (select id, min(r) as component_id from c group by id)
select vec_id, (select count(*) from p where a = vec_id) as n_links, component_id, component_id = vec_id as kept from embeddings join m on id = vec_id""",
    "op9_ngram_join": f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
u as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by all having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
c as (select doc_id as id, doc_id as r from documents union select p.b, c.r from c join p on c.id = p.a)
select doc_id, len(s)::bigint as n_shingles, min(r) as component_id from s join c on id = doc_id group by doc_id, s""",
}


def _codes_sql(rounds: int = product_codes.ROUNDS) -> str:
    """Every part compared with every entry, round after round, for vectors of one length."""
    far = "list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v)"
    out = f"""with kept as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::double) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select rid, p.part, v[len(v) * p.part // 4 + 1:len(v) * (p.part + 1) // 4] as v from kept, range(4) p(part)),
first as (select rid, row_number() over (order by vec_id nulls last, v) - 1 as entry from kept qualify entry < 256),
c0 as materialized (select part, entry, v from p join first using (rid))"""
    for r in range(rounds + 1):
        out += f""",
a{r} as materialized (select rid, p.part, any_value(p.v) as v, min(struct_pack(far := ({far})::bigint, entry := c.entry)) as best from p join c{r} c on p.part = c.part group by rid, p.part)"""
        if r < rounds:
            out += f""",
s{r} as (select part, entry, list(x order by i) as v from (select part, best.entry as entry, i, floor(sum(v[i]) / count(*)) as x from a{r}, range(1, 1025) g(i) where i <= len(v) group by all) group by all),
c{r + 1} as materialized (select part, entry, coalesce(s.v, c.v) as v from c{r} c left join s{r} s using (part, entry))"""
    return out + f""",
coded as (select rid, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' order by part) as code, sum(best.far)::bigint as error from a{rounds} group by rid),
digest as (select sha256(string_agg(x::bigint::varchar, ',' order by part, entry, i)) as sha from (select part, entry, unnest(v) as x, generate_subscripts(v, 1) as i from c{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256 from coded join kept using (rid), digest"""


ORACLE_SQL["op11_product_codes"] = _codes_sql()
ORACLE_SQL["op12_filter_audit"] = """with recursive flags as (select doc_id as id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask from w left join flags on doc_id = id),
cells as materialized (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
filters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
orders as (select letter as filter_order, bit as used, 1 as k from filters union all select filter_order || letter, used | bit, k + 1 from orders join filters on used & bit = 0),
steps as (select filter_order, step, letter, bit, (select coalesce(sum(bit), 0)::int from filters where position(letter in left(filter_order, step - 1)) > 0) as applied
    from orders, range(1, 6) s(step), filters where k = 5 and letter = filter_order[step]),
r as (select part, filter_order, step, letter,
    sum(case when mask & (applied | bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & applied = 0 and mask & bit > 0 then n else 0 end)::bigint as removed,
    sum(case when mask & applied > 0 and mask & bit > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & applied = 0 and mask & bit > 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & applied = 0 and mask & bit > 0 then toxic else 0 end)::bigint as toxic_lost
    from cells, steps group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r"""
