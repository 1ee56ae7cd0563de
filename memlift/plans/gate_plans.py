"""Queries of gates. A report's SQL has the same checks as a union of counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlift.functions import policy as P
from memlift.functions import text as T
from memlift.operators import attribution as A
from memlift.operators import gates as G
from memlift.operators import sampling as S
from memlift.plans.attribution_plans import _DRAW, _REPS, BASE, _COUNTS, _RATES, replicated, segments, served, verdicts
from memlift.plans.registry import query, table
from memlift.plans.source_plans import folder


# what a submitter states by ability, beside what the rows give; a few statements are wrong on purpose, so each check can fail
_CLAIMS = f"""r as (select ability, tier, {_RATES}, n from (select ability, tier, {_COUNTS} from v group by ability, tier)),
d as (select ability, max(completion) filter (tier = 'T1') as baseline, max(completion) filter (tier = 'T4') as treatment, max(n) as clusters from r group by ability),
claim as (select *, treatment - baseline as derived, treatment - baseline + case when ability = 3 then 0.5 else 0 end as score, case when ability = 4 then 'naive' else 'paired-cluster' end as method,
  case when ability = 1 then clusters + 1 else clusters end as stated, treatment - baseline + 98 / sqrt(clusters) * case when ability = 2 then 1 else -1 end as lower, treatment - baseline + 98 / sqrt(clusters) * case when ability = 2 then -1 else 1 end as upper,
  case when ability = 0 then 'no hash' else md5(ability::varchar) end as artifact from d)"""


def claims(spark, sf_dir):
    """ability, baseline, treatment, clusters and derived (from the rows), and as stated: score, method, stated, lower, upper, artifact."""
    at = lambda t: F.max(F.when(F.col("tier") == t, F.col("completion")))
    d = A.rates(A.count_outcomes(verdicts(spark, sf_dir), [["ability", "tier"]])).groupBy("ability").agg(at("T1").alias("baseline"), at("T4").alias("treatment"), F.max("n").alias("clusters"))
    d = d.withColumn("derived", F.col("treatment") - F.col("baseline"))
    margin, turned = 98 / F.sqrt("clusters"), F.when(F.col("ability") == 2, -1).otherwise(1)
    return d.select(
        "*",
        (F.col("derived") + F.when(F.col("ability") == 3, 0.5).otherwise(0.0)).alias("score"),
        F.when(F.col("ability") == 4, "naive").otherwise("paired-cluster").alias("method"),
        F.when(F.col("ability") == 1, F.col("clusters") + 1).otherwise(F.col("clusters")).alias("stated"),
        (F.col("derived") - margin * turned).alias("lower"),
        (F.col("derived") + margin * turned).alias("upper"),
        F.when(F.col("ability") == 0, "no hash").otherwise(F.md5(F.col("ability").cast("string").cast("binary"))).alias("artifact"),
    )


def checks(*pairs: tuple[str, str]) -> str:
    """SQL of a report from (name, query of one count)."""
    return " union all ".join(f"select '{n}' as \"check\", ({q})::bigint = 0 as passed, ({q})::bigint as n_bad" for n, q in pairs)


@query(checks(("price is positive", "select count(*) from orders where not o_totalprice > 0"), ("status is known", "select count(*) from orders where o_orderstatus not in ('O', 'F')"), ("lines have orders", "select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)")))
def gt1_collect_checks(spark, sf_dir):
    """All checks of two tables, each reported."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return G.together(G.report(o, {"price is positive": ~(F.col("o_totalprice") > 0), "status is known": ~F.col("o_orderstatus").isin("O", "F")}), G.missing(lines, o, "o_orderkey", "lines have orders"))


@query(checks(("name form", "select count(*) from customer where not regexp_matches(c_name, '^Customer#[0-9]+$')"), ("name length", "select count(*) from customer where length(c_name) not between 3 and 40"), ("segment form", "select count(*) from customer where not regexp_matches(c_mktsegment, '^[A-Z]+$')")))
def gt2_envelope(spark, sf_dir):
    return G.report(table(spark, sf_dir, "customer"), {"name form": ~F.col("c_name").rlike("^Customer#[0-9]+$"), "name length": ~F.length("c_name").between(3, 40), "segment form": ~F.col("c_mktsegment").rlike("^[A-Z]+$")})


_MANIFESTS = """run as (select conv_id % 5 as ability, 4 * count(*) as expected, md5('reader|' || count(distinct conv_id)::varchar) as fingerprint, conv_id % 5 = 3 as mock from segs group by ability, mock),
judge as (select ability, count(*) - case when ability = 2 then 1 else 0 end as judged, count(*) filter (verdict = 'gullible' and tier = 'T1') as errors, any_value(case when ability = 1 then 'drifted' else f end) as fingerprint
  from v join (select conv_id % 5 as ability, md5('reader|' || count(distinct conv_id)::varchar) as f from segs group by 1) using (ability) group by ability)"""


@query(
    f"with {BASE}, {_MANIFESTS} "
    + checks(
        ("every cell is judged", "select count(*) from run join judge using (ability) where expected <> judged"),
        ("one fingerprint", "select count(*) from run r join judge j using (ability) where r.fingerprint <> j.fingerprint"),
        ("no mock reader", "select count(*) from run where mock"),
        ("no backend error", "select count(*) from judge where errors > 0"),
        ("every run has a judge", "select count(*) from run where ability not in (select ability from judge)"),
    )
)
def gt3_manifest_agreement(spark, sf_dir):
    """Manifests of runs (one an ability) against those of their judges: cells, pinned fingerprints, mocks and errors. One
    manifest misses a cell, one has another fingerprint and one is a mock's, and must be found."""
    s = segments(spark, sf_dir).withColumn("ability", F.col("conv_id") % 5)
    print_ = F.md5(F.concat(F.lit("reader|"), F.countDistinct("conv_id").cast("string")).cast("binary"))
    run = s.groupBy("ability").agg((4 * F.count("*")).alias("expected"), print_.alias("fingerprint")).withColumn("mock", F.col("ability") == 3)
    judge = verdicts(spark, sf_dir).groupBy("ability").agg(F.count("*").alias("n"), F.count_if((F.col("verdict") == "gullible") & (F.col("tier") == "T1")).alias("errors"))
    judge = judge.join(run.select("ability", F.col("fingerprint").alias("seen")), "ability").select("ability", (F.col("n") - F.when(F.col("ability") == 2, 1).otherwise(0)).alias("judged"), "errors", F.when(F.col("ability") == 1, "drifted").otherwise(F.col("seen")).alias("seen"))
    both = run.join(judge, "ability", "left")
    there = F.col("judged").isNotNull()
    return G.report(
        both,
        {
            "every cell is judged": there & (F.col("expected") != F.col("judged")),
            "one fingerprint": there & (F.col("fingerprint") != F.col("seen")),
            "no mock reader": F.col("mock"),
            "no backend error": there & (F.coalesce("errors", F.lit(0)) > 0),
            "every run has a judge": ~there,
        },
    )


@query(
    f"with {BASE} "
    + checks(
        ("known tiers", "select count(*) from v where tier not in ('T1', 'T2', 'T3', 'T4')"),
        ("T1 never calls the store", "select count(*) from v where tier = 'T1' and store_call"),
        ("other tiers call it", "select count(*) from v where tier <> 'T1' and not store_call"),
        ("no cell twice", "select count(*) from (select seg_id, tier from v group by all having count(*) > 1)"),
        ("all four tiers", "select count(*) from (select seg_id from v group by seg_id having count(distinct tier) <> 4)"),
        ("one ability", "select count(*) from (select seg_id from v group by seg_id having count(distinct ability) <> 1)"),
    )
)
def gt4_transcript_structure(spark, sf_dir):
    return G.transcript_structure(verdicts(spark, sf_dir))


# each ability's interval of T4-T1 from resampled segments, in points, and as stated: two of them wrong on purpose
_INTERVALS = f"""{_REPS}, abilities as (select distinct seg_id, ability from v), num as (select means.*, ability, row_number() over (partition by ability order by seg_id) - 1 as place, count(*) over (partition by ability) as n from means join abilities using (seg_id)),
picks as (select ability, (k - 1) // n as b, floor(u * n)::bigint as place from {_DRAW} join (select distinct ability, n from num where n > 1) on k <= 2000 * n),
deltas as (select ability, b, 100 * (sum("T4") - sum("T1")) / any_value(n) as value from picks join num using (ability, place) group by ability, b),
interval as (select ability, round(list_sort(list(value))[floor(0.025 * (count(*) - 1))::bigint + 1], 6) as low, round(list_sort(list(value))[floor(0.975 * (count(*) - 1))::bigint + 1], 6) as high from deltas group by ability),
stated as (select claim.* exclude (lower, upper), low, high, case ability when 2 then high when 3 then low - 1 else low end as lower, case ability when 2 then low else high end as upper from claim left join interval using (ability))"""


@query(
    f"with {BASE}, {_CLAIMS}, {_INTERVALS} "
    + checks(
        ("method is paired", "select count(*) from stated where method <> 'paired-cluster'"),
        ("clusters agree", "select count(*) from stated where stated <> clusters"),
        ("score is derived", "select count(*) from stated where not abs(score - derived) < 1e-9"),
        ("interval in order", "select count(*) from stated where coalesce(lower > upper, true)"),
        ("interval agrees", "select count(*) from stated where not coalesce(abs(lower - low) < 1e-6 and abs(upper - high) < 1e-6, false)"),
    )
)
def gt5_statistics(spark, sf_dir):
    """Stated statistics by ability against those that the rows give; intervals are worked out anew from resampled segments."""
    ability = verdicts(spark, sf_dir).select("seg_id", "ability").distinct()
    means = S.cluster_means(replicated(spark, sf_dir)).join(ability, "seg_id")
    again = S.paired_bootstrap(means, by="ability").where("metric = 'T4-T1'").select("ability", F.round(100 * F.col("lower"), 6).alias("low"), F.round(100 * F.col("upper"), 6).alias("high"))
    turned, widened = F.col("ability") == 2, F.col("ability") == 3
    stated = claims(spark, sf_dir).drop("lower", "upper").join(again, "ability", "left")
    stated = stated.withColumn("lower", F.when(turned, F.col("high")).when(widened, F.col("low") - 1).otherwise(F.col("low"))).withColumn("upper", F.when(turned, F.col("low")).otherwise(F.col("high")))
    return G.report(stated, G.statistics())


@query(f"with {BASE} " + checks(("at least 30 segments an ability", "select count(*) from (select ability from v group by ability having count(distinct seg_id) < 30)"), ("balanced tiers", "select count(*) from (select ability from (select ability, tier, count(*) as n from v group by all) group by ability having count(distinct n) > 1)")))
def gt6_architecture(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    per = v.groupBy("ability").agg(F.countDistinct("seg_id").alias("segments"))
    even = v.groupBy("ability", "tier").count().groupBy("ability").agg(F.countDistinct("count").alias("sizes"))
    return G.together(G.report(per, {"at least 30 segments an ability": F.col("segments") < 30}), G.report(even, {"balanced tiers": F.col("sizes") > 1}))


@query("""select o_orderstatus, o_orderpriority, substr(sha256('{"n":' || count(*)::varchar || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'), 1, 12) as control_key from orders group by o_orderstatus, o_orderpriority""")
def gt7_control_key(spark, sf_dir):
    """Twelve digits of the hash of all pinned inputs of a run, as JSON with sorted keys."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return o.select("o_orderstatus", "o_orderpriority", F.substring(F.sha2(F.to_json(F.struct("n", "o_orderpriority", "o_orderstatus")).cast("binary"), 256), 1, 12).alias("control_key"))


# a set of rows as four sums of parts of their hashes: no order, no arrays, partial sums before the shuffle
_SUMS = "concat_ws('.', count(*)::varchar, " + ", ".join(f"sum(('0x' || substr(h, {i}, 15))::ubigint::hugeint)::varchar" for i in (1, 16, 31, 46)) + ")"


@query(
    f"with c as (select lang, {_SUMS} as digest, count(*) as n from (select lang, sha256(doc_id::varchar || chr(10) || text) as h from documents) group by lang), "
    f"l as (select lang, {_SUMS} as locked from (select lang, sha256(doc_id::varchar || chr(10) || case when lang = 'en' and doc_id % 100 = 7 then text || '!' else text end) as h from documents) group by lang) "
    "select lang, digest = locked as attested, n from c join l using (lang)"
)
def gt8_attestation(spark, sf_dir):
    """Digest of each language's documents against a lock table that was written before. The lock has another version of a
    few documents, so their language isn't attested."""
    d = table(spark, sf_dir, "documents")

    def digests(text, name):
        h = F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), text).cast("binary"), 256)
        sums = [F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in (1, 16, 31, 46)]
        return d.groupBy("lang").agg(F.concat_ws(".", F.count("*").cast("string"), *sums).alias(name), F.count("*").alias("n"))

    at = folder(spark)
    digests(F.when((F.col("lang") == "en") & (F.col("doc_id") % 100 == 7), F.concat("text", F.lit("!"))).otherwise(F.col("text")), "locked").drop("n").write.parquet(at)
    lock = spark.read.schema("lang string, locked string").parquet(at)
    return digests(F.col("text"), "digest").join(lock, "lang").select("lang", (F.col("digest") == F.col("locked")).alias("attested"), "n")


@query(
    f"with {BASE}, ctx as (select q_id as seg_id, tier, list_sort(list(item_id)) as ids from served group by all), "
    "m as (select v.seg_id, v.tier, v.served_count, v.external, case when v.seg_id % 13 = 0 then ids[2:] else ids end as context, len(ids) as traces from v left join ctx using (seg_id, tier)) "
    + checks(
        ("context has the served count", "select count(*) from m where coalesce(len(context), 0) <> served_count"),
        ("a trace for each served", "select count(*) from m where coalesce(traces, 0) <> served_count"),
        ("T1 has no context", "select count(*) from m where tier = 'T1' and len(context) > 0"),
        ("no more than eight or sixteen served", "select count(*) from m where served_count > case when tier = 'T3' then 16 else 8 end"),
        ("external within served", "select count(*) from m where external > served_count"),
        ("as many cells in each tier", "select count(distinct n) - 1 from (select count(*) as n from m group by tier)"),
    )
)
def gt9_matrix(spark, sf_dir):
    """Arrays and traces of what each cell was served (sixteen at most) against its count; cells of every thirteenth segment
    lost an item on purpose."""
    ctx = served(spark, sf_dir).groupBy(F.col("q_id").alias("seg_id"), "tier").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    m = verdicts(spark, sf_dir).join(ctx.hint("merge"), ["seg_id", "tier"], "left").withColumn("traces", F.coalesce(F.size("ids"), F.lit(0)))
    held = F.when(F.col("ids").isNull(), 0).when(F.col("seg_id") % 13 == 0, F.col("traces") - 1).otherwise(F.col("traces"))
    rows = G.report(
        m,
        {
            "context has the served count": held != F.col("served_count"),
            "a trace for each served": F.col("traces") != F.col("served_count"),
            "T1 has no context": (F.col("tier") == "T1") & (held > 0),
            "no more than eight or sixteen served": F.col("served_count") > F.when(F.col("tier") == "T3", 16).otherwise(8),
            "external within served": F.col("external") > F.col("served_count"),
        },
    )
    sizes = m.groupBy("tier").count().agg((F.countDistinct("count") - 1).alias("n_bad"))
    return G.together(rows, sizes.select(F.lit("as many cells in each tier").alias("check"), (F.col("n_bad") == 0).alias("passed"), "n_bad"))


@query(
    f"with {BASE}, stored as (select ability, tier, {_COUNTS} from v group by ability, tier), told as (select ability, tier, n, case when ability = 2 and tier = 'T4' then completed + 1 else completed end as completed, gullible from stored) "
    "select (select count(*) from ((select ability, tier, n, completed, gullible from stored) except all (select ability, tier, count(*), count(*) filter (outcome = 'completed'), count(*) filter (outcome = 'gullible') from v group by ability, tier))) as differences, "
    "(select count(*) from ((select * from told) except all (select ability, tier, n, completed, gullible from stored))) as sabotaged"
)
def gt10_recompute(spark, sf_dir):
    """A stored summary against one made again from the verdicts, and a second whose one cell was raised, which must differ."""
    v, at = verdicts(spark, sf_dir), folder(spark)
    A.count_outcomes(v, [["ability", "tier"]]).select("ability", "tier", "n", "completed", "gullible").write.parquet(at)
    stored = spark.read.schema("ability long, tier string, n long, completed long, gullible long").parquet(at)
    of = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    again = v.groupBy("ability", "tier").agg(F.count("*").alias("n"), of("completed"), of("gullible"))
    raised = stored.withColumn("completed", F.col("completed") + F.when((F.col("ability") == 2) & (F.col("tier") == "T4"), 1).otherwise(0))
    one, two = (x.exceptAll(again).agg(F.count("*").alias(n)) for x, n in ((stored, "differences"), (raised, "sabotaged")))
    return one.crossJoin(F.broadcast(two))  # one row each


_RUNS = "select o_orderpriority as run, min(o_orderstatus) as reader, max(o_orderstatus) as classifier, count(distinct o_orderstatus) as design, min(year(o_orderdate)) as corpus, min(o_orderpriority) as prompt from orders group by o_orderpriority"


@query(" union all ".join(f"select '{c}' as \"check\", count(distinct {c}) <= 1 as passed, greatest(count(distinct {c}) - 1, 0) as n_bad from ({_RUNS})" for c in ("reader", "classifier", "design", "corpus", "prompt")))
def gt11_isolation(spark, sf_dir):
    """Runs of one comparison, one a priority: all that isn't under test must be the same. The prompt differs and is found."""
    o = table(spark, sf_dir, "orders")
    runs = o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.min("o_orderstatus").alias("reader"), F.max("o_orderstatus").alias("classifier"), F.countDistinct("o_orderstatus").alias("design"), F.min(F.year("o_orderdate")).alias("corpus"), F.min("o_orderpriority").alias("prompt"))
    return G.constant(runs, "reader", "classifier", "design", "corpus", "prompt")


@query(checks(("turns are contiguous", "select count(*) from (select conv_id from conversations group by conv_id having max(turn) <> count(*) - 1)"), ("no turn twice", "select count(*) from (select conv_id, turn from conversations group by all having count(*) > 1)"), ("answer not in the question", "select count(*) from (select text, lead(text) over (partition by conv_id order by turn) as nxt from conversations) where contains(text, nxt)")))
def gt12_segments(spark, sf_dir):
    from memlift.plans.text_plans import turn_pairs

    c = table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg((F.max("turn") != F.count("*") - 1).alias("gap"))
    return G.together(G.report(per, {"turns are contiguous": F.col("gap")}), G.repeated_keys(c, "no turn twice", "conv_id", "turn"), G.report(turn_pairs(spark, sf_dir), {"answer not in the question": F.col("a").contains(F.col("b"))}))


@query(
    f"with {BASE}, {_CLAIMS} "
    + checks(
        ("interval in order", "select count(*) from claim where not (lower <= upper)"),
        ("score is treatment less baseline", "select count(*) from claim where not abs(score - (treatment - baseline)) < 1e-9"),
        ("rates within 0 and 100", "select count(*) from claim where baseline not between 0 and 100 or treatment not between 0 and 100"),
        ("lift within -100 and 100", "select count(*) from claim where score not between -100 and 100"),
        ("hex hash", "select count(*) from claim where not regexp_matches(artifact, '^[0-9a-f]{32}$')"),
    )
)
def gt13_board_rows(spark, sf_dir):
    """Constraints of a board's rows; the statements that are wrong on purpose break three of them."""
    return G.report(
        claims(spark, sf_dir),
        {
            "interval in order": ~(F.col("lower") <= F.col("upper")),
            "score is treatment less baseline": ~(F.abs(F.col("score") - (F.col("treatment") - F.col("baseline"))) < 1e-9),
            "rates within 0 and 100": ~(F.col("baseline").between(0, 100) & F.col("treatment").between(0, 100)),
            "lift within -100 and 100": ~F.col("score").between(-100, 100),
            "hex hash": ~F.col("artifact").rlike("^[0-9a-f]{32}$"),
        },
    )


@query(checks(("discount within price", "select count(*) from lineitem where l_discount > 1"), ("one row a child", "select count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)"), ("has a parent", "select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)")))
def gt14_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return G.together(G.report(lines, {"discount within price": F.col("l_discount") > 1}), G.repeated_keys(lines, "one row a child", "l_orderkey", "l_linenumber"), G.missing(lines, parents, "l_orderkey", "has a parent"))


@query("select l_orderkey, l_linenumber, l_partkey, case when o_orderstatus = 'F' then 'withdrawn' else l_linestatus end as status from lineitem join orders on l_orderkey = o_orderkey")
def gt15_propagate(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("o_orderstatus") == "F", "withdrawn").otherwise(F.col("l_linestatus")).alias("status"))


@query("select o_orderpriority, count(*) as runs, count(distinct sha256(o_orderstatus || ':' || floor(o_totalprice / 100000)::bigint::varchar)) as digests, count(*) filter (o_orderstatus = 'P') as signals from orders group by o_orderpriority")
def gt16_repeat_audit(spark, sf_dir):
    body = F.concat_ws(":", "o_orderstatus", F.floor(F.col("o_totalprice") / 100000).cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("runs"), F.countDistinct(T.masked_digest(body)).alias("digests"), F.count_if(F.col("o_orderstatus") == "P").alias("signals"))


@query("select count(*) filter (a.event_type <> a.lagged) as flips, count(*) filter (a.constant <> a.lagconst) as sabotaged from (select event_type, lag(event_type) over w as lagged, 'x' as constant, lag('x') over w as lagconst from events window w as (partition by user_id order by event_id)) a")
def gt17_negative_control(spark, sf_dir):
    """The flip count must fall to nothing when all values are made one."""
    from memlift.operators.windows import flips

    e = table(spark, sf_dir, "events")
    real = flips(e, "user_id", "event_id", "event_type").agg(F.count("*").alias("flips"))
    fake = flips(e.withColumn("event_type", F.lit("x")), "user_id", "event_id", "event_type").agg(F.count("*").alias("sabotaged"))
    return real.crossJoin(F.broadcast(fake))  # one row each


@query(
    "with y as (select year(o_orderdate)::int as y, count(*) as n from orders group by all), c as (select * from (values ('implicit-june-created-year', '-06-30'), ('explicit-leap-february', '2024-02-29'), ('explicit-q2', '2025-06-30'), ('inclusive-through-month', '2023-12-31'), ('timeless', null), "
    "('equal-boundary-is-expired', null), ('one-ms-before-is-current', null), ('one-ms-after-is-expired', null), ('timeless-is-current', null)) t(name, d)) "
    "select y, n, name, case when d like '-%' then y::varchar || d else d end || 'T23:59:59.999Z' as expires, true as holds from y, c"
)
def gt18_policy_witness(spark, sf_dir):
    """The nine frozen cases of the expiry rules, and what their texts give for the orders of each year."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("created"))
    return years.select("y", "n", F.inline(P.witnesses(F.col("created"))))


@query("select class, count(*) as n, class = 'measured' as comparable from (select case when event_type = 'error' then 'mock' when value < 5 then 'smoke' else 'measured' end as class from events) group by class")
def gt19_evidence_class(spark, sf_dir):
    c = F.when(F.col("event_type") == "error", "mock").when(F.col("value") < 5, "smoke").otherwise("measured")
    return table(spark, sf_dir, "events").groupBy(c.alias("class")).agg(F.count("*").alias("n")).withColumn("comparable", F.col("class") == "measured")
