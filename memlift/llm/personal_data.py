"""Personal data in texts by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates of each kind come from one pattern a kind over the whole text, leftmost and non-overlapping. Five labelers
vote yes, no or nothing on each candidate: a strict form of the pattern, a check (digits that add up, parts in range), a gazetteer (top-level
domains, card issuers, calling codes, country codes, given names, street words), words of the kind just before it, and words
that speak against it (version, order, invoice). Expectation-maximisation over the counts of vote patterns gives
each labeler's rates by kind and a probability for each vote pattern; no row is labelled by hand. With these
probabilities as soft labels a naive Bayes classifier is fitted on what a span and its surroundings look like (shape, length, checks, the word
before, the sign after), over all candidates of all texts, and its score decides.

Base spans (email, ip, card, phone that pass their checks) stay whatever their score; they and the matches that fail teach the
model what is sound. The further kinds are added where the classifier's probability is one half or more and no base span
overlaps them: masked_email ("jo (at) mail dot org"), local_phone, national_id, iban, name, address.

All work on texts is DataFrame functions: one pass over the texts writes the candidates, a small table with a row a text; votes
and features are summed in tasks before they are shuffled, and at most 2,430 vote patterns and 4,096 feature buckets are left
of them, whatever the input. Nothing is joined or dealt out by a key of the data, so no source, copy or id makes a hot task.
Sums are of whole numbers and rates are rounded, so reruns agree. Patterns give no character back once taken (or a bounded number), and
places are running sums in chunks, so time is in proportion to the text's length.

Null texts are empty; empty texts have no spans. Rows are handled one by one, whatever their id (null, repeated). Further columns
don't matter. An empty table gives an empty result: without candidates the model is the labelers' starting rates.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import stage, unstage

# Gazetteers, by hand.
DOMAINS = "com org net edu gov info io co eu uk de fr es it nl ch at us ca au jp in br ru pl se".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 353 358 420".split()
COUNTRIES = "AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split()
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Kenneth Donna George Michelle Peter Anna Hans Klaus "
    "Jürgen Wolfgang Stefan Andreas Monika Ursula Petra Sabine Heike Katrin Jean Pierre Michel Philippe Jacques Marie Nathalie Isabelle Sylvie Catherine "
    "José Juan Antonio Manuel Francisco Carlos Luis Miguel María Carmen Josefa Isabel Dolores Pilar Teresa Lucía Ahmed Mohammed Fatima Wei Yuki Priya Olga Ivan"
).split()

#: Digits of a vote pattern: no, nothing, yes, to the base of 3.
LABELERS = ("form", "check", "gazetteer", "near", "against")
PATTERNS = 3 ** len(LABELERS)
BUCKETS = 4096
BEFORE, AFTER = 40, 20
#: Labelers start as right in this share of their votes, with the weight of so many candidates.
START_RIGHT, START_WEIGHT = (0.7, 0.8, 0.8, 0.85, 0.95), 20
ROUNDS = 30
AGAINST = r"(?i)\b(?:version|release|build|order|invoice|isbn|issn|article|section|chapter|page|item|sku|serial|ticket|bestellung|rechnung|commande|facture|pedido|factura)\b"


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a text without this has none of the kind
    pattern: str
    form: str
    near: str
    check: Callable[[Column], Column]  # of the value: true, false, or null for no vote
    gazetteer: Callable[[Column], Column]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 2) | F.regexp_replace(p, "^0+", "").rlike("^(?:1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _one_of(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def _yes(c: Column) -> Column:
    """True, or no vote."""
    return F.when(c, F.lit(True))


def _domain(v: Column) -> Column:
    return F.lower(F.regexp_extract(v, r"([A-Za-z0-9-]+)$", 1))


def _mod97(v: Column) -> Column:
    """Whether an account number's rest by 97 is 1, with its first four signs at the end."""
    flat = F.regexp_replace(v, " ", "")
    turned = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))
    step = lambda rest, c: F.when(c < "A", (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


_CAP = r"\p{Lu}\p{Ll}{1,20}"
BASE = 4
#: The first four are the base kinds. Their patterns are the plain ones, written so that nothing taken is tried again: an
#: address begins where its run of signs does, or where the last match ended.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*@[A-Za-z]", r"(?i)mail|contact|kontakt|courriel|correo|write|reach",
         lambda v: _domain(v).rlike("^[a-z]{2,}$"), lambda v: _yes(_one_of(_domain(v), DOMAINS))),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", r"(?i)\bip\b|host|address|server|login|from|client",
         _octets, lambda v: F.when(v.rlike(r"^(?:0|10|127|255)\.|^192\.168\."), F.lit(False))),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", r"^[0-9]{13,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$", r"(?i)card|karte|carte|tarjeta|visa|master|amex|credit|pay",
         lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)), lambda v: _digits(v).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{1,5}\)?[ .-]?){1,5}$", r"(?i)phone|tel|call|mobile|fax|anruf|appel|llam|whatsapp",
         lambda v: F.length(_digits(v)).between(9, 15), lambda v: _yes(F.exists(F.array(*(F.substring(_digits(v), 1, n) for n in (1, 2, 3))), lambda c: _one_of(c, CALLING)))),
    Kind("masked_email", "at", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[a-z0-9-]{1,63}+(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,6}+|\x20at\x20[a-z0-9-]{1,63}+(?:\x20dot\x20[a-z0-9-]{1,63}+){1,6}+)", r"(?i)^[a-z0-9]", r"(?i)mail|contact|kontakt|courriel|correo|write|reach",
         lambda v: _domain(v).rlike("^[a-z]{2,6}$"), lambda v: _one_of(_domain(v), DOMAINS)),
    Kind("local_phone", "", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"^\(?[2-9]", r"(?i)phone|tel|call|mobile|fax|anruf|appel|llam|whatsapp",
         lambda v: _digits(v).rlike("^[2-9][0-9]{2}[2-9]"), lambda v: F.lit(None).cast("boolean")),
    Kind("national_id", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^[0-8]", r"(?i)ssn|social|security|insurance|number|identity|ausweis|sécurité|seguridad",
         lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), lambda v: F.lit(None).cast("boolean")),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])", r"^[A-Z]{2}(?!00|01|99)", r"(?i)iban|account|konto|compte|cuenta|bank|transfer",
         _mod97, lambda v: _one_of(F.substring(v, 1, 2), COUNTRIES)),
    Kind("name", "", rf"(?<!\p{{L}}){_CAP}(?:\x20{_CAP}){{1,2}}(?!\p{{L}})", rf"^{_CAP}\x20{_CAP}$", r"(?:\b[Nn]ame\b|\b[Mm]y name is|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?|\b[Ss]igned|\b[Rr]egards,?|\bcalled)\W*$",
         lambda v: F.lit(None).cast("boolean"), lambda v: _one_of(F.regexp_extract(v, r"^(\p{L}+)", 1), GIVEN)),
    Kind("address", "", rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}}\x20(?:{_CAP}\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)|\p{{Lu}}\p{{Ll}}{{1,20}}(?:straße|strasse|weg|platz|allee)\x20[0-9]{{1,4}}|[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place)\x20(?:de\x20|du\x20|des\x20|la\x20)*{_CAP}|(?:Calle|Avenida|Plaza)\x20(?:de\x20|del\x20|la\x20)*{_CAP},?\x20[0-9]{{1,4}})(?!\p{{L}})", r"[0-9]", r"(?i)address|live|street|adresse|wohn|habite|vive|dirección|ship|office",
         lambda v: F.lit(None).cast("boolean"), lambda v: F.lit(True)),
)

PLACE = "struct<start:int,end:int,value:string,before:string,after:string>"
CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """For each item what step(state, item) gives as its second, with the state that it gave first before. Chunks are put
    together at the end, so time is in proportion to the items."""
    nothing = lambda kind: F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, got = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["o"], F.array(got.cast(out))).alias("o"))

    def chunk(acc: Column, at: Column) -> Column:
        own = F.aggregate(F.slice(items, at, F.lit(CHUNK)), F.struct(acc["s"].alias("s"), nothing(out).alias("o")), one)
        return _let(own, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    begins = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(begins, F.struct(zero.alias("s"), nothing(f"array<{out}>").alias("o")), chunk, lambda acc: F.flatten(acc["o"]))


def places(text: Column, pattern: str) -> Column:
    """All matches in order: start and end (code points, end exclusive), value, and the text around up to the next match."""

    def found(m: Column) -> Column:
        def cut(gaps: Column) -> Column:
            around = F.transform(m, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), v.alias("v"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after")))

            def step(end: Column, x: Column) -> tuple[Column, Column]:
                start = end + x["gap"]
                own = start + F.length(x["v"])
                return own, F.struct(start.alias("start"), own.alias("end"), x["v"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))

            return _let(around, lambda a: scan(a, F.lit(0), step, PLACE))

        return F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), cut)).otherwise(F.array().cast(f"array<{PLACE}>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


CANDIDATE = "struct<start:int,kind:int,end:int,base:boolean,votes:int,features:array<int>>"


def _vote(c: Column) -> Column:
    return F.when(c, 2).when(~c, 0).otherwise(1)


def _judge(at: int, kind: Kind) -> Callable[[Column], Column]:
    """From a place to a candidate with the labelers' votes and its features."""
    return lambda p: _judged(at, kind, p)


def _judged(at: int, kind: Kind, p: Column) -> Column:
    v, before, after = p["value"], p["before"], p["after"]

    def made(checks: Column) -> Column:
        ok, known = checks["ok"], checks["known"]
        votes = (_vote(v.rlike(kind.form)), _vote(ok), _vote(known), _vote(_yes(before.rlike(kind.near))), F.when(before.rlike(AGAINST), 0).otherwise(1))
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9")
        word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))
        looks = (ok.cast("string"), known.cast("string"), F.left(shape, F.lit(24)), F.length(v).cast("string"), word, F.left(after, F.lit(1)), F.right(before, F.lit(1)), before.rlike(AGAINST).cast("string"))
        features = F.array(*(F.pmod(F.xxhash64(F.lit(f"{kind.name}/{i}/"), F.coalesce(x, F.lit("-"))), F.lit(BUCKETS)).cast("int") for i, x in enumerate(looks)))
        base = F.coalesce(ok, F.lit(False)) if 0 < at < BASE else F.lit(at == 0)
        return F.struct(p["start"].alias("start"), F.lit(at).alias("kind"), p["end"].alias("end"), base.alias("base"), sum(x * 3**i for i, x in enumerate(votes)).cast("int").alias("votes"), features.alias("features")).cast(CANDIDATE)

    return _let(F.struct(kind.check(v).alias("ok"), kind.gazetteer(v).alias("known")), made)


def _clear(all_: Column) -> Column:
    """Without the candidates of further kinds that a base span overlaps; all_ is in order of start."""
    flagged = "struct<c:" + CANDIDATE + ",hit:boolean>"

    def forth(end: Column, c: Column) -> tuple[Column, Column]:
        return F.when(c["base"], F.greatest(end, c["end"])).otherwise(end), F.struct(c.alias("c"), (end > c["start"]).alias("hit"))

    def back(start: Column, x: Column) -> tuple[Column, Column]:
        c = x["c"]
        return F.when(c["base"], c["start"]).otherwise(start), F.struct(c.alias("c"), (x["hit"] | (start < c["end"])).alias("hit"))

    def both(a: Column) -> Column:
        once = scan(a, F.lit(0), forth, flagged)
        twice = _let(F.reverse(once), lambda r: scan(r, F.lit(2**31 - 1), back, flagged))
        kept = F.filter(twice, lambda x: (x["c"]["kind"] < BASE) | ~x["hit"])
        return F.reverse(F.transform(kept, lambda x: x["c"]))

    return _let(all_, lambda a: F.when(F.exists(a, lambda c: c["base"]) & F.exists(a, lambda c: c["kind"] >= BASE), both(a)).otherwise(a))


def candidates(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and `found`, an array of candidates in order of start."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(t: Column) -> Column:
        parts = []
        for at, kind in enumerate(KINDS):
            own = F.transform(places(t, kind.pattern), _judge(at, kind))
            parts.append(F.when(F.contains(t, F.lit(kind.hint)), own).otherwise(F.array().cast(f"array<{CANDIDATE}>")) if kind.hint else own)
        return _clear(F.array_sort(F.concat(*parts)))

    return docs.select(*carry, _let(text, of).alias("found"))


def _numbers(values: list[float]) -> Column:
    """The values as an array that is part of the plan; at most a few thousand."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


@dataclass(frozen=True)
class Model:
    soft: list[float]  # probability of each vote pattern, by kind
    prior: list[float]  # log odds of each kind
    weights: list[float]  # log ratio of each feature bucket


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


def reliabilities(found: DataFrame) -> list[float]:
    """The probability of each kind and vote pattern, by expectation-maximisation over their counts."""
    votes = stage(found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")), "votes")
    size = len(KINDS)
    # chances of no, nothing and yes for what isn't and what is personal data; to vote nothing says nothing at first
    start = [([r / 2, 0.5, (1 - r) / 2], [(1 - r) / 2, 0.5, r / 2]) for r in START_RIGHT]
    prior = [0.5] * size
    rate = [start] * size
    digit = lambda i: F.floor(F.col("votes") / 3**i).cast("int") % 3

    def score() -> Column:
        ratio = [round(math.log(rate[k][i][1][v] / rate[k][i][0][v]), 6) for k in range(size) for i in range(len(LABELERS)) for v in range(3)]
        odds = F.get(_numbers([round(_odds(p), 6) for p in prior]), F.col("kind"))
        for i in range(len(LABELERS)):
            odds = odds + F.get(_numbers(ratio), F.col("kind") * 3 * len(LABELERS) + 3 * i + digit(i))
        return F.round(1e6 / (1 + F.exp(-odds))).cast("long")

    for _ in range(ROUNDS):
        each = votes.withColumn("p", score()).withColumn("at", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), digit(i).alias("v")) for i in range(len(LABELERS))))))
        sums = each.groupBy("kind", "at.i", "at.v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1_000_000 - F.col("p"))).alias("no")).collect()
        before = (prior, rate)
        total = {(r.kind, r.i, r.v): (r.no / 1e6, r.yes / 1e6) for r in sums}
        prior, rate = [], []
        for k in range(size):
            n = [sum(total.get((k, 0, v), (0, 0))[y] for v in range(3)) for y in (0, 1)]
            prior.append(round((n[1] + START_WEIGHT / 2) / (n[0] + n[1] + START_WEIGHT), 6))
            rate.append([[[round((total.get((k, i, v), (0, 0))[y] + START_WEIGHT * start[i][y][v]) / (n[y] + START_WEIGHT), 9) for v in range(3)] for y in (0, 1)] for i in range(len(LABELERS))])
        flat = lambda of: [of[0][k] for k in range(size)] + [x for kind in of[1] for labeler in kind for y in labeler for x in y]
        if all(abs(a - b) < 1e-4 for a, b in zip(flat((prior, rate)), flat(before))):
            break
    pairs = found.sparkSession.range(size * PATTERNS).select((F.col("id") / PATTERNS).cast("int").alias("kind"), (F.col("id") % PATTERNS).cast("int").alias("votes"), "id")
    soft = [r.p / 1e6 for r in pairs.select("id", score().alias("p")).orderBy("id").collect()]
    unstage(votes)
    return soft


def fit(found: DataFrame) -> Model:
    """The final classifier, from all candidates with the labelers' probabilities as soft labels."""
    soft = reliabilities(found)
    c = found.select(F.explode("found").alias("c")).select("c.kind", "c.features", F.round(F.get(_numbers(soft), F.col("c.kind") * PATTERNS + F.col("c.votes")) * 1e6).cast("long").alias("p"))
    by_kind = {r.kind: r for r in c.groupBy("kind").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()}
    prior, size = [], []
    for k in range(len(KINDS)):
        n, p = (by_kind[k].n, by_kind[k].p / 1e6) if k in by_kind else (0, 0.0)
        size.append((n - p, p))
        prior.append(round(_odds((p + 1) / (n + 2)), 6))
    # a bucket is of one kind but for collisions; its rates are among all candidates of the kind
    weights = [0.0] * BUCKETS
    for r in c.select("kind", "p", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.max("kind").alias("kind"), F.count("*").alias("n"), F.sum("p").alias("p")).collect():
        no, yes = size[r.kind]
        weights[r.bucket] = round(math.log((r.p / 1e6 + 0.5) / (yes + 1)) - math.log((r.n - r.p / 1e6 + 0.5) / (no + 1)), 6)
    return Model(soft, prior, weights)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """The carried columns and `spans`: start, kind (its place in KINDS), end, base, score of the spans found."""

    def score(c: Column) -> Column:
        odds = F.aggregate(c["features"], F.get(_numbers(model.prior), c["kind"]), lambda s, f: s + F.get(_numbers(model.weights), f))
        return 1 / (1 + F.exp(-odds))

    whole = F.transform("found", lambda c: F.struct(*(c[x].alias(x) for x in ("start", "kind", "end", "base")), score(c).alias("score")))
    return found.withColumn("spans", F.filter(whole, lambda s: s["base"] | ((s["kind"] >= BASE) & (s["score"] >= 0.5)))).drop("found")


def find(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all)."""
    found = stage(candidates(docs), "candidates")
    spans = scored(found, fit(found))
    name = F.array(*(F.lit(k.name) for k in KINDS))
    say = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda i: lambda s: s["base"] & (s["kind"] == i)
    counts = [F.size(F.filter("spans", of(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS[:BASE])]
    return spans.select("doc_id", *counts, F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
