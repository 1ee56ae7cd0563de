"""What a text is allowed to do: instructions inside it, personal data, expiry, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What reads as an instruction to the reader of a memory.
INJECTION = (
    r"\bignore\b[^.]*\b(previous|prior|earlier|above|all|any)\b",
    r"\bdisregard\b",
    r"\bsystem\s+override\b",
    r"\boverride\b[^.]*\b(value|threshold|fact|record|setting|previous|stored)\b",
    r"\b(replace|overwrite)\b[^.]*\b(stored|saved|current|value|threshold|record|number)\b",
    r"\bforget\b[^.]*\b(what|everything|previous|prior|all)\b",
    r"\bfrom now on\b[^.]*\b(report|use|say|return|treat)\b",
    r"\bthe (real|actual|correct|true) (value|threshold|answer|number|figure)\b[^.]*\bis\b",
    r"\b(do not|don'?t)\b[^.]*\b(tell|mention|reveal|report the (old|previous))\b",
    r"\bnew instructions?\b\s*:",
)
FLAG = "[INJECTION-FLAGGED] "


def injected(s: Column) -> Column:
    return F.coalesce(s.rlike("(?i)" + "|".join(INJECTION)), F.lit(False))


def flagged(s: Column) -> Column:
    return F.when(injected(s), F.concat(F.lit(FLAG), s)).otherwise(s)


EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}[-.]\d{3}[-.]\d{4}\b"
SPELLED = r"[a-z0-9._%+-]+ (?:at|\[at\]|\(at\)) [a-z0-9-]+ (?:dot|\[dot\]|\(dot\)) [a-z]{2,}"
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
SECRET = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{12,}"


def digits_back(s: Column) -> Column:
    """O, l and I next to a digit read as 0 and 1."""
    for wrong, right in (("[oO]", "0"), ("[lI]", "1")):
        s = F.regexp_replace(F.regexp_replace(s, rf"(?<=\d){wrong}", right), rf"{wrong}(?=\d)", right)
    return s


def cards(s: Column) -> Column:
    """Card numbers in a text that pass the Luhn check, digits only."""
    found = F.transform(F.regexp_extract_all(s, F.lit(f"({CARD})"), F.lit(1)), lambda x: F.regexp_replace(x, "[ -]", ""))
    return F.filter(found, lambda x: F.call_function("luhn_check", x))


def sensitivity(s: Column) -> Column:
    """secret, private or public."""
    low = F.lower(digits_back(s))
    private = low.rlike(EMAIL) | low.rlike(SSN) | low.rlike(PHONE) | low.rlike(SPELLED) | (F.size(cards(s)) > 0)
    return F.when(s.rlike(SECRET), "secret").when(private, "private").otherwise("public")


MONTHS = "january february march april may june july august september october november december".split()


def expiry(text: Column, created: Column) -> Column:
    """The last millisecond of the month that a text names, by rules that are frozen: a year 20xx in the text, else the
    year of creation; Q1 and Q2 come before months; the first month by calendar that occurs as a substring wins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    given = F.regexp_extract(low, r"\b(20\d{2})\b", 1)
    year = F.when(given != "", given.cast("int")).otherwise(F.year(created))
    month = F.when(low.rlike(r"\bq1\b"), 3).when(low.rlike(r"\bq2\b"), 6)
    for i, m in enumerate(MONTHS):
        month = month.when(low.contains(m), i + 1)
    last = F.last_day(F.make_date(year, month, F.lit(1)))
    return F.when(last.isNotNull(), F.concat(last.cast("string"), F.lit("T23:59:59.999Z")))


def expired(expires_at: Column, now: Column) -> Column:
    """No expiry means current. Both are ISO strings of one form, so their order is the order of time."""
    return F.coalesce(expires_at <= now, F.lit(False))


# The frozen cases of the expiry rules, as (name, text, created, expires) and (name, expires, now, expired).
EXTRACTION_CASES = (
    ("implicit-june-created-year", "training for the June marathon", "2023-06-28", "2023-06-30T23:59:59.999Z"),
    ("explicit-leap-february", "attending the February 2024 conference", "2023-12-01", "2024-02-29T23:59:59.999Z"),
    ("explicit-q2", "Q2 2025 budget freeze in effect", "2025-04-01", "2025-06-30T23:59:59.999Z"),
    ("inclusive-through-month", "subscribed through December 2023", "2023-06-01", "2023-12-31T23:59:59.999Z"),
    ("timeless", "is vegetarian", "2023-05-01", None),
)
DECISION_CASES = (
    ("equal-boundary-is-expired", "2023-06-30T23:59:59.999Z", "2023-06-30T23:59:59.999Z", True),
    ("one-ms-before-is-current", "2023-07-01T00:00:00.000Z", "2023-06-30T23:59:59.999Z", False),
    ("one-ms-after-is-expired", "2023-06-30T23:59:59.999Z", "2023-07-01T00:00:00.000Z", True),
    ("timeless-is-current", None, "2033-07-01T00:00:00.000Z", False),
)


def witnesses(created: Column) -> Column:
    """An array with a row a frozen case: its name, what its text gives for a row created then (null for decisions), and whether the
    rules still give what the case says."""
    day = lambda x: F.lit(x).cast("date")
    rows = [F.struct(F.lit(n).alias("name"), expiry(F.lit(t), created).alias("expires"), expiry(F.lit(t), day(c)).eqNullSafe(F.lit(e)).alias("holds")) for n, t, c, e in EXTRACTION_CASES]
    rows += [F.struct(F.lit(n).alias("name"), F.lit(None).cast("string").alias("expires"), (expired(F.lit(e).cast("string"), F.lit(now)) == F.lit(x)).alias("holds")) for n, e, now, x in DECISION_CASES]
    return F.array(*rows)


def effective_confidence(conf: Column, support: Column, challenge: Column, calibration: float = 1.0) -> Column:
    """Confidence with what supports and what challenges it, within 0 and 1."""
    raw = conf * calibration + 0.15 * F.tanh(support) - 0.6 * F.tanh(challenge)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def capped_confidence(conf: Column, supported: Column) -> Column:
    return F.when((conf > 0.7) & ~supported, F.lit(0.7)).otherwise(conf)
