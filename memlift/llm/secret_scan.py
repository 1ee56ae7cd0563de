"""Secrets in texts: three fixed kinds by pattern, and further spans by two character Markov models.

Both models give the probability of a character after the two before it. One is fitted to random strings (the values of
the fixed kinds), one to ordinary identifiers (other long words and names of the texts). A run of 16 or more characters of
[A-Za-z0-9+/_=-] is cut at the signs that paths, slugs, dates and rulers are joined by (/ = _ -), and is a secret when one of its pieces
that can be a key (ten characters or more, not digits only, six different ones) has a log-likelihood ratio a character over a
threshold that at most one in 2000 of the held-out identifiers passes.

A null text counts as empty. Very long texts are read whole. Ties, repeated rows and further columns don't matter: each
row is scanned by itself. Without random strings to learn from, only the fixed kinds are found. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import arrow_map, stage, unstage

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Runs are maximal, so a least length in the pattern finds the same spans as dropping short ones afterwards.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINS, LEAST_PIECE, LEAST_DIFFERENT = re.compile(r"[/=_-]+"), 10, 6
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_-]{7,}")
#: Fitting looks at no more than about so many documents with, and without, a span of a fixed kind.
SAMPLE_WITH, SAMPLE_WITHOUT = 1500, 1500
#: Of the identifiers in that sample, so many with the smallest hashes are learnt from.
MOST_IDENTIFIERS = 200_000
ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")}
WIDTH = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds in order."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Markov:
    """Log-probability of each character after two others, for random strings less that for identifiers."""

    ratio: np.ndarray | None
    threshold: float

    def score(self, word: str) -> float:
        if self.ratio is None:
            return -math.inf
        c = [0, 0, *(ALPHABET.get(x, 0) for x in word)]
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())


def pieces(run: str) -> list[str]:
    """The parts of a run that can be a key."""
    return [x for x in JOINS.split(run) if len(x) >= LEAST_PIECE and not x.isdigit() and len(set(x)) >= LEAST_DIFFERENT]


def _table(words: list[str]) -> np.ndarray:
    """Log-probabilities with two context characters, smoothed by one, and by none."""
    n3, n2 = np.zeros((WIDTH,) * 3), np.zeros((WIDTH,) * 2)
    for w in words:
        c = np.array([0, 0, *(ALPHABET.get(x, 0) for x in w)])
        np.add.at(n3, (c[:-2], c[1:-1], c[2:]), 1)
        np.add.at(n2, (c[1:-1], c[2:]), 1)
    n1 = n2.sum(0) + 1
    p1 = n1 / n1.sum()
    p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
    return np.log((n3 + 20 * p2) / (n3.sum(2, keepdims=True) + 20))


def train(random_strings: list[str], identifiers: list[str], most_wrong: float = 1 / 2000) -> Markov:
    """Fits both models on nine tenths of the labelled samples; the rest sets the threshold."""
    rnd, own = sorted(set(random_strings)), sorted(set(identifiers))
    if len(rnd) < 5 or len(own) < 20:
        return Markov(None, 0.0)
    held = [w for w in own if int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 10 == 0]
    kept = [w for w in own if w not in set(held)] or own
    model = Markov((_table(rnd) - _table(kept)).astype(np.float32), 0.0)
    scores = sorted(model.score(w) for w in held or own)
    # never under an even ratio, and above nearly every held-out identifier
    model.threshold = max(0.3, scores[min(len(scores) - 1, math.ceil(len(scores) * (1 - most_wrong)) - 1)] + 0.05)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Markov:
    """The labelled samples: values of the fixed kinds are random strings; long words of documents without any are identifiers.

    One pass marks the documents that have a fixed kind's beginning; samples of both kinds are drawn by the hash of id and
    text, and words by their own hash, so the model doesn't depend on the order or the layout of the rows."""
    d = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("h"), docs[text_col].alias("text"))
    has = F.coalesce(d["text"].rlike(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"), F.lit(False))
    marks = stage(d.select("h", has.alias("has")), "marks")
    n = {r["has"]: r["count"] for r in marks.groupBy("has").count().collect()}
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.when(F.col("has"), F.lit(SAMPLE_WITH / max(1, n.get(True, 0)))).otherwise(F.lit(SAMPLE_WITHOUT / max(1, n.get(False, 0))))
    picked = marks.where(share < rate).distinct()  # about SAMPLE_WITH and SAMPLE_WITHOUT rows: a known bound
    rows = d.join(F.broadcast(picked), "h").select("h", "has", "text").distinct().collect()
    unstage(marks)
    rnd, own = set(), set()
    for r in rows:
        text = r["text"] or ""
        for start, kind, end in base_spans(text):
            value = text[start:end]
            rnd.add(ASSIGN.fullmatch(value)[2] if kind == 0 else value)
        if not r["has"]:
            own.update(IDENTIFIER.findall(text))
    # digits only, as in card numbers, say nothing about keys
    return train([w for w in rnd if not w.isdigit()], sorted(own, key=lambda w: (hashlib.md5(w.encode()).digest(), w))[:MOST_IDENTIFIERS])


def all_spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """The fixed kinds' spans and, beside them, runs that read as random."""
    spans = base_spans(text)
    if model.ratio is not None:
        free = []
        for m in RUN.finditer(text):
            if any(s < m.end() and m.start() < e for s, _, e in spans):
                continue
            if any(model.score(x) > model.threshold for x in pieces(m[0])):
                free.append((m.start(), 3, m.end()))
        spans = sorted(spans + free)
    return spans


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: Markov | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: counts of the fixed kinds, base_sha256, spans (kind:start:end in code points), and the redacted
    text where asked for. The model is small and goes to the tasks with the code. No shuffle."""
    model = fit(docs, id_col, text_col) if model is None else model

    def make():
        def step(batch):
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "redacted")}
            for text in batch["text"]:
                text = text or ""
                spans = all_spans(text, model)
                for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_markov")):
                    out[n].append(sum(s[1] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(said([s for s in spans if s[1] < 3]).encode()).hexdigest())
                out["spans"].append(said(spans))
                if with_text:
                    out["redacted"].append(redact(text, spans) if spans else text)
            return out | {"id": batch["id"]}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string" + (", redacted string" if with_text else "")
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), make, schema).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, model: Markov, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs with secrets replaced in the text, and the count of characters set to the new text's."""
    import pyarrow as pa

    from memlift.shipping import ship

    names = docs.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = [t and redact(t, all_spans(t, model)) for t in part.column(names.index(text_col)).to_pylist()]
                cols = list(part.columns)
                cols[names.index(text_col)] = pa.array(texts, part.schema.field(text_col).type)
                if chars_col in names:
                    i = names.index(chars_col)
                    cols[i] = pa.array([n if t is None else len(t) for t, n in zip(texts, cols[i].to_pylist())], part.schema.field(chars_col).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
