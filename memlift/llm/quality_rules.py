"""Line-first cleaning: rules on each line, then a verdict on the document by what the lines lost.

A line fails when it is a row of menu entries, is mostly symbols or shouting, is long and has no mark at all, repeats one word, or is a notice of
the licence or copyright kind: by its phrases, or, where its words are ordinary ones, by its place at the text's start or end. A document is kept when it has enough words that are not repetition and its lines kept
at least half of its words.

A null text counts as empty: no words, base_failed, not kept. Very long texts are read whole. Ties, repeated rows and
further columns don't matter: each row is judged by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from memlift.llm.common import arrow_map, utf8

SYMBOLS = b"#*$%&|<>"
#: A document may lose at most this share of its words.
MOST_LOST = 0.5
#: Phrases of notices; a line of at most 25 words with one is boilerplate.
NOTICE = re.compile(
    rb"all rights reserved|licensed under|released under|copyright (?:\(c\)|\xc2\xa9|(?:19|20)\d\d)|\(c\) (?:19|20)\d\d|\xc2\xa9"
    rb"|privacy policy|terms of (?:use|service)|cookie (?:policy|settings|notice)|accept (?:all )?cookies|javascript (?:is|must|to)"
)
#: Words that notices use and ordinary text as well: such a line is boilerplate where it has two of them, or is short and among
#: the first or last EDGE_LINES lines of the text.
WEAK = re.compile(rb"\blicen[sc]e\b|\bcopyright\b|\bcookies?\b|\bsubscribe\b|\bsign up\b|\blog ?in\b|\bclick here\b|\bread more\b|\bshare this\b|\bnewsletter\b|\bjavascript\b")
SHORT_NOTICE, EDGE_LINES = 12, 2
#: Marks that some sentence of a long line ends or is cut by; those of other scripts by their Unicode category.
MARKS = re.compile(rb"[.,;:!?]")
ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")
#: Scripts that are written without marks and cut by spaces.
UNMARKED = range(0x0E00, 0x0F00)


def has_mark(line: bytes) -> bool:
    """Whether a mark of some script (a full stop, a comma, a danda) stands in the line, or its script has none."""
    if MARKS.search(line):
        return True
    return not line.isascii() and any(ord(c) > 127 and (unicodedata.category(c) == "Po" or ord(c) in UNMARKED) for c in line.decode("utf-8", "replace"))


def ends_with_mark(line: bytes) -> bool:
    line = line.rstrip()
    if line.endswith(ENDS):
        return True
    last = line[-4:].decode("utf-8", "ignore")[-1:]
    return last > "\x7f" and unicodedata.category(last) in ("Po", "Pf", "Pi", "Pe")


def line_fails(line: bytes, words: list[bytes], at_edge: bool = True) -> str:
    """The first rule that a line with words fails, or an empty string. at_edge: among the first or last lines of its text."""
    n = len(words)
    low = line.lower()
    if sum(line.count(s) for s in (b"|", "»".encode(), "›".encode(), "·".encode())) * 5 >= n >= 2 and (b"|" in line or b"\xc2\xbb" in line or b"\xe2\x80\xba" in line or b"\xc2\xb7" in line):
        return "navigation"
    if n <= 25 and (NOTICE.search(low) or (weak := set(WEAK.findall(low))) and (len(weak) > 1 or at_edge and n <= SHORT_NOTICE)):
        return "boilerplate"
    if sum(line.count(bytes([s])) for s in SYMBOLS) * 2 >= n:
        return "symbols"
    if n >= 5 and line.count(b"!!") * 3 >= n:
        return "punctuation"
    if n >= 5 and line.isascii() and line.upper() == line and line.lower() != line:
        return "punctuation"
    if n >= 30 and not has_mark(line):
        return "punctuation"
    if n >= 8:
        most = Counter(words).most_common(1)[0][1]
        if sum(a == b for a, b in zip(words, words[1:])) * 3 >= n or most * 2 >= n:
            return "repetition"
    if n < 3 and not ends_with_mark(line):
        return "navigation"
    return ""


def lines_of(raw: bytes):
    """(line, words, whether it is among the first or last lines with words) of each line."""
    lines = [(x, x.split()) for x in raw.split(b"\n")]
    full = [i for i, (_, own) in enumerate(lines) if own]
    edge = {*full[:EDGE_LINES], *full[-EDGE_LINES:]}
    for i, (line, own) in enumerate(lines):
        yield line, own, i in edge


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    k = len(number)
    if k < 2_000_000:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for d in range(3):
        hit[d : n - 2 + d] |= twice
    return int(hit.sum())


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_removed, words_removed, kept."""
    raw = utf8(text)
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen, dups, gone_lines, gone = set(), 0, 0, 0
    for line, own, at_edge in lines_of(raw):
        if not own:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        if line_fails(line, own, at_edge):
            gone_lines, gone = gone_lines + 1, gone + len(own)
    n, rep = len(words), repeated_words(words)
    failed = n < 50 or 100 * rep > 50 * n
    return n, chars, symbols, dups, rep, failed, gone_lines, gone, not failed and gone <= MOST_LOST * n


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_removed", "words_removed", "kept")


def clean_text(text: str | None) -> str:
    """The text without the lines that fail."""
    return b"\n".join(x for x, own, at_edge in lines_of(utf8(text)) if not own or not line_fails(x, own, at_edge)).decode("utf-8", "surrogatepass")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document with the columns NAMES, and clean_text where asked for. No shuffle."""

    def make():
        def step(batch):
            rows = [judge(t) for t in batch["text"]]
            out = {"id": batch["id"]} | {n: [r[i] for r in rows] for i, n in enumerate(NAMES)}
            return out | ({"clean_text": [clean_text(t) for t in batch["text"]]} if with_text else {})

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'long'}" for n in NAMES) + (", clean_text string" if with_text else "")
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), make, schema).withColumnRenamed("id", id_col)
