"""Token counts of a byte-level BPE by prefix dynamic programming.

A vocabulary's merges give each byte string one segmentation, and a segmentation is that one exactly if each pair of
neighbouring tokens is the segmentation of its own concatenation. So the last token of a prefix follows from the last
tokens of shorter prefixes: it is the only token that ends there and is compatible with the last token before it. That
fills a table with the exact count at every prefix of a piece. A text is a row of pieces, so its prefix counts are sums
over whole pieces plus one look into the table of the piece that is cut.

Nulls count as empty texts (0 bytes, 0 tokens). Very long texts are counted whole. Strings of special tokens inside a
text count as the library counts them by default: as one token. Ties, repeated rows and further columns don't matter:
each row is counted by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import accumulate

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from memlift.llm.common import arrow_map, utf8

#: At most so many pieces keep their counts in a Python worker.
CACHE = 400_000


def _byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at every prefix, for a byte-level BPE in a tokenizers .json."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        #: what tokens begin with, and whether that is a token
        self.starts = {t[:n]: False for t in self.ids for n in range(1, len(t))} | dict.fromkeys(self.ids, True)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.ok: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The plain algorithm: merge the pair of lowest rank until none is left."""
        parts, none = [piece[i : i + 1] for i in range(len(piece))], 1 << 60
        ranks = [self.rank.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = self.rank.get((parts[i], parts[i + 1]), none)
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b stay as they are when one follows the other; a is empty at the start of a piece."""
        if len(self.ok) > 2_000_000:
            self.ok.clear()
        good = self.ok[a, b] = self.merge(a + b) == [x for x in (a, b) if x]
        return good

    def table(self, piece: bytes) -> list[int]:
        """For each length from 0, the count of tokens of that prefix of one piece."""
        n, starts, ok = len(piece), self.starts, self.ok
        count, last = [0] * (n + 1), [b""] * (n + 1)
        for start in range(n):
            before, next_count = last[start], count[start] + 1
            for end in range(start + 1, n + 1):
                token = piece[start:end]
                whole = starts.get(token)
                if whole is None:  # no token begins so
                    break
                if whole and not count[end]:
                    pair = (before, token)
                    if ok[pair] if pair in ok else self.fits(before, token):
                        count[end], last[end] = next_count, token
        return count

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; special strings are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def count_piece(self, piece: str) -> int:
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= CACHE:
                self.counts.clear()
            n = 1 if self.special is not None and self.special.fullmatch(piece) else self.table(utf8(piece))[-1]
            self.counts[piece] = n
        return n

    def cumulative(self, text: str) -> tuple[list[str], list[int]]:
        """Pieces, and the count of tokens up to the end of each."""
        pieces, known = self.pieces(text), self.counts
        each = [known[p] if p in known else self.count_piece(p) for p in pieces]
        return pieces, list(accumulate(each))

    def count(self, text: str) -> int:
        return (self.cumulative(text)[1] or [0])[-1]

    def prefix_counts(self, text: str) -> list[int]:
        """For each number of characters from 0 to the text's, the exact count of tokens of that prefix by itself."""
        pieces, total = self.cumulative(text)
        out, at, before, blank = [0], 0, 0, 0
        for k, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                # white space before a cut joins the next piece's blank, so the piece before is split anew with it
                tail = text[at - blank : at + cut]
                out.append(before - (total[k - 1] - (total[k - 2] if k > 1 else 0) if blank else 0) + self.count(tail))
            out.append(total[k])
            at, before = at + len(piece), total[k]
            blank = len(piece) if piece.isspace() else 0
        # a cut right after a white-space piece sees it without what follows, but its pieces are the same
        return out

    def fit(self, text: str, budget: int) -> int:
        """The length in characters of a prefix of the text with at most `budget` tokens, cut inside the piece where the
        budget ends by that piece's own table."""
        return self.fit_pieces(*self.cumulative(text), budget)

    def fit_pieces(self, pieces: list[str], total: list[int], budget: int) -> int:
        at = before = 0
        for k, (piece, upto) in enumerate(zip(pieces, total, strict=True)):
            if upto > budget:
                return at + self.cut_in(pieces[k - 1] if k else "", piece, budget - before)
            at, before = at + len(piece), upto
        return at

    def cut_in(self, last: str, piece: str, room: int) -> int:
        """How many characters of a piece that follows `last` have at most `room` tokens and stay a piece when cut there."""
        if room <= 0 or self.special is not None and self.special.fullmatch(piece):
            return 0
        head = piece[: room * self.longest]  # no more can fit
        count, ends = self.table(utf8(head)), list(accumulate(len(utf8(c)) for c in head))
        for n in range(min(len(head), len(piece) - 1), 0, -1):
            # white space before a cut may join what the cut leaves of the next piece's blank
            if count[ends[n - 1]] <= room and (not last.isspace() or self.split.findall(last + piece[:n]) == [last, piece[:n]]) and self.split.findall(piece[:n]) == [piece[:n]]:
                return n
        return 0


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_bytes, n_tokens, over_limit (more than limit tokens) and fit_chars, the length in
    characters of a prefix with at most limit tokens, cut inside the piece where the limit is reached. No shuffle."""

    def make():
        counter = PrefixCounter(path)

        def step(batch):
            n_bytes, n_tokens, fit = [], [], []
            for text in batch["text"]:
                text = text or ""
                pieces, total = counter.cumulative(text)
                n = total[-1] if total else 0
                n_bytes.append(len(utf8(text)))
                n_tokens.append(n)
                if n <= limit:
                    fit.append(len(text))
                else:
                    fit.append(counter.fit_pieces(pieces, total, limit))
            return {"id": batch["id"], "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens], "fit_chars": fit}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), make, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_col)
