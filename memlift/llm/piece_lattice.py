"""SentencePiece encoding and decoding, with the N best segmentations of a text.

The lattice of a string has an edge for each piece of the vocabulary that occurs in it, with the piece's score. A forward
Viterbi pass gives the best score from the start to each place. A backward A-star search from the end then uses these as
exact estimates of what is left: it never expands a place that doesn't lie on one of the N best paths, and complete paths
leave its queue from the best on. As the estimates are exact, the N first visits of a place are by the N best ways from there
to the end, so no place is left more than N times, however many ways have one score.

Pieces begin at spaces only or go on without one, so a text falls into words that are independent; inside a word, nothing
reaches across two characters that stand together in no piece. The forward pass runs for many words at once by numpy: places
of all words advance together, one character at a time, and each keeps its two best scores. The N best of the text are the
N best sums over its words; only the words with the smallest steps down from their best can be in them, and A-star runs for these.

The model file here is of the merging (BPE) kind: its library segments by merges in order of score, which need not be the
path of the best sum. `ids`, `ids_sha256` and `n_pieces` are that library's encoding, word by word, for use with models trained on
it. The columns named best and n_best are the lattice's own: by sums of scores, equal to the library's own N best when
the same pieces are loaded as a unigram model. Decoding is our own; `decoded` says whether `ids` give the text back. Characters without a piece become byte pieces.

A null text counts as empty: no pieces, one empty segmentation. Very long texts and words are read whole. Ties between paths of
one score go to the path with the longest last pieces in the forward pass and to the smallest place in the search, the same on each run. Repeated rows and further columns don't matter, and an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from itertools import chain

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from memlift.llm.common import arrow_map

SPACE = "▁"
N_BEST = 4
#: At most twice so many words, and so many parts, keep their segmentations in a Python worker, a word in about 230 bytes. Of
#: 8,000 texts 549,000 words are solved with 360,000 (all are kept, 691,000 entries at most), 777,000 with 90,000 (217,000 entries).
CACHE, PARTS = 360_000, 20_000
#: Characters of the words that are kept, at most twice so many (a text at once aside): words may be as long as a text.
CACHE_CHARS = 16 * CACHE
#: Words of up to so many characters are solved together; parts of longer ones by themselves.
TOGETHER = 48
#: Texts whose new words are looked up together, and most of their characters (a longer one goes by itself).
AT_ONCE, AT_ONCE_CHARS = 250, 2_000_000
#: Characters of new words that are solved together: each has its edges in several arrays for that time.
SOLVED_CHARS = 65_536
#: In place of a score: pieces begin so, and none does. Scores are never above 0.
BEGINS, ABSENT = 2.0, 1.0
#: What the library takes off the lowest score for a character without a piece.
UNKNOWN = 10.0


class PieceTrie:
    """The pieces as a trie in arrays: the child of a node by a character comes from a hash table with open places."""

    def __init__(self, starts: dict[str, float], ids: dict[str, int]):
        number = {"": 0} | {p: i + 1 for i, p in enumerate(sorted(starts))}
        self.score, self.piece = np.full(len(number), np.nan), np.full(len(number), -1, np.int64)
        bits = max(10, (len(number) * 5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for p, i in number.items():
            if p:
                if starts[p] <= 0:
                    self.score[i], self.piece[i] = starts[p], ids[p]
                key = number[p[:-1]] << 21 | ord(p[-1])
                at = int(self._slot(np.array([key]))[0])
                while self.key[at] >= 0:
                    at = at + 1 & self.mask
                self.key[at], self.child[at] = key, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        key = node << 21 | char
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.child[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def bounded(items: list[str], most: int, chars: int) -> Iterator[list[str]]:
    """The items in order, so many and of so many characters at a time at most, or one longer."""
    out, held = [], 0
    for x in items:
        if out and (len(out) >= most or held + len(x) > chars):
            yield out
            out, held = [], 0
        out.append(x)
        held += len(x)
    if out:
        yield out


class Column:
    """Numbers one behind the other, in an array with room for more."""

    def __init__(self, kind: type, first: tuple = ()):
        self.all, self.n = np.array(first, kind), len(first)

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.all):
            grown = np.empty(n + n // 8 + 1024, self.all.dtype)
            grown[: self.n] = self.all[: self.n]
            self.all = grown
        self.all[self.n : n] = values
        self.n = n


class SolvedWords(dict):
    """The row of each word, and the rows in columns: tuples with bytes and floats take half as much again."""

    def __init__(self):
        super().__init__()
        self.score, self.step, self.decodes = Column(np.float64), Column(np.float64), Column(np.bool_)
        #: ids by merges and of the best path, word by word, and where each word's begin
        self.ids, self.begin = (Column(np.int32), Column(np.int32)), (Column(np.int64, (0,)), Column(np.int64, (0,)))

    def add(self, words: list[str], score, step, decodes, *paths: tuple[np.ndarray, np.ndarray]) -> None:
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.score.add(score)
        self.step.add(step)
        self.decodes.add(decodes)
        for ids, begin, (new, sizes) in zip(self.ids, self.begin, paths):
            begin.add(np.cumsum(sizes) + ids.n)
            ids.add(new)

    def path(self, rows: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in these rows, by merges (0) or of the best path (1), and how many each has."""
        begin = self.begin[which].all
        start = begin[rows]
        size = begin[rows + 1] - start
        at = np.repeat(start - (np.cumsum(size) - size), size)
        return self.ids[which].all[at + np.arange(len(at))], size

    def take(self, words: list[str], other: SolvedWords) -> None:
        """Adds words that the other has."""
        rows = other.rows(words)
        self.add(words, other.score.all[rows], other.step.all[rows], other.decodes.all[rows], other.path(rows, 0), other.path(rows, 1))

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class PieceModel:
    def __init__(self, path: str, n_best: int = N_BEST):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)]
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.is_byte = np.array([i in self.of_byte for i in range(size)])
        self.chars = np.array([len(x) for x in self.names])
        skip = set(special)
        self.ids = {self.names[i]: i for i in range(size) if i not in skip}
        given = {p: sp.get_score(i) for p, i in self.ids.items()}
        # a score of -1e9 marks pieces that no counted merge makes; they come right after the lowest real score
        lowest = min(s for s in given.values() if s > -1e8)
        self.score = {p: max(s, lowest - 1) for p, s in given.items()}
        self.unknown = sp.unk_id()
        self.unknown_score = min(self.score.values()) - UNKNOWN
        #: what pieces begin with, each with the piece's score or BEGINS
        self.starts: dict[str, float] = {p[:n]: BEGINS for p in self.ids for n in range(1, len(p))} | self.score
        self.library = sp
        self.trie = PieceTrie(self.starts, self.ids)
        self.together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.n_best = n_best
        self.words, self.older = SolvedWords(), SolvedWords()
        self.room = CACHE
        self.kept_chars = 0
        self.parts: dict[str, tuple] = {}
        self.several: dict[str, list] = {}
        # words may be cut before a space only if no piece has one behind another character
        self.word = re.compile(f"{SPACE}.*" if any(SPACE in p.lstrip(SPACE) for p in self.ids) else f"{SPACE}+[^{SPACE}]*", re.S)

    def fresh(self, room: int = CACHE) -> PieceModel:
        """The same model with its own memory of words, at most twice so many, which goes with it."""
        out = copy(self)
        out.room = room
        out.words, out.older, out.parts, out.several = SolvedWords(), SolvedWords(), {}, {}
        out.kept_chars = 0
        return out

    def normal(self, text: str) -> str:
        return (" " + text).replace(" ", SPACE) if text else ""

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def lattice(self, part: str) -> tuple[list[tuple[int, int, float]], list[float]]:
        """Edges (start, stop, score), and the best score from the start to each place."""
        end = len(part)
        edges: list[tuple[int, int, float]] = []
        ahead = [0.0] + [float("-inf")] * end
        for start in range(end):
            for stop in range(start + 1, end + 1):
                kind = self.starts.get(part[start:stop], ABSENT)
                if kind <= 0 or stop == start + 1:
                    s = kind if kind <= 0 else self.unknown_score  # a character without a piece
                    ahead[stop] = max(ahead[stop], ahead[start] + s)
                    edges.append((start, stop, s))
                if kind == ABSENT:
                    break
        return edges, ahead

    def viterbi(self, part: str) -> tuple[float, list[int], float]:
        """Score and ids of the best segmentation, and the step from it to the second best: each place keeps its two best."""
        end, get = len(part), self.starts.get
        best, second, came = [float("-inf")] * (end + 1), [float("-inf")] * (end + 1), [0] * (end + 1)
        best[0] = 0.0
        for start in range(end):
            b, c = best[start], second[start]
            for stop in range(start + 1, end + 1):
                s = kind = get(part[start:stop], ABSENT)
                if s > 0:
                    if stop > start + 1:
                        if s == BEGINS:
                            continue
                        break
                    s = self.unknown_score  # a character without a piece
                v, old = b + s, best[stop]
                if v > old:
                    best[stop], came[stop] = v, start
                    second[stop] = c + s if c + s > old else old
                elif v > second[stop]:
                    second[stop] = v
                if kind == ABSENT:
                    break
        cuts, at = [], end
        while at:
            cuts.append(part[came[at] : at])
            at = came[at]
        ids: list[int] = []
        for piece in reversed(cuts):
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids += self.fallback(piece)
        return best[end], ids, best[end] - second[end]

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else self.fallback(piece)

    def best(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a string by the sum of scores, from the best on, by A-star from the end."""
        edges, ahead = self.lattice(part)
        end = len(part)
        to: list[list[tuple[int, float]]] = [[] for _ in range(end + 1)]
        for start, stop, s in edges:
            to[stop].append((start, s))
        queue, found, turn, left = [(-ahead[end], end, 0, 0.0, None)], [], 0, [n] * (end + 1)
        while queue and len(found) < n:
            _, at, _, after, path = heapq.heappop(queue)
            if at == 0:
                out: list[int] = []
                start = 0
                while path is not None:
                    stop, path = path
                    out += self.piece_ids(part[start:stop])
                    start = stop
                found.append((after, out))
                continue
            if not left[at]:
                continue
            left[at] -= 1
            for start, s in to[at]:
                turn += 1
                heapq.heappush(queue, (-(ahead[start] + s + after), start, turn, after + s, (at, path)))
        return found

    def solve_together(self, words: list[str]) -> list[tuple[float, bytes, float]]:
        """viterbi() of many words at once, with the ids as bytes."""
        lengths = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offset = np.cumsum(lengths + 1) - lengths - 1  # a place before each character, and one after the last
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(chars)) + owner
        rest = np.repeat(offset + lengths, lengths) - place  # characters up to the end of the word
        starts, stops, scores, pieces, sizes = [], [], [], [], []
        at, node, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), 1
        while len(at):
            node = self.trie.step(node, chars[at + size - 1])
            on = node >= 0
            score, piece = np.where(on, self.trie.score[node], np.nan), np.where(on, self.trie.piece[node], -1)
            if size == 1:  # a character without a piece
                score = np.where(np.isnan(score), self.unknown_score, score)
            own = ~np.isnan(score)
            starts.append(place[at[own]])
            stops.append(starts[-1] + size)
            scores.append(score[own])
            pieces.append(piece[own])
            sizes.append(np.full(int(own.sum()), size))
            go = on & (rest[at] > size)
            at, node, size = at[go], node[go], size + 1
        start, stop, score, piece, size_ = map(np.concatenate, (starts, stops, scores, pieces, sizes))
        depth = stop - np.repeat(offset, lengths + 1)[stop]
        # edges that end at one depth and have one size end at different places; longer pieces first
        group = (depth * 256 - np.minimum(size_, 255)).astype(np.uint16 if lengths.max() < 256 else np.int64)
        order = np.argsort(group, kind="stable")
        start, stop, score, piece, group = start[order], stop[order], score[order], piece[order], group[order]
        cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        n = len(chars) + len(words)
        best, second, came, by = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        best[offset] = 0.0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            st, sp, s = start[a:b], stop[a:b], score[a:b]
            v, old = best[st] + s, best[sp]
            better = v > old
            second[sp] = np.where(better, np.maximum(second[st] + s, old), np.maximum(second[sp], v))
            best[sp] = np.where(better, v, old)
            hit = sp[better]
            came[hit], by[hit] = st[better], piece[a:b][better]
        end = offset + lengths
        at, live, on = end.copy(), np.flatnonzero(lengths), np.zeros(n, bool)
        while len(live):
            on[at[live]] = True
            at[live] = came[at[live]]
            live = live[at[live] > offset[live]]
        on = np.flatnonzero(on)  # where pieces end, word by word
        cut = (np.searchsorted(on, offset) * 4).tolist() + [len(on) * 4]
        raw = by[on].astype(np.int32).tobytes()
        paths = [raw[a:b] for a, b in zip(cut, cut[1:])]
        for i in np.unique(np.searchsorted(offset, on[by[on] < 0], side="right") - 1).tolist():  # characters without a piece
            ids = array("i")
            for k, piece in zip(on[cut[i] // 4 : cut[i + 1] // 4].tolist(), array("i", paths[i])):
                ids.extend([piece] if piece >= 0 else self.fallback(words[i][k - 1 - int(offset[i])]))
            paths[i] = ids.tobytes()
        return list(zip(best[end].tolist(), paths, (best[end] - second[end]).tolist()))

    def solve(self, part: str) -> tuple[float, list[int], float]:
        known = self.parts.get(part)
        if known is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            known = self.parts[part] = self.viterbi(part)
        return known

    def cut(self, word: str) -> list[str]:
        """Parts between which no piece can reach."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.together:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def add_up(self, lists: list[list[tuple[float, list[int]]]]) -> list[tuple[float, list[int]]]:
        """The n best sums with one entry from each list, each list from its best on."""
        total = [(0.0, [])]
        for entries in lists:
            sums = ((a + b, i, j) for i, (a, _) in enumerate(total) for j, (b, _) in enumerate(entries) if (i + 1) * (j + 1) <= self.n_best)
            total = [(s, total[i][1] + entries[j][1]) for s, i, j in sorted(sums, key=lambda x: (-x[0], x[1], x[2]))[: self.n_best]]
        return total

    def words_of(self, full: str) -> list[tuple]:
        """For each word of a normal text: (word, bytes of its ids by merges, bytes of its best path's ids, score of that,
        step to the second best, whether the first ids decode to the word)."""
        return self.words_of_all([full])[0]

    def words_of_all(self, texts: list[str]) -> list[list[tuple]]:
        """words_of() for each text; words that are new are solved together."""
        out = []
        for words, rows in self.rows_of_all(texts):
            known, paths = self.words, []
            for which in (0, 1):
                ids, size = known.path(rows, which)
                cut = [0, *(np.cumsum(size) * 4).tolist()]
                raw = ids.tobytes()
                paths.append([raw[a:b] for a, b in zip(cut, cut[1:])])
            out.append(list(zip(words, *paths, known.score.all[rows].tolist(), known.step.all[rows].tolist(), known.decodes.all[rows].tolist())))
        return out

    def rows_of_all(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each normal text and their rows in self.words, until the next call; words that are new are solved
        together."""
        if len(self.words) >= self.room or self.kept_chars >= CACHE_CHARS:  # what was used since the last turn stays, so frequent words are never solved again
            self.older, self.words, self.kept_chars = self.words, SolvedWords(), 0
        found = [self.word.findall(t) for t in texts]
        known, older = self.words, self.older
        unknown = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in known]
        self.kept_chars += sum(map(len, unknown))
        if older:
            known.take([w for w in unknown if w in older], older)
            unknown = [w for w in unknown if w not in older]
        for new in bounded(unknown, len(unknown), SOLVED_CHARS):
            # the library puts the first space before each word itself, but not before an empty one
            given = self.library.encode([w[1:].replace(SPACE, " ") for w in new], num_threads=1)
            given = [ids or self.piece_ids(word) for word, ids in zip(new, given)]
            short = [w for w in new if len(w) <= TOGETHER]
            solved = dict(zip(short, self.solve_together(short))) if short else {}
            score, path, step = zip(*(solved[w] if w in solved else self.solve_long(w) for w in new))
            merged = np.fromiter(chain.from_iterable(given), np.int32), np.fromiter(map(len, given), np.int64)
            decodes = self.give_back(new, *merged)
            best = np.frombuffer(b"".join(path), np.int32), np.fromiter(map(len, path), np.int64) // 4
            known.add(new, score, step, decodes, merged, best)
        return [(ws, known.rows(ws)) for ws in found]

    def give_back(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each word's ids, one at least, decode to it. Words without byte pieces are compared together."""
        begin = np.cumsum(size) - size
        odd = np.logical_or.reduceat(self.is_byte[ids], begin)
        odd |= np.add.reduceat(self.chars[ids], begin) != np.fromiter(map(len, words), np.int64, len(words))
        if "".join(map(self.names.__getitem__, ids[np.repeat(~odd, size)].tolist())) != "".join([w for w, x in zip(words, odd.tolist()) if not x]):
            odd[:] = True
        out = ~odd
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.decoded(ids[begin[i] : begin[i] + size[i]].tolist()) == words[i]
        return out

    def solve_long(self, word: str) -> tuple[float, bytes, float]:
        solved = [self.solve(p) for p in self.cut(word)]
        return sum(x[0] for x in solved), array("i", [i for x in solved for i in x[1]]).tobytes(), min(x[2] for x in solved)

    def n_best_word(self, word: str) -> list[tuple[float, list[int]]]:
        found = self.several.get(word)
        if found is None:
            if len(self.several) >= PARTS:
                self.several.clear()
            found = self.several[word] = self.add_up([self.best(p, self.n_best) for p in self.cut(word)])
        return found

    def decoded(self, ids: list[int] | array) -> str:
        """Pieces as text, with bytes put together; spaces are still marked."""
        if self.of_byte.keys().isdisjoint(ids):
            return "".join(map(self.names.__getitem__, ids))
        out, held = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "surrogatepass"))
                held.clear()
            out.append(self.names[i])
        return "".join([*out, held.decode("utf-8", "surrogatepass")])

    def encode(self, text: str | None) -> list[int]:
        [(_, rows)] = self.rows_of_all([self.normal(text or "")])
        return self.words.path(rows, 0)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        text = self.decoded(ids).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def n_best_of(self, text: str | None, with_ids: bool = True) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text."""
        [(words, rows)] = self.rows_of_all([self.normal(text or "")])
        near, lists, base, picked = self.near_best(words, rows)
        if not with_ids:
            return [(base + s, []) for s, _ in picked]
        ids, size = self.words.path(rows, 1)
        end = np.cumsum(size)
        out = []
        for s, chosen in picked:
            own, at = [], 0
            for i, x, j in zip(near, lists, chosen):
                own += [*ids[at : end[i] - size[i]].tolist(), *x[j][1]]
                at = end[i]
            out.append((base + s, own + ids[at:].tolist()))
        return out

    def near_best(self, words: list[str], rows: np.ndarray):
        """The words that can differ in the N best, the N best of each, the score of all others, and the N best sums as
        (score of those words, which of the N best of each). Other than by their best, only the words with the smallest steps
        can take part, of equal ones the first."""
        score, step, most = self.words.score.all[rows].tolist(), self.words.step.all[rows], self.n_best - 1
        least = np.flatnonzero(step <= np.partition(step, most - 1)[most - 1]) if len(step) > most > 0 else np.arange(len(step))
        near = sorted(least[np.argsort(step[least], kind="stable")[:most]].tolist())
        lists = [self.n_best_word(words[i]) for i in near]
        base = sum(score) - sum(score[i] for i in near)
        return near, lists, base, self.add_up([[(s, [j]) for j, (s, _) in enumerate(x)] for x in lists])


@lru_cache(1)
def model_of(path: str, n_best: int) -> PieceModel:
    """Kept by a Python worker from task to task; tasks keep words in copies of it."""
    return PieceModel(path, n_best)


def encode_documents(docs: DataFrame, path: str, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, carry: tuple[str, ...] = (), room: int = CACHE) -> DataFrame:
    """One row a document: its id, n_pieces and ids_sha256 of the library's encoding, best_pieces, best_sha256 and best_score of
    the best path, n_best_scores and n_best_pieces (how many each of the N best has), and decoded, whether the library's ids
    give the text back; ids and the columns in `carry` where asked for. A task keeps at most twice `room` words. No shuffle."""
    names = ("n_pieces", "ids_sha256", "best_pieces", "best_sha256", "best_score", "n_best_scores", "n_best_pieces", "decoded", "ids")

    def make():
        model = model_of(path, n_best).fresh(room)

        def step(batch):
            out: dict[str, list] = {n: [] for n in names}
            texts = [model.normal(t or "") for t in batch["text"]]
            for some in bounded(texts, AT_ONCE, AT_ONCE_CHARS):
                for words, rows in model.rows_of_all(some):
                    (raw, _), (best, size) = model.words.path(rows, 0), model.words.path(rows, 1)
                    near, lists, base, picked = model.near_best(words, rows)
                    rest = len(best) - int(size[near].sum())
                    out["n_pieces"].append(len(raw))
                    out["ids_sha256"].append(hashlib.sha256(raw.tobytes()).hexdigest())
                    out["best_pieces"].append(len(best))
                    out["best_sha256"].append(hashlib.sha256(best.tobytes()).hexdigest())
                    out["best_score"].append(base + picked[0][0])
                    out["n_best_scores"].append([base + s for s, _ in picked])
                    out["n_best_pieces"].append([rest + sum(len(x[j][1]) for x, j in zip(lists, chosen)) for _, chosen in picked])
                    out["decoded"].append(bool(model.words.decodes.all[rows].all()))
                    if with_ids:
                        out["ids"].append(raw)
            return out | {"id": batch["id"]} | {f"carry_{c}": batch[f"carry_{c}"] for c in carry}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    kept = "".join(f"carry_{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    schema = f"id {kind}, {kept}n_pieces long, ids_sha256 string, best_pieces long, best_sha256 string, best_score double, n_best_scores array<double>, n_best_pieces array<int>, decoded boolean" + (", ids array<int>" if with_ids else "")
    taken = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"carry_{c}") for c in carry))
    return arrow_map(taken, make, schema, 500).withColumnsRenamed({"id": id_col} | {f"carry_{c}": c for c in carry})
