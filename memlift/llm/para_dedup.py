"""Passages that repeat across documents: paragraphs by MinHash banding, and what stands inside them by equal sentences.

A paragraph is a line with at least MIN_WORDS words, or a block of several lines between blank ones, as its words in lower
case. Equal paragraphs collapse into one class by two hashes of 64 bits. Each class has BANDS bands of ROWS
minimum hashes over its five-word shingles; bands are tuned for recall: at a Jaccard of 0.8 a pair shares a band with
probability 1 - (1 - 0.8^2)^7 = 0.9992, and paragraphs without common shingles never meet. A set of up to WHOLE_SET shingles is
near to its equals only, so it has one band. Colliding paragraphs are joined by band and checked: they are near when the
exact Jaccard of their shingles is 0.8 or more. Near classes form components.

A passage can also stand in the middle of a longer paragraph, or be wrapped otherwise. So blocks are cut into units at the
ends of sentences, whatever their lines, and long sentences at words whose hash is the smallest among their neighbours, which
cuts a passage alike wherever it stands. A sentence of fewer than UNIT_WORDS words belongs to the next one's unit. Units that
other documents hold too are repeated.

Of each component and each repeated unit the document with the smallest id keeps its text, whatever surrounds it there; the
others' is removed, but for what the document keeps of others. Components and units that stand nowhere but inside repeated
paragraphs go or stay with these. Neighbours with the same verdict and no word between them make one passage. Sentences of
everyday words recur by chance, so units count from MIN_RUN words in a row on; whole paragraphs count from MIN_WORDS words on.

Texts are cut and hashed by numpy, many at a time. Nulls and empty texts have no paragraphs. Very long texts are read whole.
Repeated rows are copies like others; rows with one id count as one document, and repeats inside one document don't count. Rows
with a null id have no passages. Ties can't occur: places are unique. Further columns don't matter, and an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import arrow_schema, release, sized, stage, unstage, utf8
from memlift.llm.components import linked_groups
from memlift.llm.wordhash import distinct, mixed, sequence_hashes, spans_and_hashes
from memlift.shipping import ship

MIN_WORDS, SHINGLE = 5, 5
UNIT_WORDS, LONG_SENTENCE = 5, 24
#: Words of a passage without a whole paragraph, where the caller asks for no others.
MIN_RUN = 25
#: A long sentence is cut after words with the smallest hash among so many on both sides.
NEAR_WORDS = 4
#: With so few shingles, a Jaccard of 0.8 takes equal sets.
WHOLE_SET = 3
BANDS, ROWS = 7, 2
PERCENT = 80
#: Bytes of texts that are cut together.
TOGETHER = 1 << 18
PLACE = ("id", "first_char", "last_char", "first_word", "words")
_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


@dataclass
class Parts:
    """Paragraphs and units of some texts: text (its number), first and end (words, counted over all texts), first_char,
    last_char and first_word (within the text), and two hashes; of paragraphs also the number of shingles and the bands."""

    paragraphs: dict[str, np.ndarray]
    units: dict[str, np.ndarray]
    shingles: np.ndarray
    bands: np.ndarray
    n_bands: np.ndarray

    def members(self, i: int) -> np.ndarray:
        """The sorted distinct shingles of paragraph i, as 32 bits."""
        return distinct(self.shingles[self.paragraphs["first"][i] : self.paragraphs["end"][i] - SHINGLE + 1].view(np.int32))


def cut_texts(texts: list[str | None], with_bands: bool = True) -> Parts:
    """Cuts texts into paragraphs and units; without bands, the paragraphs have none and no n."""
    raws = [utf8(t) for t in texts]
    joined = b"\n\n".join(raws)  # a blank line ends a block, so nothing reaches from one text into the next
    base = np.cumsum([0, *(len(r) + 2 for r in raws)])[:-1]
    a = np.frombuffer(joined, np.uint8)
    start, stop, h = spans_and_hashes(joined)
    n = len(h)
    line = np.searchsorted(np.flatnonzero(a == 10), start)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if n else np.empty(0, np.int64)
    end = np.append(first[1:], n) if n else first
    opens = np.concatenate(([True], np.diff(line[first]) > 1)) if n else np.empty(0, bool)
    block, lines = first[opens], np.diff(np.append(np.flatnonzero(opens), len(first)))
    block_end = np.append(block[1:], n) if n else block
    several = (lines > 1) & (block_end - block >= MIN_WORDS)
    long_ = end - first >= MIN_WORDS
    p_first, p_end = np.concatenate((first[long_], block[several])), np.concatenate((end[long_], block_end[several]))
    u_first, u_end = _unit_spans(_ENDS[a[stop - 1]] if n else np.empty(0, bool), block_end, mixed(h, 1))
    chars = None if joined.isascii() else np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
    word_base = np.searchsorted(start, base)

    def places(f: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
        text = np.searchsorted(base, start[f], side="right") - 1
        where = [start[f], stop[e - 1], base[text]] if chars is None else [chars[x] for x in (start[f], stop[e - 1], base[text])]
        one, two = sequence_hashes(h, f, e)
        return {"text": text, "first": f, "end": e, "first_char": where[0] - where[2], "last_char": where[1] - where[2], "first_word": f - word_base[text], "words": e - f, "k1": one, "k2": two}

    paragraphs = places(p_first, p_end)
    shingles = (mixed(h, SHINGLE) >> np.uint64(32)).astype(np.uint32)
    if not with_bands:
        return Parts(paragraphs, places(u_first, u_end), shingles, shingles[:0], shingles[:0])
    paragraphs["n"], bands, n_bands = _minhash(shingles, p_first, p_end - SHINGLE + 1, int(long_.sum()), paragraphs["k1"])
    return Parts(paragraphs, places(u_first, u_end), shingles, bands, n_bands)


def _unit_spans(ends: np.ndarray, block_end: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each unit. ends: whether a word ends a sentence; order: words' hashes, for cutting long ones."""
    n = len(ends)
    last = np.zeros(n + 1, bool)
    last[block_end] = True
    stops = np.flatnonzero(np.concatenate(([False], ends)) | last)
    least = np.ones(n, bool)
    for d in range(1, NEAR_WORDS + 1):
        least[d:] &= order[d:] < order[:-d]
        least[:-d] &= order[:-d] < order[d:]
    cuts = np.flatnonzero(least)
    firsts, found, at = [], [], 0
    for e, final in zip(stops.tolist(), last[stops].tolist()):
        if e - at >= UNIT_WORDS:
            firsts.append(at)
            if e - at > LONG_SENTENCE:
                inner = cuts[np.searchsorted(cuts, at + UNIT_WORDS - 1) : np.searchsorted(cuts, e - UNIT_WORDS)] + 1
                firsts += inner.tolist()
                found += inner.tolist()
            found.append(e)
            at = e
        elif final:
            at = e
    return np.array(firsts, np.int64), np.array(found, np.int64)


def _minhash(shingles: np.ndarray, first: np.ndarray, end: np.ndarray, n_lines: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each paragraph, all bands one after the other, and how many each has; the first n_lines
    paragraphs are lines, the rest blocks, each kind in order. whole: a hash of the paragraph, the band of small sets."""
    n, k = end - first, len(first)
    if not k:
        return n, np.empty(0, np.int64), np.empty(0, np.int64)
    v = np.sort(shingles)
    twice = distinct(v[1:][v[1:] == v[:-1]])
    if len(twice):  # shingles that a paragraph holds again
        at = np.minimum(np.searchsorted(twice, shingles), len(twice) - 1)
        where = np.flatnonzero(twice[at] == shingles)
        where = where[np.argsort(shingles[where], kind="stable")]
        same = shingles[where[1:]] == shingles[where[:-1]]
        n = n.copy()
        for part in (slice(0, n_lines), slice(n_lines, k)):
            f, e = first[part], end[part]
            if len(f):
                own = np.maximum(np.searchsorted(f, where, side="right") - 1, 0)
                own = np.where((where >= f[own]) & (where < e[own]), own, -1)
                again = own[1:][same & (own[1:] == own[:-1]) & (own[1:] >= 0)]
                n[part] -= np.bincount(again, minlength=len(f))
    x = np.append(shingles, np.uint32(0))
    least = np.empty((BANDS * ROWS, k), np.uint64)
    kinds = [np.stack([first[p], end[p]], 1).ravel() for p in (slice(0, n_lines), slice(n_lines, k))]
    for r in range(BANDS * ROWS):
        y = (x ^ _B[r]) * _A[r]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        least[r] = np.concatenate([np.minimum.reduceat(y, i)[::2] if len(i) else y[:0] for i in kinds])
    bands = np.empty((k, BANDS), np.uint64)
    for b in range(BANDS):
        z = (least[b * ROWS] << np.uint64(32) | least[b * ROWS + 1]) + np.uint64(b)
        z = (z ^ z >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        bands[:, b] = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    small = n <= WHOLE_SET
    bands[small, 0] = whole[small].view(np.uint64)
    use = np.ones((k, BANDS), bool)
    use[small, 1:] = False
    return n, bands.view(np.int64)[use], use.sum(1)


def _pieces(texts: pa.Array):
    """(first row, texts) in pieces of bounded size."""
    held, at, size = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > TOGETHER:
            yield at, held
            held, at, size = [], i + 1, 0
    if held:
        yield at, held


def _rows(docs: DataFrame, schema: str, with_bands: bool, columns) -> DataFrame:
    """docs (id, text) cut into parts; columns: from (ids by text, Parts) to lists of columns in the schema's order."""
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in _pieces(batch.column(1)):
                for cols in columns(ids[at : at + len(texts)], cut_texts(texts, with_bands)):
                    for x in range(0, len(cols[0]), 5000):  # a batch for Spark stays small
                        yield pa.RecordBatch.from_arrays([c.slice(x, 5000) for c in cols], schema=target)

    ship(docs.sparkSession)
    return docs.where("id is not null").select("id", "text").mapInArrow(run, schema)


def find_paragraphs(docs: DataFrame) -> DataFrame:
    """id, k1, k2 (hashes), n (shingles) and bands of each paragraph."""

    def columns(ids, parts):
        p = parts.paragraphs
        offsets = np.concatenate(([0], np.cumsum(parts.n_bands))).astype(np.int32)
        yield [pa.array(ids[p["text"]]), pa.array(p["k1"]), pa.array(p["k2"]), pa.array(p["n"].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(parts.bands))]

    return _rows(docs, "id long, k1 long, k2 long, n int, bands array<long>", True, columns)


def find_units(docs: DataFrame) -> DataFrame:
    """id and part (hash) of each unit."""
    return _rows(docs, "id long, part long", False, lambda ids, parts: [[pa.array(ids[parts.units["text"]]), pa.array(parts.units["k1"])]])


def find_places(docs: DataFrame) -> DataFrame:
    """Where paragraphs and units stand: id, first_char, last_char, first_word, words, unit, k1 and k2 (0 of a unit)."""

    def columns(ids, parts):
        for p, unit in ((parts.paragraphs, False), (parts.units, True)):
            k = len(p["text"])
            yield [pa.array(ids[p["text"]]), *(pa.array(p[c].astype(np.int32)) for c in PLACE[1:]), pa.array(np.full(k, unit)), pa.array(p["k1"]), pa.array(np.zeros(k, np.int64) if unit else p["k2"])]

    return _rows(docs, "id long, first_char int, last_char int, first_word int, words int, unit boolean, k1 long, k2 long", False, columns)


def paragraph_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, members) of the paragraphs in wanted (doc, keys: their first hashes), members as 32 bits; texts are cut again, of the documents
    that hold them only. The table of documents is sent to the texts where it is small; else both are dealt out by id."""
    target = pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            keys = batch.column(1)
            for at, texts in _pieces(batch.column(0)):
                parts = cut_texts(texts, False)
                k1, text = parts.paragraphs["k1"], parts.paragraphs["text"]
                ids, sets, seen = [], [], set()
                asked = [set(keys[at + i].as_py()) for i in range(len(texts))]
                for i, (t, k) in enumerate(zip(text.tolist(), k1.tolist())):
                    if k in asked[t] and (t, k) not in seen:
                        seen.add((t, k))
                        ids.append(k)
                        sets.append(parts.members(i))
                for x in range(0, len(ids), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x : x + 1000], pa.int64()), pa.array(sets[x : x + 1000], pa.list_(pa.int32()))], schema=target)

    ship(docs.sparkSession)
    return docs.join(sized(wanted), docs["id"] == wanted["doc"]).select("text", "keys").mapInArrow(run, "id long, members array<int>")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, first_char, last_char, first_word, words, first_doc, unit, part: paragraphs and units that another document holds
    too, with the smallest id that holds them, whether it is a unit, and its component or the unit's key."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # the first hash stands for the class; the chance that two classes share it is that of any two of them, over 2^64
    kept = find_paragraphs(own).groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    kept = stage(kept, "classes")
    release(spark)
    # what most documents hold leads: edited copies are nearer to it than to one another
    postings = kept.select(F.explode("bands").alias("key"), F.col("k1").alias("id"), "n", (-F.col("copies")).alias("rank"))

    def load_sets(ids: DataFrame) -> DataFrame:
        wanted = kept.select(F.col("k1").alias("id"), F.col("lo").alias("doc")).join(sized(ids), "id")
        # a document's own paragraphs: bounded by its text
        return paragraph_sets(own, stage(wanted.groupBy("doc").agg(F.collect_list("id").alias("keys")), "wanted"))

    linked = linked_groups(postings, load_sets, PERCENT)
    group = kept.select("k1", "k2", "lo", "hi").join(linked.withColumnRenamed("id", "k1").hint("merge"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    group = stage(group, "groups")
    spread = group.groupBy("component").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last_doc")).where("first_doc < last_doc").select("component", "first_doc")
    group = stage(group.join(stage(spread, "spread").hint("merge"), "component").select("k1", "k2", "component", "first_doc"), "repeated_classes")
    unstage(kept)
    release(spark)
    often = find_units(own).groupBy("part").agg(F.min("id").alias("first_doc"), F.max("id").alias("hi")).where("first_doc < hi")
    often = often.select(F.col("part").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("part").alias("component"), "first_doc", F.lit(True).alias("unit"))
    both = stage(often.unionByName(group.withColumn("unit", F.lit(False))), "repeated_keys")
    unstage(group)
    release(spark)
    found = find_places(own).join(sized(both), ["k1", "k2", "unit"])
    return found.select(*PLACE, "first_doc", "unit", F.col("component").alias("part"))


def mark_nested(batch: pa.RecordBatch) -> list[np.ndarray]:
    """id, nested, first_char, last_char, unit, first_word, words, first_doc and part of each different part; batch: id and its
    parts. Nested are parts that a paragraph before them holds, in order of start, longest first, paragraphs before units."""
    lists = batch.column(1)
    flat = lists.flatten()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    cols = [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]
    start, end, unit, *more = cols
    order = np.lexsort((*more[::-1], unit, -end.astype(np.int64), start, doc))
    doc, cols = doc[order], [c[order] for c in cols]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.any([c[1:] != c[:-1] for c in (doc, *cols)], axis=0)
    doc, cols = doc[new], [c[new] for c in cols]
    # how far the paragraphs so far reach, each document above all before it
    base = doc.astype(np.int64) << 32
    reach = np.maximum.accumulate(np.where(cols[2], base, base + cols[1] + 1)) if len(doc) else base
    nested = np.zeros(len(doc), bool)
    nested[1:] = (base + cols[1] + 1)[1:] <= reach[:-1]
    return [batch.column(0).to_numpy()[doc], nested, *cols]


def tuples(lists: pa.ListArray) -> list[list[tuple]]:
    """Lists of structs as lists of tuples."""
    flat, cut = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    rows = list(zip(*(c.to_pylist() for c in flat.flatten())))
    return [rows[a:b] for a, b in zip(cut, cut[1:])]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps that cover the same, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of spans isn't in kept; both as union() gives them."""
    out, k = [], 0
    for start, end in spans:
        while k < len(kept) and kept[k][1] <= start:
            k += 1
        j = k
        while j < len(kept) and kept[j][0] < end:
            if start < kept[j][0]:
                out.append((start, kept[j][0]))
            start = kept[j][1]
            j += 1
        if start < end:
            out.append((start, end))
    return out


def runs(doc: int, parts: list[tuple[int, int, int, int, int, bool]], least_words: int = MIN_RUN) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, words, first document, removed) of a document's passages; parts: (start, end, first word, words, first
    document, unit). A part is kept where this document is its first, and removed elsewhere but for what is kept. Passages
    of fewer than least_words words count where they touch a paragraph."""
    word = {p[0]: p[2] for p in parts} | {p[1]: p[2] + p[3] for p in parts}
    kept = union([(p[0], p[1]) for p in parts if p[4] == doc])
    gone = without(union([(p[0], p[1]) for p in parts if p[4] != doc]), kept)
    out: list[list] = []
    for start, end, removed in sorted([(*s, False) for s in kept] + [(*s, True) for s in gone]):
        if out and out[-1][4] == removed and word[out[-1][1]] == word[start]:
            out[-1][1] = end
        else:
            out.append([start, end, 0, doc, removed])
    starts = [r[0] for r in out]
    firsts: list[list[int]] = [[] for _ in out]
    whole = [False] * len(out)
    for start, end, _, _, first, unit in parts:
        k = max(0, bisect_right(starts, start) - 1)
        while k < len(out) and out[k][0] < end:
            if start < out[k][1]:
                whole[k] |= not unit and (first == doc) != out[k][4]
                if first != doc and out[k][4]:
                    firsts[k].append(first)
            k += 1
    for r, found in zip(out, firsts):
        r[2], r[3] = word[r[1]] - word[r[0]], min(found, default=doc)
    return [tuple(r) for r, w in zip(out, whole) if w or r[2] >= least_words]


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = MIN_RUN) -> DataFrame:
    """One row for each passage of at least least_words words, or with a paragraph, that another document holds too: the document's id,
    first_doc_id (its own id where it keeps the passage, else the smallest id that keeps a part of it), first_char and
    last_char (code points, end exclusive), n_words, removed (others keep it). Documents without such passages have no row."""
    rows = repeated(docs, id_col, text_col)
    part = ("first_char", "last_char", "unit", "first_word", "words", "first_doc", "part")
    # a document's own parts: bounded by its text
    per = stage(rows.groupBy("id").agg(F.collect_list(F.struct(*part)).alias("parts")), "parts_by_document")

    schema = "id long, nested boolean, first_char int, last_char int, unit boolean, first_word int, words int, first_doc long, part long"
    target = arrow_schema(docs.sparkSession, schema)

    def mark(batches):
        for batch in batches:
            cols = mark_nested(batch)
            for x in range(0, len(cols[0]), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 5000], type=f.type) for c, f in zip(cols, target)], schema=target)

    ship(docs.sparkSession)
    # whoever stands inside repeated paragraphs everywhere goes or stays with them
    marked = stage(per.mapInArrow(mark, schema), "marked")
    free = marked.where("not nested")
    deep = marked.where("nested").join(free.select("unit", "part").distinct().hint("merge"), ["unit", "part"], "left_semi")
    own = free.unionByName(deep).groupBy("id").agg(F.collect_list(F.struct("first_char", "last_char", "first_word", "words", "first_doc", "unit")).alias("parts"))
    own = stage(own, "by_document")

    out = "id long, first_doc_id long, first_char long, last_char long, n_words long, removed boolean"
    passages = arrow_schema(docs.sparkSession, out)

    def find(batches):
        for batch in batches:
            rows = [(i, first, start, end, words, removed) for i, parts in zip(batch.column(0).to_pylist(), tuples(batch.column(1))) for start, end, words, first, removed in runs(i, parts, least_words)]
            for x in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[x : x + 5000]), passages)], schema=passages)

    return own.mapInArrow(find, out).withColumnRenamed("id", id_col)


def remove_passages(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the passages (first_char, last_char) that dedup_paragraphs says are removed."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]]).strip()
