"""Toxicity by compression distance: windows of a text against two zstandard dictionaries.

One dictionary is trained on windows of ordinary text. The other is trained on what stands out in toxic text and then stands in
front of the ordinary content, so that ordinary windows compress alike with both and a window gets shorter only by toxic matches.
Most of a toxic text is ordinary, so its samples are cut down to the words that toxic texts use STANDS_OUT times as often as
ordinary ones, in several contexts (a copy repeats its context, so copies don't count twice), as often as they occur there; a
wrong label more or less changes a frequency a little and nothing else. Each window of
six words gets a gain: its compressed length with the ordinary dictionary less that with the toxic one. How many windows
pass each of a row of gain thresholds, and the largest gain, are calibrated to a probability by logistic regression. Its rows
are never scored by dictionaries that have seen them: two pairs of dictionaries, each made from half of the rows, score
the other half; the pair in use is then made from all.

Nulls and empty texts have one empty window. Very long texts are read whole. Ties, repeated rows and further columns don't
matter: each row is scored by itself. Without labelled rows of both classes each score is 0. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import arrow_map, sample_about, utf8

#: Fitting looks at no more than about so many labelled documents of each class, whole.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2500, 7500
#: Of the ordinary ones so many whole texts, and of each class so many windows, go into its dictionary.
MOST_TEXTS, MOST_WINDOWS = 1500, 100_000
#: How much more often toxic texts use a word that stands out.
STANDS_OUT = 25
WINDOW = 6
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 8_192
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8)
EDGE = b".,;:!?$%&*#|\"()'"
LEVEL = dict(window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=4, target_length=32, strategy=6, write_content_size=False, write_dict_id=False, write_checksum=False)


def words_of(text: str | None) -> list[bytes]:
    return utf8((text or "").lower()).split()


def windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b""]


#: The last part of a trained dictionary's header, before the content: the three offsets that it starts with.
OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples, without its header; with too few to train on, the samples
    themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        made = zstandard.train_dictionary(size, samples, level=3).as_bytes()
        return made[made.find(OFFSETS) + len(OFFSETS) :] if OFFSETS in made else made
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(**LEVEL)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


@dataclass
class ToxicModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None

    def scorer(self):
        """A function from a text to its score; compressors can't be sent to tasks, so each task makes its own."""
        if self.weights is None:
            return lambda text: 0.0
        plain, both = compressor(self.ordinary).compress, compressor(self.toxic + self.ordinary).compress

        def score(text: str | None) -> float:
            gains = [len(plain(w)) - len(both(w)) for w in windows(words_of(text))]
            return float(1 / (1 + np.exp(-np.clip(features(gains) @ self.weights, -30, 30))))

        return score


def features(gains: list[int]) -> np.ndarray:
    g = np.array(gains)
    return np.array([1.0, min(int(g.max()), 12), *(np.log1p((g >= t).sum()) for t in THRESHOLDS), np.log(len(g))])


def standing_out(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The words that stand out in the toxic texts, once for each context."""
    usual: Counter[bytes] = Counter()
    for t in ordinary:
        usual.update({w.strip(EDGE) for w in words_of(t)})
    least, share = max(3, 0.005 * len(toxic)), len(toxic) / max(1, len(ordinary))
    enough = lambda w, n: n >= least and n >= STANDS_OUT * share * (usual[w] + 0.5)
    # a word has no more contexts than occurrences, so contexts are kept of few words only
    occurs: Counter[bytes] = Counter()
    for t in toxic:
        occurs.update(w.strip(EDGE) for w in words_of(t))
    contexts: dict[bytes, set[tuple[bytes, bytes]]] = {w: set() for w, n in occurs.items() if len(w) > 2 and enough(w, n)}
    for t in toxic:
        ws = words_of(t)
        for before, w, after in zip([b"", *ws], ws, [*ws[1:], b""]):
            w = w.strip(EDGE)
            if w in contexts:
                contexts[w].add((before, after))
    return [w for w in sorted(contexts) if enough(w, len(contexts[w])) for _ in contexts[w]]


def dictionaries(toxic: list[str], ordinary: list[str], rng: np.random.Generator) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary; the toxic one is empty where nothing stands out."""
    samples = sorted({w for t in ordinary[:MOST_TEXTS] for w in windows(words_of(t))})
    found = standing_out(toxic, ordinary)
    found = [found[i] for i in rng.permutation(len(found))]
    found = [b" " + b" ".join(found[i : i + 4]) + b" " for i in range(0, len(found), 4)]
    pick = lambda x: [x[i] for i in rng.permutation(len(x))[:MOST_WINDOWS]]
    return train_dictionary(pick(samples), ORDINARY_BYTES), train_dictionary(pick(found), TOXIC_BYTES) if found else b""


def train(rows: list[tuple[str | None, int]], seed: int = 7) -> ToxicModel:
    """From (text, toxic 0 or 1). The weights come from two pairs of dictionaries, each made from half of the texts and tried
    on the other half; the model's own pair is then made from all."""
    rng = np.random.default_rng(seed)
    texts = {label: list(dict.fromkeys(t or "" for t, y in rows if y == label)) for label in (0, 1)}
    if not texts[0] or not texts[1]:
        return ToxicModel()
    mixed = {y: [t[i] for i in rng.permutation(len(t))] for y, t in texts.items()}
    x, y = [], []
    for turn in (0, 1):
        seen, unseen = ({y: t[at::2] or t for y, t in mixed.items()} for at in (turn, 1 - turn))  # a single text does for both
        ordinary, toxic = dictionaries(seen[1], seen[0], rng)
        plain, both = compressor(ordinary).compress, compressor(toxic + ordinary).compress
        for label in (0, 1):
            for t in unseen[label]:
                x.append(features([len(plain(w)) - len(both(w)) for w in windows(words_of(t))]))
                y.append(label)
    ordinary, toxic = dictionaries(mixed[1], mixed[0], rng)
    return ToxicModel(ordinary, toxic, logistic(np.array(x), np.array(y, float))) if toxic else ToxicModel()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    mean[0], spread[0] = 0, 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    out = w / spread
    out[0] -= (w * mean / spread)[1:].sum()
    return out


def held_out(id_col) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learns from a bounded sample of the labelled rows that are not held out."""
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    y = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(labels[id_col])).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).distinct()
    picked = sample_about(y.where("y = 1"), SAMPLE_TOXIC, F.col("id")).unionByName(sample_about(y.where("y = 0"), SAMPLE_ORDINARY, F.col("id")))
    # about ten thousand keys, a known bound; of rows with one id the least text
    rows = d.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return train([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["id"], r["y"], r["text"] or ""))])


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, held_out, score and predicted. No shuffle."""

    def make():
        one = model.scorer()

        def step(batch):
            s = [one(t) for t in batch["text"]]
            return {"id": batch["id"], "score": s, "predicted": [int(v >= 0.5) for v in s]}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), make, f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_ordinary(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic. No shuffle, no join."""
    import pyarrow as pa

    from memlift.shipping import ship

    at = docs.columns.index(text_col)

    def run(batches):
        one = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                yield part.filter(pa.array([one(t.as_py()) < 0.5 for t in part.column(at)], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
