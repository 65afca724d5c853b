"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the sum of the vectors of its character n-grams and of the word itself, hashed into BUCKETS rows of one
table; a document is the mean over its words and PRIOR_WORDS zero vectors, which keep short texts near the prior; a
linear softmax reads the mean. Table and softmax are trained together (Adam on the softmax loss, with weight decay), so
a misspelling or a form that was never seen shares most of its n-grams' vectors with known words. Both classes weigh
the same in that loss; as most documents are clean, CAUTION is then taken from the bias, for the prior of the classes.

Training reads the documents of at most TRAIN_ROWS labelled ids of each class, whole, the first by a hash of the id
that have a document: the only bounded sample here. Scoring is a plain pass over all whole texts. As the model is linear in the mean, a word adds one number,
which is remembered for each worker; what travels to the executors is one number per bucket.

Defined results: null, empty and wordless texts score by the prior alone. Labels that are null, or whose id is null or
has no document, are not learned from and take no place in the sample. An id is learned from once for each label that
it has, with the least of its texts; repeated rows are scored like others. With no labelled rows, or
labels of one kind only, the score is the smoothed share of label 1. An empty table gives an empty result. Other
columns, the labels among them, are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches

TRAIN_ROWS = 2500
#: Ids of each class that are broadcast at most.
BROADCAST_IDS = 1_000_000
BUCKETS = 1 << 17
DIM = 6
N_GRAMS = (3, 4, 5, 6)
EPOCHS = 150
RATE = 0.2
#: Holds back the vectors of n-grams that few documents explain.
DECAY = 1e-5
#: The mean over words is multiplied by this, so that a few words among hundreds can decide.
SCALE = 30.0
#: Least training documents of a word, as in other subword models: rarer words are no examples of their own and are scored by their n-grams.
MIN_DOCS = 3
#: Zero vectors that the mean takes in beside the distinct words: few words prove little.
PRIOR_WORDS = 20
#: Taken from the trained bias: classes are trained as if equally frequent, but most documents are clean. Chosen on an
#: inner fold (crc32 mod 5 = 1, trained on the others but the held-out one): the least within two errors of the fewest.
CAUTION = 1.125
FOLDS, HELD_OUT = 5, 0
WORD_CACHE = 200_000
_WORD = re.compile(r"[^\W_]+")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _trust(distinct: int) -> float:
    return distinct / (distinct + PRIOR_WORDS)


def buckets(word: str, size: int = BUCKETS) -> list[int]:
    """The rows of a word's n-grams, with marks at its ends, and of the whole word."""
    marked = f"<{word}>"
    text = marked.encode() if marked.isascii() else marked  # grams are of characters; here a character is a byte
    grams = [text[i : i + n] for n in N_GRAMS for i in range(len(text) - n + 1)]
    if text is marked:
        grams = [g.encode() for g in grams]
    mask = size - 1
    return [zlib.crc32(g) & mask for g in grams] + [zlib.crc32(b"=" + marked.encode()) & mask]


@dataclass
class Model:
    """weights: of each bucket, its vector times the softmax's difference of the two classes."""

    weights: np.ndarray
    bias: float
    scale: float = SCALE

    def scorer(self):
        weights, size = self.weights.tolist(), len(self.weights)

        def weight(word: str) -> float:
            rows = buckets(word, size)
            return sum(map(weights.__getitem__, rows)) / len(rows)

        old: dict[str, float] = {}  # two generations: what is in use stays known

        class Remembered(dict):
            def __missing__(inner, w):
                out = old.get(w)
                if out is None:
                    out = weight(w)
                if len(inner) >= WORD_CACHE:
                    old.clear()
                    old.update(inner)
                    inner.clear()
                inner[w] = out
                return out

        known = Remembered()

        def score(text: str | None) -> float:
            words = words_of(text)
            z = self.bias + (self.scale * _trust(len(set(words))) * sum(map(known.__getitem__, words)) / len(words) if words else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def train(texts: Iterable[str | None], labels: Iterable[int], buckets_size: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 7, min_docs: int = MIN_DOCS) -> Model:
    """Fit table and softmax jointly; the same texts in the same order give the same model."""
    y = np.array(list(labels), dtype=np.float64)
    positive = y.sum()
    if not len(y) or positive in (0, len(y)):
        return Model(np.zeros(buckets_size, dtype=np.float32), float(np.log((positive + 1) / (len(y) - positive + 1))))
    vocabulary: dict[str, int] = {}
    counted = [Counter(words_of(t)) for t in texts]
    spread = Counter(w for c in counted for w in c)
    doc_of, word_of, weight = [], [], []
    for d, counts in enumerate(counted):
        total = sum(counts.values())
        for w, n in counts.items():
            if spread[w] >= min_docs:
                doc_of.append(d)
                word_of.append(vocabulary.setdefault(w, len(vocabulary)))
                weight.append(n / total * SCALE * _trust(len(counts)))
    if not vocabulary:
        return Model(np.zeros(buckets_size, dtype=np.float32), float(np.log(positive / (len(y) - positive))))
    doc_of, word_of, weight = np.array(doc_of, dtype=np.int32), np.array(word_of, dtype=np.int32), np.array(weight, dtype=np.float32)[:, None]
    grams = [buckets(w, buckets_size) for w in vocabulary]
    sizes = np.array([len(g) for g in grams], dtype=np.float32)[:, None]
    used, gram_of = np.unique(np.concatenate([np.array(g, dtype=np.int32) for g in grams]), return_inverse=True)
    owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    starts = np.searchsorted(owner, np.arange(len(grams)))
    docs_seen, doc_starts = np.unique(doc_of, return_index=True)
    by_word, by_gram = np.argsort(word_of, kind="stable"), np.argsort(gram_of, kind="stable")
    word_starts = np.searchsorted(word_of[by_word], np.arange(len(grams)))
    gram_starts = np.searchsorted(gram_of[by_gram], np.arange(len(used)))
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((len(used), dim)) * 0.01).astype(np.float32)
    softmax = np.stack([-np.ones(dim), np.ones(dim)]).astype(np.float32) * rng.choice([-0.5, 0.5], dim).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    class_weight = np.where(y > 0, 0.5 / positive, 0.5 / (len(y) - positive)).astype(np.float32)[:, None]
    target = np.stack([1 - y, y], axis=1).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, softmax, bias)]
    for epoch in range(1, epochs + 1):
        vectors = np.add.reduceat(table[gram_of], starts, axis=0) / sizes
        mean = np.zeros((len(y), dim), dtype=np.float32)
        mean[docs_seen] = np.add.reduceat(vectors[word_of] * weight, doc_starts, axis=0)
        z = mean @ softmax.T + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * class_weight
        down = np.add.reduceat(((error @ softmax)[doc_of] * weight)[by_word], word_starts, axis=0) / sizes
        gradients = [np.add.reduceat(down[owner[by_gram]], gram_starts, axis=0) + DECAY * table, error.T @ mean + DECAY * softmax, error.sum(axis=0)]
        rate = RATE * (1 - epoch / (epochs + 1))
        for value, gradient, (m, v) in zip((table, softmax, bias), gradients, moments):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    weights = np.zeros(buckets_size, dtype=np.float32)
    weights[used] = table @ (softmax[1] - softmax[0])
    return Model(weights, float(bias[1] - bias[0]) - CAUTION)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list:
    """doc_id, text, toxic of at most `rows` labelled, not held-out ids of each label, the first by a hash of the id that have a document."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = {label: marked.filter(F.col("toxic") == label).distinct() for label in (0, 1)}
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(*order))
    drawn = rows
    while True:  # ordered limits keep `drawn` ids of each task; only labels without documents make a second turn
        chosen = ids[0].orderBy(*order).limit(drawn).unionAll(ids[1].orderBy(*order).limit(drawn))
        found = texts.join(F.broadcast(chosen) if drawn <= BROADCAST_IDS else chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        out = [(r.doc_id, r.text, r.toxic) for r in found.withColumn("place", place).filter(F.col("place") <= rows).collect()]
        have = Counter(toxic for _, _, toxic in out)
        if all(have[label] == rows or ids[label].limit(drawn).count() < drawn for label in ids):
            break
        drawn *= 4
    return sorted(out, key=lambda r: (r[0], r[1] or "", r[2]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    found = training_rows(docs, labels, rows)
    return train([text for _, text, _ in found], [toxic for _, _, toxic in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            values = [scorer(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows that the model calls toxic; one pass, no join."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
