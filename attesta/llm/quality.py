"""Quality classification with supervised subword embeddings.

A document is the average of learned vectors: one hashed vector for each word and one for each of its character
n-grams (3 to 5 letters of `<word>`), and one shared vector for word bigrams that repeat a word.  A softmax layer gives the classes; everything is trained by stochastic gradient
descent in numpy.  The score is linear before the softmax, so after training each feature has one number, each
distinct word has one sum, and scoring a text costs one lookup a word.

Learning takes a hash sample of about `sample_docs` labelled rows that no evaluation holds out; texts are whole.  The
sample stops at `train_chars` letters.  Both bounds are parameters and do not grow with the input.

Null and empty texts have no feature and get the score of the classes' base rate.  With labels of only one class (or
none) every score is that class (or 0.5).  Several labels of a document count by their majority, ties as quality 1.
Other columns are never read.
"""

from __future__ import annotations

import math
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import hashed_below, held_out, keep_texts, map_columns, materialise, remove, worker_state

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
#: The bucket after all others is for a word that follows itself; it counts as much as so many n-grams.
REPEATED, REPEAT_WEIGHT = BUCKETS, 8
THRESHOLD = 0.7


def features(word: str) -> list[int]:
    """Buckets of the word and of its n-grams."""
    w = f"<{word}>".encode()
    return [crc32(w) % BUCKETS, *(crc32(w[i : i + n], n) % BUCKETS for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1))]


class SubwordClassifier:
    def __init__(self, seed: int = 7):
        self.seed = seed
        self.feature = np.zeros(BUCKETS + 1, np.float32)  # after training: each bucket's part of the log odds
        self.bias = 0.0
        self.base = 0.0

    def fit(self, texts: list[str], labels: list[int], epochs: int = 8, rate: float = 4.0, l2: float = 1e-6) -> SubwordClassifier:
        y = np.array(labels, np.int64)
        positive = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(positive / (1 - positive)))
        if len(set(labels)) < 2:
            return self
        rng = np.random.default_rng(self.seed)
        memo = Memo(lambda w: np.array(features(w), np.int32))
        docs = []
        for t in texts:
            words = t.split()
            again = np.full(REPEAT_WEIGHT * sum(map(eq, words, words[1:])), REPEATED, np.int32)
            ids, counts = np.unique(np.concatenate([*map(memo.__getitem__, words), again]), return_counts=True)
            docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
        table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
        out = np.zeros((DIM, 2), np.float32)
        shift = np.zeros(2, np.float32)
        steps, step = epochs * len(docs), 0
        weight = np.array([0.5 / max(1e-9, 1 - positive), 0.5 / positive]) ** 0.5  # half way to balanced classes
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                ids, share = docs[k]
                lr = rate * (1 - step / steps) * weight[y[k]]
                step += 1
                if not len(ids):
                    continue
                rows = table[ids]
                hidden = share @ rows
                z = hidden @ out + shift
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1
                back = out @ p
                out -= (0.1 * lr) * np.outer(hidden, p)
                shift -= (0.02 * lr) * p
                table[ids] = rows - lr * (share[:, None] * back + l2 * rows)
        self.feature = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(shift[1] - shift[0])
        return self

    def scorer(self):
        """A function from a text to the probability of label 1."""
        feature = self.feature
        repeated = float(feature[REPEATED])
        memo = Memo(lambda w: (float(feature[f := features(w)].sum()), len(f)), most=80_000)

        def score(text: str | None) -> float:
            words = (text or "").split()
            if not words:
                return sigmoid(self.base)
            a, n = zip(*map(memo.__getitem__, words))
            again = REPEAT_WEIGHT * sum(map(eq, words, words[1:]))
            return sigmoid((sum(a) + again * repeated) / (sum(n) + again) + self.bias)

        return score


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", sample_docs: int = 2500, train_chars: int = 6_000_000) -> SubwordClassifier:
    """Only the sampled label rows (bounded by sample_docs) are broadcast, and only texts that fit in train_chars are
    collected; documents are read once and not shuffled."""
    rows = labels.where(may_learn & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).alias("label"))
    n = rows.count()
    sampled = {}
    for r in rows.where(hashed_below(min(1.0, sample_docs / max(1, n)), F.col("doc_id"), F.lit("quality"))).collect():
        sampled.setdefault(r[0], []).append(r[1])
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(k, int(2 * sum(v) >= len(v))) for k, v in sampled.items()], "doc_id long, label int")
    drawn = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample, path = materialise(drawn.select(F.xxhash64("doc_id", "text").alias("h"), "text", "label"), "quality-sample")
    size, fits = 0, []
    for h, chars in sorted(map(tuple, sample.select("h", F.length("text")).collect())):
        if not fits or size + chars <= train_chars:
            size += chars
            fits.append((h,))
    wanted = spark.createDataFrame(sorted(set(fits)), "h long")
    got = sorted(sample.join(F.broadcast(wanted), "h", "left_semi").select("h", "text", "label").collect())
    remove(spark, path)
    return SubwordClassifier().fit([r[1] for r in got], [r[2] for r in got])


def score(docs: DataFrame, model: SubwordClassifier, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted (1 if score >= threshold)."""
    rows = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = scorer_of(shared.value)

        def run(keys, texts):
            scores = [f(t) for t in texts]
            return keys, scores, [int(s >= threshold) for s in scores]

        return run

    return map_columns(rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double, predicted int", make)


def good(docs: DataFrame, model: SubwordClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = scorer_of(shared.value)
        return lambda texts: [f(t) >= threshold for t in texts]

    return keep_texts(docs, make)


def scorer_of(model: SubwordClassifier):
    return worker_state("quality", model, SubwordClassifier.scorer)


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labelled rows that are not held out, scores all."""
    out = score(docs, learn(docs, labels, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
