"""Quality classifier with supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams (short ones inside a word and its blanks, long ones across words)
are hashed to learned vectors; a document is the average of its vectors, and a softmax over it gives the label.
Training is stochastic gradient descent in numpy over a bounded sample of labelled rows. As the score is linear in the
average, a trained model is one number for each bucket, and scoring is a vectorised sum over whole texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample, sigmoid, sums
from .tables import read
from .textnp import Words, blocks, mix

#: Labelled rows of either label, and characters of a text, that are learnt from at most: 24 million characters in all.
EACH, CHARS = 1500, 8_000
#: Lengths of n-grams that stay inside a word, and of those that don't. Chosen on a quarter of the rows that may be learnt from.
BUCKETS_LOG2, DIM, GRAMS, ACROSS = 18, 16, (3,), (6, 8)


def features(offsets: np.ndarray, data: np.ndarray):
    """Yields (buckets, first of each text and the end) for each kind of feature of a block."""
    w = Words(offsets, data, lower=False)
    place = lambda h, salt: (mix(h + np.uint64(salt)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    h = w.hashes()
    yield place(h, 1), w.first
    owner = w.owner()
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    yield place(mix(h[pair]) + h[pair + 1], 2), np.searchsorted(pair, w.first)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    n = len(chars) - 1
    blank = np.concatenate([[0], np.cumsum((data[chars[:-1]] <= 32).astype(np.int64))])
    text = np.searchsorted(offsets, chars[:-1], "right")
    for g in (*GRAMS, *ACROSS):
        if n < g:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        whole = text[: n - g + 1] == text[g - 1 :]
        inside = np.flatnonzero(whole if g in ACROSS else whole & (blank[g - 1 : n] == blank[1 : n - g + 2]))
        yield place(w.span_hash(chars[inside], chars[inside + g]), g), np.searchsorted(chars[inside], offsets)


def train(texts: list[str], labels: np.ndarray, odds: float, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """The number for each bucket and the bias. ``odds``: the log-odds of label 1 where the model is used."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, n = np.unique(np.concatenate([f for f, _ in features(np.array([0, len(raw)]), raw)]), return_counts=True)
        bags.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            pace = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= pace * np.outer(p, hidden)
            bias -= 0.1 * pace * p
            vectors[ids] -= (pace * share * np.sqrt(len(ids)))[:, None] * back
    ones = labels.sum()
    shift = odds - np.log((ones + 1) / (len(labels) - ones + 1))
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0] + shift)


def scores(column, table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 of each text of an Arrow column."""
    out = []
    for _, offsets, data in blocks(column):
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for f, first in features(offsets, data):
            total += sums(table[f], first)
            n += np.diff(first)
        out.append(sigmoid(total / np.maximum(n, 1) + bias))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """The model for ``quality``. Null texts and labels teach nothing; without labelled rows every score is near 0.5. Of several
    texts or labels under one doc_id, the least text and the largest label count; so ties don't depend on the order of rows."""
    return train(*sample(docs, labels, label, EACH, CHARS))


def quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with a column score (a column of its own of that name is replaced). Every row has its score, repeated rows the same. Null and empty texts get the score of no features, the bias."""
    table, bias = model

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(scores(text, table, bias))

    return docs.withColumn("score", score("text"))


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = quality(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
