"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so the labelled tokens are made first: in a toxic text, a token is toxic if its word or the
head of its word is many times as frequent in toxic texts as in others. A chain of two states over all tokens of a text
learns from them, with hashed words, heads of words and neighbours as features. Forward-backward marginals give the
offending offsets, and a small logistic model over their sums and maxima gives the document's score.

With two states, the forward and the backward messages are one ratio each, which every token maps by a linear
fraction; these are composed in blocks, so a whole block of texts is tagged by vector operations, exactly.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sampled, sigmoid, sums
from .tables import fresh, read
from .textnp import Words, blocks, mix

#: Labelled rows of either label, and characters of a text, that are learnt from at most.
EACH, CHARS = 2500, 8_000
#: One learnt text in so many is for the document's score alone.
APART = 4
#: A token is labelled toxic if it has as many contexts in toxic texts at least, at this many times the rate of other texts.
LEAST, TIMES = 8, 8
BUCKETS_LOG2, HEADS = 18, (5, 6, 7, 8)
_ROW = 64


def places(w: Words) -> list[np.ndarray]:
    """The buckets of each feature of each token. A head longer than its word is the word again, with another salt."""
    place = lambda h, salt: (mix(h + np.uint64(salt)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    h = w.hashes()
    before, after = np.roll(h, 1), np.roll(h, -1)
    full = w.first[:-1][w.counts > 0]
    before[full] = 0
    after[w.first[1:][w.counts > 0] - 1] = 0
    return [x.astype(np.int32) for x in (place(h, 1), *(place(w.head_hashes(k), 10 + k) for k in HEADS), place(before, 2), place(after, 3))]


def scan(a, b, c, d, at: float = 1.0) -> np.ndarray:
    """r[t] = (a[t] + b[t] * r[t-1]) / (c[t] + d[t] * r[t-1]), with r[-1] = at."""
    n = len(a)
    rows = -(-n // _ROW)
    pad = lambda x, v: np.concatenate([x, np.full(rows * _ROW - n, v)]).reshape(rows, _ROW).T.copy()
    a, b, c, d = pad(a, 0.0), pad(b, 1.0), pad(c, 1.0), pad(d, 0.0)
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)  # (p x + q) / (r x + s)
    for t in range(_ROW):
        p, q, r, s = b[t] * p + a[t] * r, b[t] * q + a[t] * s, d[t] * p + c[t] * r, d[t] * q + c[t] * s
        norm = 1 / (p + q + r + s)
        p, q, r, s = p * norm, q * norm, r * norm, s * norm
    starts = np.empty(rows)
    for i, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        starts[i] = at
        at = (w * at + x) / (y * at + z)
    out, now = np.empty((_ROW, rows)), starts
    for t in range(_ROW):
        now = out[t] = (a[t] + b[t] * now) / (c[t] + d[t] * now)
    return out.T.ravel()[:n]


def messages(emit: np.ndarray, chain: np.ndarray, first: np.ndarray):
    """Forward and backward ratios (state 1 to state 0) of each token; ``chain``: start, then 00, 01, 10, 11, as logarithms."""
    n, e = len(emit), np.exp(np.clip(emit, -20, 20))
    start, k00, k01, k10, k11 = np.exp(np.clip(chain, -20, 20))
    texts = np.unique(first[:-1][np.diff(first) > 0])
    new, last = np.zeros(n, bool), np.zeros(n, bool)
    new[texts] = True
    last[np.append(texts[1:], n)[: len(texts)] - 1] = True
    f = scan(np.where(new, e * start, e * k01), np.where(new, 0.0, e * k11), np.where(new, 1.0, k00), np.where(new, 0.0, k10))
    after = np.append(e[1:], 1.0)
    g = scan(*(np.where(last, x, y)[::-1] for x, y in ((1.0, k10), (0.0, k11 * after), (1.0, k00), (0.0, k01 * after))))[::-1]
    return f, g, e, new


def marginals(w: Words, table: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The probability that each token is toxic."""
    if not len(w):
        return np.zeros(0)
    f, g, _, _ = messages(sum(table[x] for x in places(w)), chain, w.first)
    return f * g / (1 + f * g)


def digest(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the document's score is made from: 1, and sums and maxima of the marginals."""
    n = np.diff(first)
    total, top = sums(p, first), np.zeros(len(n))
    if len(p):
        top[n > 0] = np.maximum.reduceat(p, first[:-1][n > 0])
    return np.stack([np.ones(len(n)), np.log1p(total), np.minimum(total, 5) / 5, top, np.sqrt(total / np.maximum(n, 1))], 1)


def pieces(texts: list[str], labels: np.ndarray):
    """The words of some texts at a time and their labels, so that memory for vectors of all words is never needed."""
    for at, offsets, data in blocks(pa.array(texts, pa.large_string())):
        yield Words(offsets, data, marks=True), labels[at : at + len(offsets) - 1]


def spans(w: Words):
    """Hashes of the words, then of their heads."""
    yield w.hashes()
    yield from (w.head_hashes(k) for k in HEADS)


def toxic_names(texts: list[str], labels: np.ndarray) -> list[np.ndarray]:
    """The words, and the heads of each length, that are far more frequent in toxic texts than elsewhere.

    A name counts once for each pair of neighbours it has, so what stands in many copies of one text counts once.
    """
    kept = []
    for kind in range(1 + len(HEADS)):
        sides = [[np.zeros((0, 2), np.uint64)], [np.zeros((0, 2), np.uint64)]]
        for w, toxic in pieces(texts, labels):
            h = w.hashes()
            if not len(h):
                continue
            around = mix(np.roll(h, 1)) + np.roll(h, -1)
            name, mine = next(x for i, x in enumerate(spans(w)) if i == kind), toxic[w.owner()] == 1
            for i, rows in enumerate((~mine, mine)):
                sides[i].append(np.stack([name[rows], around[rows]], 1))
        counts = []
        for parts in sides:
            rows = np.concatenate(parts)
            parts.clear()
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            counts.append((np.unique(rows[new, 0], return_counts=True), max(1, int(new.sum()))))
        ((zero, nz), all0), ((one, n1), all1) = counts
        at = np.minimum(np.searchsorted(zero, one), max(len(zero) - 1, 0))
        else_ = np.where(zero[at] == one, nz[at], 0) if len(zero) else np.zeros(len(one))
        kept.append(one[(n1 >= LEAST) & (n1 / all1 >= TIMES * (else_ + 0.5) / all0)])
    return kept


def token_labels(w: Words, toxic: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    """1 for tokens of toxic texts whose word, or a head of it, is among the names."""
    out = np.zeros(len(w), bool)
    for h, of in zip(spans(w), names, strict=True):
        out |= np.isin(h, of)
    return out & (toxic[w.owner()] == 1)


def tagger(texts: list[str], labels: np.ndarray, rounds: int, rate: float):
    """(number for each bucket, chain) of the field, by adaptive gradient steps over all pieces at once."""
    names = toxic_names(texts, labels)
    parts = [(token_labels(w, toxic, names).astype(np.float32), places(w), w.first) for w, toxic in pieces(texts, labels) if len(w)]
    table, chain = np.full(1 << BUCKETS_LOG2, -1.0 / (3 + len(HEADS))), np.array([-3.0, 0.0, -3.0, 0.0, 0.0])
    push, pull = np.full(len(table), 1e-2), np.full(5, 1e-2)
    for _ in range(rounds):
        slope, turn, k = np.zeros(len(table)), np.zeros(5), np.exp(chain)
        for y, at, first in parts:
            f, g, e, new = messages(sum(table[x] for x in at), chain, first)
            p = f * g / (1 + f * g)
            for x in at:
                slope += np.bincount(x, p - y, len(table))
            j = np.flatnonzero(~new)
            four = np.stack([np.full(len(j), k[1]), k[2] * e[j] * g[j], f[j - 1] * k[3], f[j - 1] * k[4] * e[j] * g[j]])
            four /= four.sum(0)
            real = np.stack([(1 - y[j - 1]) * (1 - y[j]), (1 - y[j - 1]) * y[j], y[j - 1] * (1 - y[j]), y[j - 1] * y[j]])
            turn += np.append((p - y)[new].sum(), (four - real).sum(1))
        push += slope**2
        table -= rate * slope / np.sqrt(push)
        pull += turn**2
        chain -= rate * turn / np.sqrt(pull)
    return table.astype(np.float32), chain


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, weights: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic model by Newton's method; a step is halved until the loss falls, so separable labels can't make it run away."""

    def loss(w):
        z = x @ w
        return (share * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w)

    now = loss(weights)
    for _ in range(50):
        q = sigmoid(x @ weights)
        slope = x.T @ (share * (q - y)) + ridge * weights
        way = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
        pace = 1.0
        while (then := loss(weights - pace * way)) > now and pace > 1e-6:
            pace /= 2
        if now - then < 1e-9 * max(1.0, now):
            break
        weights, now = weights - pace * way, then
    return weights


def train(texts: list[str], labels: np.ndarray, odds: float, rounds: int = 30, rate: float = 0.5):
    """(number for each bucket, chain, weights of the document's score). Without labels of both kinds, scores are the rate of label 1.

    One text in ``APART`` is kept from the field: the document's score learns from marginals as unseen texts have them.
    """
    table, chain = np.zeros(1 << BUCKETS_LOG2, np.float32), np.array([-3.0, 0.0, -3.0, 0.0, 0.0])
    weights = np.zeros(5)
    weights[0] = odds
    # in order of a hash of the text, not of the doc_id
    rest = np.array([zlib.crc32(t.encode()) % APART == 0 for t in texts], bool)
    few = [len(np.unique(labels[x])) < 2 for x in (rest, ~rest)]
    if any(few):
        return table, chain, weights
    table, chain = tagger([t for t, r in zip(texts, rest, strict=True) if not r], labels[~rest], rounds, rate)
    x = np.concatenate([digest(marginals(w, table, chain), w.first) for w, _ in pieces([t for t, r in zip(texts, rest, strict=True) if r], labels[rest])])
    labels = labels[rest]
    share = np.where(labels == 1, sigmoid(odds) / labels.sum(), sigmoid(-odds) / (1 - labels).sum()) * len(labels)
    weights = logistic(x, labels, share, weights)
    return table, chain, weights


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """The model for ``tagged``. Null texts and labels teach nothing. Of several texts or labels under one doc_id the least text
    and the largest label count, so ties don't depend on the order of rows. Without rows of both labels all scores are one number.

    A task learns from the sample, which is bounded; the driver gets the model alone.
    """
    rows, odds = sampled(docs, labels, label, EACH, CHARS)

    def learn(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True))
        model = train([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), odds)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in model], ["table", "chain", "weights"])

    found = rows.select("doc_id", "y", "text").repartition(1).mapInArrow(learn, "table binary, chain binary, weights binary").collect()
    if not found:  # no task runs over no rows
        return train([], np.zeros(0, np.int64), odds)
    return tuple(np.frombuffer(bytes(x), kind) for x, kind in zip(found[0], (np.float32, float, float), strict=True))


def read_spans(column: pa.Array, model, least: float):
    """(scores, span of each text as (first span, and the end), starts, ends, largest marginals) of an Arrow column of texts."""
    table, chain, weights = model
    scores, counts, starts, ends, tops = [np.zeros(0)], [np.zeros(0, np.int64)], [], [], []
    for _, offsets, data in blocks(column):
        w = Words(offsets, data, marks=True)
        p, owner = marginals(w, table, chain), w.owner()
        scores.append(sigmoid(digest(p, w.first) @ weights))
        hit = np.flatnonzero(p >= least)
        start = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)]) if len(hit) else hit
        stop = np.append(start[1:], len(hit))[: len(start)] - 1
        o = owner[hit[start]]
        counts.append(np.bincount(o, minlength=len(offsets) - 1))
        starts.append(w.starts[hit[start]] - offsets[o])
        ends.append(w.ends[hit[stop]] - offsets[o])
        if len(hit):
            tops.append(np.maximum.reduceat(p[hit], start))
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return np.concatenate(scores), np.cumsum(np.concatenate([[0], *counts])), join(starts, np.int64), join(ends, np.int64), join(tops, float)


def tagged(docs: DataFrame, model, least: float = 0.5, score: str = "score", spans: str = "spans") -> DataFrame:
    """``docs`` with a score and the offending spans, an array of (start, end, p): byte offsets in the UTF-8 text of each run of tokens
    with a marginal of ``least`` or more, and the largest of them.

    Columns of its own of these two names are replaced; the names are parameters. Every row has its result, repeated rows the
    same. Null texts count as empty; texts without tokens have the score of no toxic token and no spans.
    """

    @F.arrow_udf("struct<score double, spans array<struct<start long, end long, p double>>>")
    def tag(text: pa.Array) -> pa.Array:
        scores, first, starts, ends, tops = read_spans(text, model, least)
        spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), pa.array(tops)], ["start", "end", "p"]))
        return pa.StructArray.from_arrays([pa.array(scores), spans], ["score", "spans"])

    own, both = [c for c in docs.columns if c not in (score, spans)], fresh(docs, "_tagged")
    return docs.select(*own, tag("text").alias(both)).select(*own, F.col(both)["score"].alias(score), F.col(both)["spans"].alias(spans))


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = tagged(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "spans")
