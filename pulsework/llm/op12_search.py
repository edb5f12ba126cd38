"""Ranked lexical search with range-maximum sparse tables.

``index`` turns the rows of a table into segments: each task keeps the posting lists of a run of its own rows (places and
occurrences of each term), so nothing is shuffled and a segment's size is bounded. ``search`` sends the items to the segments:

* A posting's impact is what it adds to a score. A sparse table over all impacts of a segment gives the largest impact of any
  range of a posting list in two look-ups, and where it is.
* An interval of documents has one range of each posting list. The sum of the ranges' largest impacts bounds the score of
  every document in it. Intervals are taken best first, a few at a time; each is split at the document with the largest
  single impact, which is scored whole. An item is done with a segment when no interval can reach its ``k`` best so far.

The best of each task are merged in two steps, so an item's list never grows with the number of tasks in one place.
All scores are 64-bit integers; terms are compared by 64-bit hashes.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut, read
from .textnp import Words, blocks

#: Postings and documents after which a segment is closed; a single longer text is a segment of its own.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 15
#: Items that go to the tasks at a time.
ITEMS = 2000
#: Intervals that are split in one step.
AT_ONCE = 64
#: Lists that an item's candidates are dealt into for the first of the two merges.
LISTS = 64

#: Stands for a null doc_id.
_LAST = (1 << 63) - 1
_SEGMENT = "doc_ids array<long>, lengths array<long>, terms array<long>, first array<int>, places array<int>, occurrences array<int>"


def terms_of(texts: pa.Array) -> list[np.ndarray]:
    """The distinct term hashes (uint64, sorted) of each text."""
    out = []
    for _, offsets, data in blocks(texts):
        w = Words(offsets, data, marks=True)
        h = w.hashes()
        out += [np.unique(h[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """Segments of ``docs`` (doc_id, text; other columns are not looked at): one row for each run of rows.

    ``doc_ids`` and ``lengths`` (terms with repeats) have an entry for each row, ``terms`` the sorted hashes; the postings of
    term i are ``first[i]`` to ``first[i + 1]`` of ``places`` (in the segment) and ``occurrences``. With ``terms`` (sorted
    hashes), only their postings are kept; lengths always count all terms. Null texts have none. An empty table has no segments.
    """
    quick = None
    if terms is not None:
        quick = np.zeros(1 << 20, bool)
        quick[(terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(h):
        at = np.flatnonzero(quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        found = np.minimum(np.searchsorted(terms, h[at]), len(terms) - 1)
        return at[terms[found] == h[at]]

    def build(batches):
        ids, lengths, hashes, places, counts, held, n = [], [], [], [], [], 0, 0
        for batch in batches:
            for at, offsets, data in blocks(batch.column(1)):
                w = Words(offsets, data, marks=True)
                h, owner = w.hashes(), w.owner()
                if terms is not None:
                    keep = known(h)
                    h, owner = h[keep], owner[keep]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)])
                ids.append(batch.column(0).slice(at, len(offsets) - 1))
                lengths.append(w.counts)
                hashes.append(h[new])
                places.append(owner[new] + n)
                counts.append(np.diff(np.r_[new, len(h)]))
                n += len(offsets) - 1
                held += len(new)
                if held >= POSTINGS or n >= DOCUMENTS:
                    yield close(ids, lengths, hashes, places, counts)
                    ids, lengths, hashes, places, counts, held, n = [], [], [], [], [], 0, 0
        if n:
            yield close(ids, lengths, hashes, places, counts)

    def close(ids, lengths, hashes, places, counts):
        ids, length, h, place, count = pa.concat_arrays(ids), *(np.concatenate(x) for x in (lengths, hashes, places, counts))
        by_id = np.argsort(ids.fill_null(_LAST).to_numpy(), kind="stable")
        moved = np.empty(len(by_id), np.int64)
        moved[by_id] = np.arange(len(by_id))
        place = moved[place]
        order = np.lexsort((place, h))
        h = h[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [ids.take(pa.array(by_id)), pa.array(length[by_id].astype(np.int64)), pa.array(h[start].view(np.int64)), pa.array(np.r_[start, len(h)].astype(np.int32)), pa.array(place[order].astype(np.int32)), pa.array(count[order].astype(np.int32))]
        return pa.RecordBatch.from_arrays([one(c) for c in columns], ["doc_ids", "lengths", "terms", "first", "places", "occurrences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, _SEGMENT)


class Tables:
    """Impacts of a segment's postings, and their range-maximum sparse table."""

    def __init__(self, ids, lengths, terms, first, places, occurrences, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.terms, self.first, self.places = ids, terms, first.astype(np.int64), places.astype(np.int64)
        tf, m = occurrences.astype(np.int64), 10 + 90 * lengths[places] * n_docs // max(1, n_terms)
        spans = np.diff(self.first)
        self.impact = np.repeat(weights, spans) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        self.keys = np.repeat(np.arange(len(terms)), spans) * len(ids) + self.places  # rising: of a term and a document
        longest, size = int(spans.max(initial=1)), len(places)
        self.table = np.empty((longest.bit_length(), size), np.int32)
        self.table[0] = np.arange(size)
        for j in range(1, len(self.table)):
            half = 1 << (j - 1)
            self.table[j] = self.table[j - 1]  # places past the last whole window are never asked for
            a, b = self.table[j - 1, : size - half], self.table[j - 1, half:]
            np.copyto(self.table[j, : size - half], b, where=self.impact[b] > self.impact[a])
        self.log = np.frexp(np.arange(longest + 1, dtype=np.float64))[1] - 1

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest impact of each range [a, b) of a posting list is (the first of equal ones), and that impact; 0 for an empty range."""
        j, last = self.log[np.maximum(b - a, 1)], len(self.places) - 1
        left, right = self.table[j, np.minimum(a, last)], self.table[j, np.clip(b - (1 << j), 0, last)]
        x, y = self.impact[left], self.impact[right]
        return np.where(y > x, right, left), np.where(b > a, np.maximum(x, y), 0)

    def best(self, terms: np.ndarray, k: int, kept: list[tuple[int, int]]) -> None:
        """Puts documents into ``kept``, the heap of the ``k`` best (score, minus doc_id) so far."""
        at = np.searchsorted(self.terms, terms)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == terms] if len(self.terms) else at[:0]
        if not len(at):
            return
        able = lambda bound, low: bound > 0 and (len(kept) < k or bound > kept[0][0] or bound == kept[0][0] and low <= -kept[0][1])
        n, last = len(self.ids), len(self.places) - 1
        a, b = self.first[at], self.first[at + 1]
        place, top = self.largest(a, b)
        heap = [(-int(top.sum()), 0, a, b, place, top)]  # the best bound first, then the first documents
        while heap and able(-heap[0][0], self.ids[heap[0][1]]):
            step = [heapq.heappop(heap) for _ in range(min(AT_ONCE, len(heap)))]
            low = np.array([s[1] for s in step])
            a, b, place, top = (np.stack([s[i] for s in step]) for i in (2, 3, 4, 5))
            doc = self.places[place[np.arange(len(step)), top.argmax(1)]]
            mid = np.searchsorted(self.keys, at * n + doc[:, None])
            found = np.minimum(mid, last)
            has = (mid < b) & (self.places[found] == doc[:, None])
            for d, score in zip(doc.tolist(), np.where(has, self.impact[found], 0).sum(1).tolist(), strict=True):
                if able(score, self.ids[d]):
                    (heapq.heappush if len(kept) < k else heapq.heappushpop)(kept, (score, -int(self.ids[d])))
            low, a, b = np.concatenate([low, doc + 1]), np.concatenate([a, mid + has]), np.concatenate([mid, b])
            place, top = self.largest(a, b)
            for i, bound in enumerate(top.sum(1).tolist()):
                if low[i] < n and able(bound, self.ids[low[i]]):
                    heapq.heappush(heap, (-bound, int(low[i]), a[i], b[i], place[i], top[i]))


def weights(segments: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The weight of each of the terms (sorted hashes), the documents with at least one term, and the terms of all documents with repeats."""

    def count(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, known, first = (batch.column(c)[r].values.to_numpy() for c in (1, 2, 3))
                at = np.flatnonzero(np.isin(known.view(np.uint64), terms))
                names = np.r_[known[at], 0, 0]
                n = np.r_[np.diff(first)[at], (lengths > 0).sum(), lengths.sum()].astype(np.int64)
                kind = np.r_[np.zeros(len(at)), 1, 2].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(names), pa.array(n)], ["kind", "term", "n"])

    found = segments.mapInArrow(count, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).toArrow()
    kind, term, n = (found[c].to_numpy() for c in ("kind", "term", "n"))
    n_docs, n_terms = (int(n[kind == i].sum()) for i in (1, 2))
    df = np.zeros(len(terms), np.int64)
    df[np.searchsorted(terms, term[kind == 0].view(np.uint64))] = n[kind == 0]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64), n_docs, n_terms


def search(segments: DataFrame, items: dict[int, np.ndarray], k: int = 10) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item (number: distinct term hashes).

    Equal scores are ranked by doc_id, a null one last. Items without terms, or with terms that no document has, have no rows.
    Documents under one doc_id are documents of their own. The items go to every task, so there are at most ``ITEMS``.
    """
    if len(items) > ITEMS:
        raise ValueError(f"at most {ITEMS} items at a time")
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *items.values()]))
    weight, n_docs, n_terms = weights(segments, terms)

    def scan(batches):
        kept: dict[int, list] = {i: [] for i in items}
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values.fill_null(_LAST).to_numpy(zero_copy_only=False)
                lengths, known, first, places, occurrences = (batch.column(c)[r].values.to_numpy() for c in range(1, 6))
                known = known.view(np.uint64)
                at = np.minimum(np.searchsorted(terms, known), max(0, len(terms) - 1))
                own = weight[at] * (terms[at] == known) if len(terms) else np.zeros(len(known), np.int64)
                if not len(places):
                    continue
                tables = Tables(ids, lengths, known, first, places, occurrences, own, n_docs, n_terms)
                for i, hashes in items.items():
                    tables.best(hashes, k, kept[i])
        rows = [(i, -d, s) for i, best in kept.items() for s, d in best]
        item, doc, score = (pa.array([x[c] for x in rows], pa.int64()) for c in range(3))
        yield pa.RecordBatch.from_arrays([item, doc, score], ["item", "doc_id", "score"])

    found = segments.mapInArrow(scan, "item long, doc_id long, score long")
    order = [F.desc("score"), "doc_id"]
    lists = Window.partitionBy("item", "list").orderBy(*order)
    found = found.withColumn("list", F.pmod(F.xxhash64("doc_id"), F.lit(LISTS))).withColumn("rank", F.row_number().over(lists)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item", "rank", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Every row of ``items`` is an item of its own, also repeated ones and those with a null item_id; null and empty texts find
    nothing. Other columns are not looked at. Without documents or items there are no rows. Items are taken ``ITEMS`` at a time.
    """
    spark = docs.sparkSession

    def hashed(batches):
        for batch in batches:
            each = terms_of(batch.column(1))
            flat = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(flat))], ["item_id", "terms"])

    rows = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(hashed, "item_id long, terms array<long>").withColumn("item", F.monotonically_increasing_id()))
    n = rows.count()
    groups = 1 if n <= ITEMS else -(-2 * n // ITEMS)
    segments = cut(index(docs)) if groups > 1 else None  # one item table needs its own terms only
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        some = {r.item: np.array(r.terms, np.int64).view(np.uint64) for r in own}
        names = spark.createDataFrame([(r.item, r.item_id) for r in own], "item long, item_id long")
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *some.values()]))
        found = search(segments or cut(index(docs, terms)), some, k).join(F.broadcast(names), "item")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark, sf_dir):
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes),
postings AS (SELECT t, doc_id, count(*) AS tf FROM terms GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY t),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), totals GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10"""
