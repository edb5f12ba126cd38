"""Ranked search: against every document's score, with ties, nulls, repeated rows and segments of a few rows."""

import math
import random
import re

import pytest

from pulsework.llm import op12_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 10 + 90 * len(b) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b.count(t) // (1000 * b.count(t) + 8 * m)) for t in set(terms(text)) & set(b))
            scores += [(-s, i is None, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ça", "ÉTÉ", "x9"]
    some = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, some(r.choice([1, 5, 30, 200]))) for i in range(120)]
    docs += [(1000 - i, docs[3][1]) for i in range(40)]  # ties, in falling order of doc_id
    docs += [(7, docs[7][1]), (7, some(20)), (None, docs[3][1]), (None, None), (500, None), (501, ""), (502, " .\n")]
    items = [(i, some(n)) for i, n in enumerate([1, 3, 8, 40])] + [(4, docs[3][1]), (4, docs[3][1]), (5, None), (6, ""), (None, "w1 w2"), (8, "absent"), (9, "w0 W0 w0")]
    return docs, items


@pytest.mark.parametrize("postings, at_once", [(1 << 20, 64), (50, 3)])
def test_against_every_score(spark, texts, monkeypatch, postings, at_once):
    monkeypatch.setattr(op12_search, "POSTINGS", postings)
    monkeypatch.setattr(op12_search, "AT_ONCE", at_once)
    docs, items = texts
    table = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, terms string, rank int").repartition(3)
    bench = spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double")
    got = [tuple(r) for r in op12_search.ranked(table, bench).collect()]
    assert sorted(got, key=str) == brute_force(docs, items)


def test_items_a_few_at_a_time(spark, texts, monkeypatch):
    monkeypatch.setattr(op12_search, "ITEMS", 6)
    docs, items = texts
    got = op12_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:9], "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(docs, items[:9], 3)


def test_index_of_all_terms_gives_the_same(spark, texts):
    docs, items = texts
    hashes = {i: op12_search.terms_of(__import__("pyarrow").array([t]))[0] for i, (_, t) in enumerate(items[:4])}
    whole = op12_search.search(op12_search.index(spark.createDataFrame(docs, "doc_id long, text string")), hashes)
    assert sorted(map(tuple, whole.select("item", "rank", "doc_id", "score").collect()), key=str) == brute_force(docs, items[:4])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert op12_search.ranked(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert op12_search.ranked(docs, docs.withColumnRenamed("doc_id", "item_id").limit(0)).count() == 0
