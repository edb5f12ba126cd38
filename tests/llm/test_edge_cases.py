"""Nulls, empty texts, repeated rows, empty tables and clashing columns; op8 against brute force."""

import os
import random
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest

from pulsework.llm import labelled, op1_sharding, op3_substring, op4_decontamination, op5_mixing, op6_licenses, op7_quality_rules, op8_jaccard, op9_toxicity, op10_html, tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(60)) for _ in range(6)]
    near = [b.replace(b.split()[30], "zz", 1) for b in base[:3]]
    texts = [*base, *near, base[0], None, "", "one two", "one two", " \n ", "Released under the MIT License."]
    return spark.createDataFrame([(i, t, "en", None if i % 5 == 0 else "s", 0, 0.0, "") for i, t in enumerate(texts)], SCHEMA)


def test_jaccard_against_brute_force(docs):
    rows = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in rows.items()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_sharding_is_whole_and_gapless(docs):
    rows = op1_sharding.shard(docs, 3).collect()
    assert len(rows) == docs.count()
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_licenses_and_rules_on_odd_texts(docs):
    rows = {r.doc_id: r for r in op6_licenses.licenses(docs).collect()}
    assert rows[15].base_labels == "mit" and rows[15].first_word == 3 and rows[10].n_words == 0
    assert {r.doc_id for r in op7_quality_rules.quality_rules(docs).collect()} == set(rows)


def test_substring_keeps_first(docs):
    rows = {r.doc_id: r for r in op3_substring.dedup_spans(docs).collect()}
    assert rows[10].text is None and rows[11].text == "" and rows[0].n_removed == 0


def test_decontamination_finds_a_short_item_in_a_text(spark, docs):
    text = docs.where("doc_id = 2").first().text
    bench = spark.createDataFrame([(1, " ".join(text.split()[10:30])), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op4_decontamination.contaminated(docs, bench).collect()} >= {(2, 1)}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op8_jaccard.jaccard_components(none).count() == op1_sharding.shard(none).count() == 0
    assert op4_decontamination.contaminated(docs, bench).count() == op3_substring.dedup_spans(none).count() == 0
    assert op5_mixing.mixed(none, op5_mixing.fit(none, labels)[0]).count() == 0
    assert op9_toxicity.tagged(docs, op9_toxicity.fit(docs, labels)).where("score is null").count() == 0


def test_mixing_rates_against_brute_force(spark):
    r, steps = random.Random(2), [[0.3, -0.5, 1e-07], [-0.2, 0.1, -0.7], [0.9, 0.0, -1e-05]]
    rows = [[r.random() for _ in range(3)] for _ in range(50)]
    for least in (0.0, 1.0):
        got = spark.createDataFrame([(p,) for p in rows], "_p array<double>").select(op5_mixing._rate(steps, least).alias("x")).collect()
        for p, x in zip(rows, got, strict=True):
            rate = 1.0
            for e in steps:
                rate = max(least, rate - sum(a * b for a, b in zip(p, e, strict=True)))
            assert abs(x.x - rate) < 1e-12


def test_page_text():
    page = '<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>A &amp; <b>b<br>c<p>To.</article><footer>f</footer><script>"</p>"'
    assert op10_html.main_text(page, op10_html.tree()) == "T\nA & b c\nTo."
    assert op10_html.main_text("", op10_html.tree()) == ""


def test_substring_finds_every_repeated_run_of_50_words(spark):
    r = random.Random(3)
    some = lambda n, end: " ".join(r.choice("abcdefgh") + str(r.randrange(300)) + (r.choice(".!,") if r.random() < end else "") for _ in range(n))
    long = [some(n, 0) for n in (50, 70, 101)]
    texts = [*long, long[2].upper(), *(some(30, 0.1) + "\n" + some(90, e) for e in (0, 0.02, 0.1, 0.4))]
    texts += [some(7, 0.1) + " " + " ".join(t.split()[a : a + n]) + r.choice([" ", "\n"]) + some(13, 0.2) for t in texts[:8] for a, n in ((0, 50), (11, 60))]
    texts += [texts[5].replace(" ", "\n", 40)]
    rows = op3_substring.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone, seen = {x.doc_id: set(x.removed) for x in rows}, set()
    for i, text in enumerate(texts):
        parts, w = op3_substring.parts_of(text), text.lower().split()
        lost = [k in gone[i] for k, p in enumerate(parts) for _ in p.split()]
        runs, short = ([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] for n in (50, 20))
        assert "".join(parts) == text and len(lost) == len(w)
        assert all(any(lost[k : k + 50]) for k, run in enumerate(runs) if run in seen)
        assert any(run in seen for run in short) or not gone[i]
        seen |= {*runs, *short}
    assert {x.doc_id: x.text for x in rows}[3] == ""


def test_a_frequent_line_of_a_large_host_counts(spark):
    own = lambda i: " ".join(f"{a}{b}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "xy")
    line = " ".join(chr(97 + k % 26) * (2 + k // 26) for k in range(60))
    texts = [own(i) + ("\n" + line if i < 31 else "\nrare " + line if i < 61 else "") for i in range(800)]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in op7_quality_rules.quality_rules(rows).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(31)) and got[0].n_removed_words == 60 and got[31].n_removed_words == 0


@pytest.mark.parametrize("sets", [60, 120])
def test_sets_below_the_threshold_make_few_pairs(spark, monkeypatch, sets):
    """Texts that differ from one base in 7 of 300 words: nearly all pairs have a similarity near 0.64, and each shares most words with all others."""
    r = random.Random(4)
    base, rows, tried = [f"w{r.randrange(5000)}" for _ in range(300)], [], []
    for i in range(sets):
        words = list(base)
        for j in r.sample(range(300), 7):
            words[j] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    real = op8_jaccard.verified

    def counting(docs, signed, pairs, *more):
        tried.append(pairs.count())
        return real(docs, signed, pairs, *more)

    monkeypatch.setattr(op8_jaccard, "verified", counting)
    got = {x.doc_id: x.component_id for x in op8_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingled = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    comp = list(range(sets))
    for a in range(sets):
        for b in range(a):
            if 100 * len(shingled[a] & shingled[b]) >= 75 * len(shingled[a] | shingled[b]) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    assert got == dict(enumerate(comp))
    assert tried[-1] <= sets and sum(tried) <= (2 * op8_jaccard.BANDS + 4 * op8_jaccard.LEADERS) * sets  # all pairs: sets * (sets - 1) / 2


def test_frequent_lines_are_removed_from_the_text(spark):
    """A line that 31 documents of a host have goes from the texts that are kept, blank lines and rare ones stay; of another host it stays."""
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    own = lambda i: " ".join(name(i) + name(j) for j in range(60))
    rows = [(i, f"Home | News {i}\n\n{own(i)}\n home |  NEWS 7 \nend {name(i)}", "a") for i in range(31)] + [(90, f"Home | News 1\n{own(90)}", "b"), (91, own(91), "a"), (91, own(92) + "\n", "a"), (92, None, "a"), (93, "Home | News 3\n" * 30 + own(93)[:100], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(map(tuple, op7_quality_rules.cleaned(docs).collect()))
    assert got == sorted([(i, f"\n{own(i)}\nend {name(i)}", "a") for i in range(31)] + rows[31:34])
    lines = {r.doc_id: r.removed_lines for r in op7_quality_rules.judged(docs).collect()}
    assert lines[0] == [0, 3] and lines[90] == lines[92] == [] and lines[93] == list(range(30))


def test_cuts_are_made_of_little_text_at_a_time():
    texts = [" ".join(f"Ab{i}c{j}" for j in range(500)) + ". İst" for i in range(300)]
    got = list(op3_substring.cuts_of(pa.array([None, *texts, ""])))
    assert len(got) > 4 and sum(len(c.counts) for _, c in got) == 302
    assert [row for row, _ in got] == [0, *accumulate(len(c.counts) for _, c in got[:-1])]
    assert max(len(c.hashes) for _, c in got) * 7 <= op3_substring.BYTES


def test_classes_with_many_links_between_them_make_few_pairs(spark, monkeypatch):
    """Texts of 60 words that differ from one base in one to three words: most are linked with some others, in many classes at first."""
    r, tried = random.Random(1), []
    vocabulary = [f"w{i}" for i in range(3000)]
    base, rows = [r.choice(vocabulary) for _ in range(60)], []
    for i in range(400):
        words = list(base)
        for _ in range(r.randint(1, 3)):
            words[r.randrange(60)] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    real = op8_jaccard.verified

    def counting(docs, signed, pairs, *more):
        tried.append(pairs.count())
        return real(docs, signed, pairs, *more)

    monkeypatch.setattr(op8_jaccard, "verified", counting)
    got = {x.doc_id: x.component_id for x in op8_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingled = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(shingled[a] & shingled[b]) >= 75 * len(shingled[a] | shingled[b]) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    assert got == dict(enumerate(comp)) and len(set(comp)) > 1
    assert tried[-1] <= len(rows) // 10, tried


@pytest.mark.parametrize("bound, parts", [(200_000, 3), (5, 1), (5, 7)])
def test_sharding_is_the_same_in_any_ranges(spark, monkeypatch, bound, parts):
    """Shards and slots as the SQL has them, however few rows are numbered at a time and however the table is partitioned."""
    import duckdb

    monkeypatch.setattr(op1_sharding, "ROWS_A_RANGE", bound)
    r = random.Random(6)
    rows = [(i, r.choice([None, "", "aa", "bb", "text " * r.randrange(1, 9), f"own {i}"])) for i in range(120)] + [(None, "aa"), (None, "zz")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({op1_sharding.SQL})").fetchall()
    got = op1_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_leaks_go_by_row(spark):
    leak = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "clean text under the number of a leak"), (1, f"before {leak} after"), (None, leak), (None, "clean without a number"), (2, None)]
    kept = op4_decontamination.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, leak)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_index_of_items_has_a_row_for_each_shingle(spark, monkeypatch):
    """Long and short documents find the items that are in them, with an index that isn't repeated for each size of document."""
    r = random.Random(8)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(words(15 + 4 * i))) for i in range(12)]
    docs = [(i, " ".join([*words(n), *t.split(), *words(n)])) for i, (_, t) in enumerate(items) for n in [[0, 5, 200, 4000][i % 4]]] + [(50 + i, " ".join(words(300))) for i in range(5)]
    seen = []
    real = op4_decontamination.met
    monkeypatch.setattr(op4_decontamination, "met", lambda rows, index, on, *more: seen.append((on, index.count())) or real(rows, index, on, *more))
    got = op4_decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got if x.containment == 1} == {(i, i) for i in range(12)} and len(got) == 12
    assert seen[0][0] == ["h"] and seen[0][1] <= sum(len(t.split()) - 4 for _, t in items)


@pytest.mark.parametrize("n", [6, 7, 8, 9, 12])
def test_three_repeated_lines_without_end_marks_go(spark, n):
    """Of every text the three lines that an earlier one has, at any length of line and whatever stands around them."""
    r = random.Random(n)
    line = lambda: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    texts, places = [], []
    for _ in range(40):
        three = [line() for _ in range(3)]
        for _ in range(2):
            before, after = ([line() for _ in range(r.randrange(4))] for _ in range(2))
            places.append((len(before), three))
            texts.append("\n".join([*before, *three, *after]))
    rows = {x.doc_id: x.text for x in op3_substring.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (at, three) in enumerate(places):
        assert rows[i] == texts[i] if i % 2 == 0 else not any(x in rows[i] for x in three)
        if i % 2:
            assert [x for x in rows[i].split("\n") if x] == [x for x in texts[i].split("\n") if x not in three]


def test_every_run_of_three_sentences_against_brute_force(spark):
    """Sentences that a repeated run covers: all of them go, in any text but the first that has the run."""
    r = random.Random(21)
    pool = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 15))) + r.choice(".!?") for _ in range(25)]
    texts = [" ".join(r.choices(pool, k=r.randrange(1, 12))) for _ in range(60)]
    first, gone = {}, {}
    for i, text in enumerate(texts):
        s = [x for x in re.split(r"(?<=[.!?]) ", text)]
        for k in range(len(s) - 2):
            run = tuple(s[k : k + 3])
            if run in first:
                gone.setdefault(i, set()).update(range(k, k + 3))
            first.setdefault(run, (i, k))
    rows = {x.doc_id: x.text for x in op3_substring.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert gone
    for i, text in enumerate(texts):
        s = re.split(r"(?<=[.!?]) ", text)
        left = [x for k, x in enumerate(s) if k not in gone.get(i, ())]
        kept = rows[i].split(" ")
        assert len(kept) <= len(" ".join(left).split(" ")) and all(x in " ".join(left) for x in rows[i].split())


def test_index_lists_are_dealt_without_bitmaps(spark, monkeypatch):
    """Lists of more than ``FEW_SETS`` sets go by token without the sets' bitmaps, and what was written on the way is deleted."""
    r, dealt = random.Random(3), []
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(f"x{r.randrange(10**9)}" if j in gone else w for j, w in enumerate(base))) for i in range(60) for gone in [set(r.sample(range(300), 7))]]
    real = op8_jaccard.spread

    def seen(rows, index, on):
        dealt.append((list(rows.columns), on))
        return real(rows, index, on)

    monkeypatch.setattr(op8_jaccard, "spread", seen)
    since = tables.mark()
    out = op8_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert any(on == ["token"] for _, on in dealt) and not any("wide" in columns for columns, _ in dealt)
    assert len(tables._written) <= since + 4 and out.count() == 60


def test_the_driver_gets_the_toxicity_model_alone(spark, monkeypatch):
    """A task learns; its model is what the sample gives on the driver, and without rows there is one too."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts, y, odds = labelled.sample(docs, labels, "toxic", op9_toxicity.EACH, op9_toxicity.CHARS)
    want = op9_toxicity.train(texts, y, odds)
    empty = op9_toxicity.fit(docs.limit(0), labels.limit(0))
    assert not empty[0].any() and empty[2].tolist() == [0.0] * 5

    driver, real = os.getpid(), op9_toxicity.train

    def elsewhere(*args):
        if os.getpid() == driver:
            raise AssertionError("the driver learns")
        return real(*args)

    monkeypatch.setattr(op9_toxicity, "train", elsewhere)
    got = op9_toxicity.fit(docs, labels)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_join_takes_bounded_bytes_and_starts_no_other_workers(spark, monkeypatch):
    """Python tasks of the join get ``BATCH`` bytes at a time, hot keys need no Python task, and the setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was, sets = spark.conf.get(key), op8_jaccard.shingle_sets

    def bounded(column, k=5, most=2 * tables.BATCH):
        if column.nbytes > most:
            raise ValueError(f"{column.nbytes} bytes at once")
        return sets(column, k)

    monkeypatch.setattr(op8_jaccard, "shingle_sets", bounded)
    docs = spark.range(3000).repartition(1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 400), x -> concat('w', id div 2, '-', x))) as text")
    got = op8_jaccard.jaccard_components(docs)
    assert spark.conf.get(key) == was
    assert got.where("component_id != doc_id - doc_id % 2 or n_shingles != 396").count() == 0 and got.count() == 3000

    monkeypatch.setattr(tables, "SMALL", 10)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows of Python"))
    rows = tables.cut(spark.range(5000).selectExpr("if(id % 2 = 0, -1, id) as k", "id as v"))
    index = tables.cut(rows.select("k").distinct().selectExpr("k", "k + 1 as w"))
    assert tables.spread(rows, index, ["k"]).where("w = k + 1").count() == 5000
