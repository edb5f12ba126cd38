"""Language models against plain Kneser-Ney over dictionaries, odd texts, and accuracy on rows that weren't learnt from."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulsework.llm import op11_language as language

SYLLABLES = {"aa": "ba ka lo mi tu še".split(), "bb": "str ing the ous tion".split(), "cc": "при вет мир да не".split()}
SCHEMA = "doc_id long, text string, lang string, score string, entropy int"


def normal(text):
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    words = "".join(low(c) if unicodedata.category(c)[0] in "LM" else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    return "   " + " ".join(words) + " " if words else ""


def plain_model(texts):
    """Probability of the last of four characters, by the textbook."""
    counts = {4: Counter(s[i - 3 : i + 1] for s in map(normal, texts) for i in range(3, len(s)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, after = {}, {}
    for k, c in counts.items():
        n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
        discount[k] = max(0.1, min(0.9, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        after[k] = {}
        for g, v in c.items():
            total, types = after[k].get(g[:-1], (0, 0))
            after[k][g[:-1]] = (total + v, types + 1)
    return counts, discount, after


def plain_probability(model, gram, characters):
    counts, discount, after = model
    k = len(gram)
    lower = plain_probability(model, gram[1:], characters) if k > 1 else 1 / (characters + 1)
    total, types = after[k].get(gram[:-1], (0, 0))
    if not total:
        return lower
    return max(counts[k][gram] - discount[k], 0) / total + discount[k] * types / total * lower


def rows(n=150):
    r = random.Random(9)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(r.choice([3, 10, 60]))]
        out.append((i, r.choice([" ", ", ", "\n 7 "]).join(words).capitalize(), lang, "x", 1))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    return language.fit(spark.createDataFrame(rows(), SCHEMA).repartition(3))


def test_against_plain_models(fitted):
    learnt = [x for x in rows() if zlib.crc32(str(x[0]).encode()) % 5]
    plain = {lang: plain_model([x[1] for x in learnt if x[2] == lang]) for lang in SYLLABLES}
    characters = len({g for m in plain.values() for g in m[0][1]})
    texts = [x[1] for x in rows()[:20]] + ["Straße zz qqq", "ÉTÉ ́ mixed привет the", "x"]
    got, n, has = fitted[0].entropies(pa.array(texts))
    assert fitted[0].langs == sorted(SYLLABLES) and has.all()
    for text, row, size in zip(texts, got, n, strict=True):
        s = normal(text)
        assert size == len(s) - 3
        for lang, x in zip(fitted[0].langs, row, strict=True):
            want = -sum(math.log(plain_probability(plain[lang], s[i - 3 : i + 1], characters)) for i in range(3, len(s))) / (len(s) - 3)
            assert abs(x - want) < 1e-4 * want


def test_probabilities_sum_to_one(fitted):
    model = fitted[0]
    letters = language._codes(sorted({c for x in rows() for c in normal(x[1])}))
    for context in ("   ", "bak", "zzz", "the"):
        grams = np.concatenate([np.repeat(language._codes([context]), len(letters), 0), letters], 1)
        total = model.probability(grams, 4).sum(0)
        assert (total < 1 + 1e-4).all() and (total > 0.5).all()  # the rest is for characters never seen


def test_odd_texts_and_columns(spark, fitted):
    r = random.Random(1)
    odd = [(1, None, None, "s", 1), (2, "", "aa", "s", 1), (3, "12 -- ?\n", None, "s", 1), (None, "bakalo mitu", None, "s", 1), (4, "bakalo mitu", "cc", "s", 1), (4, "bakalo mitu", "cc", "s", 1), (5, "thetion " * 40_000, None, "s", 1), (6, "".join(r.choices("qxzjw", k=400)), None, "s", 1)]
    got = {(x.doc_id, x.text): x for x in language.identified(spark.createDataFrame(odd, SCHEMA), fitted).collect()}
    assert [got[k].lang_pred for k in ((1, None), (2, ""), (3, "12 -- ?\n"))] == ["und"] * 3 and got[1, None].score == 0
    assert got[None, "bakalo mitu"].lang_pred == got[4, "bakalo mitu"].lang_pred == "aa" and got[5, "thetion " * 40_000].lang_pred == "bb"
    assert got[6, odd[-1][1]].rejected and not got[5, "thetion " * 40_000].rejected


def test_held_out_rows(spark, fitted):
    found = language.identified(spark.createDataFrame(rows(), SCHEMA), fitted).where(language.held_out()).collect()
    assert len(found) > 10 and all(x.lang == x.lang_pred and 0.5 < x.score <= 1 for x in found)


def test_limits_are_of_all_texts_and_whole(spark):
    """1,200 short texts and two long ones of each language of the calibration's fold; the mean of a language is that of all its right texts."""
    fold = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    other = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 5 == 2]
    few = {a: SYLLABLES[a] for a in ("aa", "cc")}
    r, docs = random.Random(3), []
    for ids, sizes in ((other[:60], [40]), (fold[:2400], [8]), (fold[2400:2404], [4000])):
        docs += [(i, " ".join("".join(r.choices(few[lang], k=2)) for _ in range(sizes[0])), lang, "x", 1) for j, i in enumerate(ids) for lang in [list(few)[j % 2]]]
    docs = [d for d in docs if d[2]]
    model, curve, limits = language.fit(spark.createDataFrame(docs, SCHEMA).repartition(3))
    counts = language.counted(spark.createDataFrame(docs, SCHEMA))
    trial = language.Model(counts.where("most > 0").selectExpr("lang", "gram", "most AS n"))
    own = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 1]
    entropy, n, _ = trial.entropies(pa.array([d[1] for d in own]))
    assert len(own) == 2404 and n.max() > 4000
    for lang in few:
        k = trial.langs.index(lang)
        of = np.array([d[2] == lang for d in own]) & (entropy.argmin(1) == k)
        mean = entropy[of, k].mean()
        z = np.sort((entropy[of, k] - mean) * np.sqrt(n[of]))
        want = z[math.ceil(0.999 * len(z)) - 1]
        assert abs(limits[lang][0] - mean) < 1e-9 * mean and want <= limits[lang][1] + 1e-9 and limits[lang][1] <= want + 0.002 * (1 + abs(want))


def test_lookups_a_few_at_a_time(fitted, monkeypatch):
    texts = pa.array([x[1] for x in rows()[:30]] + [None, "", "y"])
    whole = fitted[0].entropies(texts)[0]
    monkeypatch.setattr(language, "CELLS", 21)
    assert np.allclose(fitted[0].entropies(texts)[0], whole)


def test_counts(spark):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    whole = sorted(map(tuple, language.counted(docs).collect()))
    plain = Counter((x[2], s[i - 3 : i + 1]) for x in rows(60) if zlib.crc32(str(x[0]).encode()) % 5 for s in [normal(x[1])] for i in range(3, len(s)))
    assert [(a, g, n) for a, g, n, _ in whole] == sorted((*k, n) for k, n in plain.items())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame(rows(5), SCHEMA)
    none = language.fit(docs.where("false"))
    assert {x.lang_pred for x in language.identified(docs, none).collect()} == {"und"}
    assert language.identified(docs.where("false"), none).count() == 0
    one = language.fit(docs.withColumn("lang", docs.lang.substr(1, 0)))
    assert {x.lang_pred for x in language.identified(docs, one).collect()} == {""}
