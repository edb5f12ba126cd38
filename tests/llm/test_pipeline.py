"""The pipeline against brute force, with null and repeated doc_ids, and each of its stages."""

import random
import re

import pytest

import corpus_pipeline
from pulsework.llm import tables

D = "/root/testdata/sf0.001"


def _shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_run_keeps_texts_whatever_their_doc_id(spark, tmp_path):
    r = random.Random(4)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    some = docs.where("lang = 'en' and size(split(text, ' ')) between 60 and 400").orderBy("doc_id").limit(40).collect()
    fresh = [" ".join(r.sample(x.text.split(), len(x.text.split()))) for x in some]
    ids = [None] * 12 + [-1] * 6 + [-2] * 2 + [None, None, 900_001, 900_002]
    texts = fresh[:20] + [fresh[3], some[0].text, fresh[5], fresh[13]]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*(more[c].cast(docs.schema[c].dataType) for c in docs.columns))).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    clean = corpus_pipeline.toxicity(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    sets = [_shingles((x.text or "").lower().split()) for x in clean]
    comp = list(range(len(clean)))
    for a in range(len(clean)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    groups = {}
    for c, x in zip(comp, clean, strict=True):
        groups.setdefault(c, []).append((x.doc_id is None, x.doc_id or 0, x.text))
    left = [{y[1:] for y in g if y[:2] == min(g, key=lambda y: y[:2])[:2]} for g in groups.values()]

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = [s for s in (_shingles(words(x.text)) for x in spark.read.parquet(f"{D}/benchmark.parquet").collect()) if s]
    leaked = {x.doc_id for x in clean if x.doc_id is not None and any(100 * len(s & _shingles(words(x.text))) >= 75 * len(s) for s in items)}
    since = tables.mark()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(tables._written) == since + 1  # what the stages wrote on their way is gone
    shard = {}
    assert all(shard.setdefault(x.text or "", x.shard) == x.shard for x in out)
    assert all(sorted(x.slot for x in out if x.shard == s) == list(range(sum(x.shard == s for x in out))) for s in range(8))
    got = {(x.doc_id or 0, x.text) for x in out}
    left = [g for g in left if not any(i in leaked for i, _ in g)]
    assert all(len(g & got) == 1 for g in left) and len(got) == len({x for g in left for x in g & got})
    assert sum(i == 0 and t in fresh for i, t in got) > 1 and sum(i == -1 for i, _ in got) > 1


OWN = "doc_id long, text string, lang string, source string, n_chars long, score double, _copy int, shard string, tokens long, n int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, ties, repeated rows and columns whose names the operators use too, and a folder with labels and a benchmark."""
    r = random.Random(6)
    some = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        w = some(40).split()
        if i % 2:
            for k in r.sample(range(40), 3):
                w[k] = r.choice(["vile", "rotten", "foul"])
        rows.append((i, " ".join(w), r.choice(["en", "de"]), "s"))
        labels.append((i, 1, i % 2))
    item = some(30)
    rows += [(200, None, None, None), (None, None, "en", "s"), (201, "", "en", "s"), (202, rows[0][1], "en", "s"), (202, rows[0][1], "en", "s"), (203, some(20) + " " + item + " " + some(400), "de", "s"), (None, some(50), None, "s")]
    d = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "never there at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.createDataFrame([(*x, -7, 0.25, -7, "own", -7, -7) for x in rows], OWN), d


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_and_do_what_they_say(spark, odd, name, stage):
    docs, d = odd
    out = stage(spark, docs, d)
    rows, had = out.collect(), docs.collect()
    if name == "sharding":
        assert [c for c in out.columns if c in OWN.replace(",", "").split()] and {x.score for x in rows} == {0.25} and len(rows) == len(had)
        assert sorted((x.doc_id or -1, x.text or "") for x in rows) == sorted((x.doc_id or -1, x.text or "") for x in had) and {x.shard for x in rows} <= set(range(8))
        return
    assert out.columns == docs.columns and {(x.score, x["_copy"], x.shard, x.tokens, x.n) for x in rows} == {(0.25, -7, "own", -7, -7)}
    ids = [x.doc_id for x in rows]
    if name == "toxicity":
        assert {200, 201, 202, 203} <= set(ids) and ids.count(None) == 2 and sum(i is not None and i < 160 and i % 2 == 0 for i in ids) > 75 and sum(i is not None and i < 160 and i % 2 for i in ids) < 5
    if name == "jaccard_join":
        assert 202 not in ids and 0 in ids and {200, 201, 203} <= set(ids) and ids.count(None) == 2
    if name == "decontamination":
        assert 203 not in ids and len(rows) == len(had) - 1
    if name == "mixing":
        assert len(rows) >= len(had) and {(x.doc_id, x.text) for x in rows} == {(x.doc_id, x.text) for x in had}
    assert stage(spark, docs.limit(0), d).count() == 0
