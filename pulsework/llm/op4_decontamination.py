"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

Documents are partitioned by the size of their shingle set. A document of partition p has 2**p bins, at least twice as
many bins as shingles, and its MinHash signature is the smallest hash of each bin that isn't empty (one permutation,
as many minima as the size calls for); so a short item's minima survive in a long document's signature whatever the
ratio of the sizes. Of the items' signatures in every partition whose documents are large enough to hold them, each shingle is
kept once, with the first partition where it is a minimum. An equal minimum makes a candidate, and exact shingle containment decides.

A shingle of the item that the document has is the minimum of its bin with a probability of about 0.8, so an item of s
shared shingles is missed with a probability of about 0.2**s. Items with fewer than ``FEW`` shingles are therefore looked for by
all their shingles in all of the document's, and items of fewer words than a shingle has by the document's runs of as many
words: for both the search is exact. Of the others, at least 6 shingles are shared, and about 1 in 15,000 is missed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, fresh, met, read

#: The most rows of signatures or shingles of items that are broadcast (about 30 bytes each), and of whole items.
BROADCAST_ROWS, BROADCAST_ITEMS = 500_000, 2_000
PARTITIONS, FEW = 40, 8


def words_of(df: DataFrame, key: str) -> DataFrame:
    """(key, w): runs of letters and digits of the lower-cased text. A null text has none."""
    return df.select(key, F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "").alias("w"))


def _runs(k: int):
    """Hashes of the runs of k words; none where there are fewer words."""
    made = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(k))))
    return F.when(F.size("w") >= k, made).otherwise(F.array().cast("array<long>"))


def shingled(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, s): distinct hashes of runs of k words, sorted; fewer than k words make none."""
    return words_of(df, key).select(key, F.sort_array(F.array_distinct(_runs(k))).alias("s"))


def _minima(df: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep, p, h) of the signatures of the sets ``s`` with 2**p bins."""
    minima = F.expr("filter(s, (x, i) -> i = 0 or shiftrightunsigned(x, 64 - p) <> shiftrightunsigned(s[i - 1], 64 - p))")
    return df.select(*keep, "p", F.explode_outer(minima).alias("h")).where("h is not null")  # the filter stays above: below, it would make the shingles anew


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment): items of which a document has at least ``percent`` % of the shingles.

    An item of fewer than ``k`` words has one shingle, all its words, and is found where they follow each other. ``docs`` has
    doc_id and text, ``benchmark`` item_id and text; other columns are not looked at. Null and empty texts, and rows with a
    null id, match nothing. Rows that repeat an id count as one each if their texts are equal; of different texts under one
    id the one that shares most decides. Empty tables give an empty result.
    """
    docs = docs.where("doc_id is not null and text is not null")
    items = words_of(benchmark.where("item_id is not null"), "item_id").where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(k))
    of_size = F
    for m in range(1, k + 1):
        of_size = of_size.when(size == m, _runs(m))
    items = cut(items.select("item_id", size.alias("m"), F.sort_array(F.array_distinct(of_size)).alias("s")).distinct())

    many = items.where((F.col("m") == k) & (F.size("s") >= FEW))
    part = F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(F.size("s"), F.lit(1)))).cast("int") + 1)
    least = F.greatest(F.lit(2), F.ceil(F.log2(F.size("s") * percent / 100)).cast("int") + 1)
    # The smallest of a bin stays the smallest when bins are split: a shingle has one row, with the first partition where it is a minimum.
    apart = F.expr("transform(s, (x, i) -> struct(x as h, case when i = 0 then 0 else 65 - length(bin(x ^ s[i - 1])) end as first))")
    wanted = many.select("item_id", least.alias("least"), F.explode(apart).alias("x")).select("item_id", "x.h", F.greatest("least", "x.first").alias("first"))
    wanted = cut(wanted.where(F.col("first") <= PARTITIONS))
    sets = shingled(docs, "doc_id", k).withColumn("p", part)
    found = met(_minima(sets, "doc_id"), wanted, ["h"], "doc_id", broadcast_rows).where("p >= first").select("doc_id", "item_id")

    few = cut(items.where((F.col("m") < k) | (F.size("s") < FEW)).select("item_id", "m", F.explode("s").alias("h")))
    exact = None
    for m in sorted(r.m for r in few.select("m").distinct().collect()):  # k values at most
        runs = words_of(docs, "doc_id").select("doc_id", F.explode(F.array_distinct(_runs(m))).alias("h"))
        hits = met(runs, few.where(F.col("m") == m).select("item_id", "h"), ["h"], "doc_id", broadcast_rows).select("doc_id", "item_id")
        if m == k:
            found = found.union(hits)
        else:
            exact = hits if exact is None else exact.union(hits)
    found = cut(found.distinct())
    ids = cut(found.select("doc_id").distinct())  # its size is known now, and Spark takes the join for that
    held = shingled(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "doc_id", k)
    whole = cut(items.where(F.col("m") == k).select("item_id", F.col("s").alias("t")))
    pairs = met(held.join(found, "doc_id"), whole, ["item_id"], "doc_id", BROADCAST_ITEMS)
    pairs = pairs.select("doc_id", "item_id", F.size("t").alias("n_item"), F.size(F.array_intersect("s", "t")).alias("n_common"))
    pairs = pairs.where(100 * F.col("n_common") >= percent * F.col("n_item"))
    if exact is not None:
        pairs = pairs.union(exact.distinct().select("doc_id", "item_id", F.lit(1), F.lit(1)))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_common") / F.col("n_item"), "n_item", "n_common")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_item").alias("n_item"), F.col("b.n_common").alias("n_common"), (F.col("b.n_common") / F.col("b.n_item")).alias("containment"))


def query(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, whatever their doc_id: it is the text that is looked up, by a digest, so a null
    doc_id is as good as any, and other texts under the doc_id of a leak stay. Null texts stay."""
    digest = fresh(docs, "_digest")
    named = docs.withColumn(digest, F.md5(F.col("text").cast("binary")))
    leaks = cut(contaminated(named.select(F.col(digest).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(digest)).distinct())
    return named.join(leaks, digest, "left_anti").select(docs.columns)


_WORDS = r"""{name}_w AS (SELECT DISTINCT {key}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {name} WHERE text IS NOT NULL AND {key} IS NOT NULL)"""
SQL = (
    "WITH "
    + ",\n".join(_WORDS.format(name=n, key=k) for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    + """,
benchmark_m AS (SELECT item_id, w, least(len(w), 5) AS m FROM benchmark_w WHERE len(w) > 0),
benchmark_s AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM benchmark_m)),
documents_s AS (SELECT DISTINCT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM documents_w, (SELECT DISTINCT m FROM benchmark_m) WHERE len(w) >= m)),
size_of AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM benchmark_s GROUP BY item_id),
common AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_common FROM documents_s JOIN benchmark_s USING (m, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment FROM common JOIN size_of USING (item_id) WHERE 100 * n_common >= 75 * n_item"""
)
