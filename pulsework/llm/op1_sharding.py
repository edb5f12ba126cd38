"""Sharding by longest-processing-time scheduling.

Rows that must stay together form a group. Groups go, largest first, to the shard with the least load, which a heap gives;
of several such shards, to the lowest. Groups of one size are all the same to the heap, so what travels to the driver is the
number of groups of each size, and a run of many equal ones is dealt in one step with the result that the heap would give.
Sizes that differ add up to all bytes at least, so there are at most sqrt(2 * bytes) of them (14 million for 100 TB).
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut, read

#: Rows (or groups) that one task numbers, about.
ROWS_A_RANGE = 200_000
#: Groups with more than one in so many of all rows are few enough to be broadcast, and so need no shuffle by their key.
HOT = 4096


def deal(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """How many of the ``counts[i]`` groups of ``sizes[i]`` bytes each shard gets, with the sizes in falling order and none below 1."""
    loads, out = [0] * shards, np.zeros((len(sizes), shards), np.int64)
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if n <= 4 * shards:
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(n):
                load, s = heap[0]
                out[i, s] += 1
                loads[s] = load + size
                heapq.heapreplace(heap, (load + size, s))
            continue
        # The heap takes the n smallest of (load + j * size, shard): those up to a level, and of the next value the lowest shards.
        taken = lambda level: [max(0, (level - load) // size + 1) for load in loads]  # noqa: B023, E731
        low, high = min(loads) - 1, max(loads) + n * size
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(taken(middle)) <= n else (low, middle)
        got = taken(low)
        for s, load in enumerate(loads):
            if sum(got) < n and low + 1 >= load and (low + 1 - load) % size == 0:
                got[s] += 1
        out[i], loads = got, [load + g * size for load, g in zip(loads, got, strict=True)]
    return out


def shard(docs: DataFrame, shards: int = 8, group=None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) with size, text_crc32, law, shard, slot, grown_shard; columns of these names are replaced.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has no bytes, as an empty one. ``group`` is a column that
    names the groups, by default a digest of the text: equal texts stay together, null and empty ones too, and repeated
    rows are rows of their own. A null group is a group. ``slot`` numbers the rows of a shard from 0 without gaps, by doc_id
    (a null one first) and group; rows that are equal in both have any order. Law ``bytes`` holds: loads are near equal. An empty table gives an empty result.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    text = F.coalesce("text", F.lit(""))
    key = F.sha2(text, 256) if group is None else F.coalesce(group.cast("string"), F.lit("\0"))
    rows = docs.select(F.struct(*own).alias("_own"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    groups = cut(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")))
    n, many = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count("*")).first()

    # How many groups of each size go to each shard: the last number (from 0) of each shard in the run of equal groups.
    runs = groups.groupBy("_bytes").agg(F.count("*").alias("n")).orderBy(F.desc("_bytes")).toArrow()
    sizes = runs["_bytes"].to_numpy()
    ends = deal(sizes, runs["n"].to_numpy(), shards).cumsum(1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * shards), pa.array(ends.ravel()))
    ends = cut(docs.sparkSession.createDataFrame(pa.table({"_bytes": pa.array(sizes, pa.int64()), "_ends": lists})))
    placed = _numbered(groups, "_bytes", "_key", many).join(ends, "_bytes").select("_key", "_rows", F.expr("size(filter(_ends, e -> e <= _place))").alias("_shard"))
    placed = cut(placed)

    # A hot group needs no shuffle: its rows leave the join by key, where each gets a key of its own.
    hot = placed.where(F.col("_rows") * HOT > n).select("_key", F.col("_shard").alias("_hot"))
    rows = rows.join(F.broadcast(hot), "_key", "left").withColumn("_at", F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(F.concat(F.lit("\1"), F.monotonically_increasing_id())))
    rows = rows.join(placed.select(F.col("_key").alias("_at"), "_shard"), "_at", "left").withColumn("shard", F.coalesce("_hot", "_shard"))
    order = [F.col("_own.doc_id")] if "doc_id" in own else []
    out = _numbered(rows.drop("_at", "_hot", "_shard"), "shard", "_key", n, *order, few=True)
    return out.select("_own.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, part: str, key: str, n: int, *order, few: bool = False) -> DataFrame:
    """``rows`` with _place, numbered from 0 in each value of ``part`` in the order of ``order`` and ``key``.

    The whole order is cut into ranges of about ``ROWS_A_RANGE`` rows, which are sorted apart, and the counts of the ranges are carried over: so the
    numbers don't depend on the ranges, and rows that tie in all of the order may be in several of them. ``few``: ``part`` has few values.
    """
    line = [*order, F.col(key)]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n // ROWS_A_RANGE + 1, F.col(part), *line, F.col("_row"))
    # in a sorted range the id is the number of the range, and in the low 33 bits the place in it
    rows = cut(ranged.sortWithinPartitions(F.col(part), *line, F.col("_row")).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    before = rows.groupBy(part, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(part, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    # a value of part is in neighbouring ranges, so there are no more rows than values and ranges
    before = F.broadcast(before) if few else before
    return rows.join(before, [part, "_range"]).withColumn("_place", F.col("_at") + F.col("_start")).drop("_range", "_start", "_at")


def query(spark, sf_dir):
    out = shard(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same schedule, a group at a time; CRC-32 by its table, which a rule makes.
SQL = r"""
WITH RECURSIVE crc_step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
rows_ AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, sha256(coalesce(text, '')) AS key,
    row_number() OVER () AS r FROM documents),
hexed AS (SELECT key, any_value(hex(encode(text))) AS h FROM rows_ GROUP BY key),
bytes_ AS (
  SELECT key, list_transform(range(1, len(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM hexed),
sums AS (
  SELECT key, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM bytes_, crc),
groups_ AS (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM rows_ GROUP BY key),
line AS (SELECT key, bytes, row_number() OVER (ORDER BY bytes DESC, key) AS i, row_number() OVER (PARTITION BY bytes ORDER BY key) AS j FROM groups_),
heap(i, s, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(range(8), lambda x: CAST(0 AS BIGINT))
  UNION ALL
  SELECT l.i, CAST(list_position(h.loads, list_min(h.loads)) AS BIGINT),
    list_transform(h.loads, lambda x, k: CASE WHEN k = list_position(h.loads, list_min(h.loads)) THEN x + l.bytes ELSE x END)
  FROM heap h JOIN line l ON l.i = h.i + 1),
turns AS (SELECT bytes, s - 1 AS shard, row_number() OVER (PARTITION BY bytes ORDER BY s) AS j FROM heap JOIN line USING (i)),
dealt AS (SELECT key, shard FROM line JOIN turns USING (bytes, j))
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows_ JOIN dealt USING (key) JOIN sums USING (key)"""
