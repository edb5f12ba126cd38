"""Conversation prefix trie with count-min screening.

Each distinct sequence of first turns (role, text) is a node. Two rows of counters over the digests of all prefixes tell which of
them may be shared: a count of one in either row proves that a prefix is in one conversation only. Such nodes, the
tails, are emitted where they stand; only prefixes that may be shared are shuffled and grouped exactly.

* Turns are put in order in slices of equal size, whatever conversation they belong to, so a long one is in many tasks.
* The digest of a prefix is the exclusive or of the hashes of its turns with their places (128 bits): it can be carried from slice
  to slice, and a node's digest gives its parent's without a look at the row before.
* Sums over subtrees are sums over members: a node's leaves are the members that stand for a childless node. A member is not the
  smallest in each of its nodes down to some depth, and saves the words from the node to there.
* The members that end in a node are hashed as a stream, in order of their conv_id; no list of them is held.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut, read, spread

#: Turns in a slice.
ROWS_A_SLICE = 1_000_000
#: The most counters in a row; a fixed bound, so on very large inputs more tails are shuffled.
COUNTERS = 1 << 26
_SPACE = r"[^\x20\x09-\x0D]+"
_MEMBER = ["conv_id", "depth", "a", "b", "pa", "pb", "before", "is_end"]


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, slice, pos, key, words: the turns (conv_id, turn, role, text) with their place in the conversation, from 1.

    A null turn comes first, equal ones are in order of a hash of role and text; null roles and texts are empty. Rows with a
    null conv_id belong to no conversation and are left out. Other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(_SPACE)).cast("long").alias("words"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    order = ["turn", "key", "row"]
    slices = rows.count() // ROWS_A_SLICE + 1
    rows = cut(rows.repartitionByRange(slices, "conv_id", *order).withColumn("slice", F.spark_partition_id()))
    n = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    # only the first conversation of a slice can have begun in an earlier one, so this has no more rows than there are slices
    before = n.withColumn("start", F.sum("n").over(_earlier("conv_id", "slice"))).where("start is not null").drop("n")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order)))
    rows = rows.join(F.broadcast(before), ["conv_id", "slice"], "left")
    return cut(rows.select("conv_id", "slice", (F.col("pos") + F.coalesce("start", F.lit(0))).alias("pos"), "key", "words"))


def _earlier(by: str, order: str):
    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows of ``placed`` and (conv_id, n, slice, slices), with the first turns of each conversation c taken from c - c % ``family``.

    h = crc32(c as text) % ``heads`` turns are taken (all if there are fewer), and c's own first h turns left out. With
    ``heads`` = 1 nothing changes. n: turns; slice: the first of the ``slices`` that the conversation was in.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"), F.min("slice").alias("slice"), F.count_distinct("slice").alias("slices"))
    convs = convs.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % family == 0)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("first"))  # heads - 1 at most
    first = first.withColumnRenamed("conv_id", "base")
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    convs = convs.withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<pos:long,key:binary,words:long>>")), F.lit(1), F.col("h")))
    convs = cut(convs.select("conv_id", "slice", "slices", "h", "first", (F.size("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    own = spread(turns, convs.select("conv_id", "h", "n", (F.size("first") - F.col("h")).alias("shift")), ["conv_id"]).where("pos > h")
    own = own.select("conv_id", "slice", (F.col("pos") + F.col("shift")).alias("pos"), "key", "words", "n")
    taken = convs.select("conv_id", "slice", "n", F.explode("first").alias("t")).select("conv_id", "slice", "t.pos", "t.key", "t.words", "n")
    return cut(own.unionByName(taken)), convs.select("conv_id", "n", "slice", "slices")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each prefix of each conversation but the empty one: depth, its digest (a, b), its parent's (pa, pb), the words of its last text and of those before, and whether the conversation ends with it."""
    rows = turns.withColumns({"x": F.xxhash64(F.lit(1), "pos", "key"), "y": F.xxhash64(F.lit(2), "pos", "key")})
    so_far = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    long = convs.where("slices > 1").select("conv_id")  # at most as many as there are slices
    sums = rows.join(F.broadcast(long), "conv_id", "left_semi").groupBy("conv_id", "slice").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("words").alias("w"))
    w = _earlier("conv_id", "slice")
    carried = sums.select("conv_id", "slice", F.bit_xor("x").over(w).alias("cx"), F.bit_xor("y").over(w).alias("cy"), F.sum("w").over(w).alias("cw")).where("cx is not null")
    rows = rows.withColumns({"a": F.bit_xor("x").over(so_far), "b": F.bit_xor("y").over(so_far), "before": F.sum("words").over(so_far) - F.col("words")})
    rows = rows.join(F.broadcast(carried), ["conv_id", "slice"], "left")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"a": F.col("a").bitwiseXOR(F.coalesce("cx", none)), "b": F.col("b").bitwiseXOR(F.coalesce("cy", none)), "before": F.col("before") + F.coalesce("cw", none)})
    return rows.select("conv_id", F.col("pos").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words", "before", (F.col("pos") == F.col("n")).alias("is_end"))


def screen(rows: DataFrame, counters: int | None = None):
    """A test of digests (two columns): false proves that only one of the rows has this digest. The counters of both rows, of which
    those above one go to the tasks, as bits."""
    size = min(counters or COUNTERS, 1 << max(10, (8 * rows.count()).bit_length()))
    cell = lambda lane, x: F.struct(F.lit(lane).alias("lane"), F.col(x).bitwiseAND(F.lit(size - 1)).alias("cell"))
    many = rows.select(F.explode(F.array(cell(0, "a"), cell(1, "b"))).alias("c")).groupBy("c.lane", "c.cell").agg(F.count("*").alias("n")).where("n > 1")
    words = many.groupBy("lane", F.shiftright("cell", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros((2, -(-size // 64)), np.int64)
    table[words["lane"].to_numpy(), words["w"].to_numpy()] = words["bits"].to_numpy()

    @F.arrow_udf("boolean")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        yes = np.ones(len(a), bool)
        for lane, x in enumerate((a, b)):
            at = x.to_numpy(zero_copy_only=False) & (size - 1)
            yes &= (table[lane, at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(yes)

    return shared


def end_hashes(ends: DataFrame) -> DataFrame:
    """a, b, sha: of each digest (a, b) the SHA-256 of its conv_ids (decimal, rising, joined by commas). Ids are joined where they stand in a
    range of the whole order, and a digest's pieces are hashed one after another."""

    def joined(batches):
        for batch in batches:
            a, b, conv = (batch.column(i).to_numpy() for i in range(3))
            start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
            text = [",".join(map(str, x.tolist())) for x in np.split(conv, start[1:])] if len(a) else []
            yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(conv[start]), pa.array(text, pa.string())], ["a", "b", "conv_id", "ids"])

    def hashed(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (a, b) == at:
                    state.update(b",")
                else:
                    done += [(*at, state.hexdigest())] if at else []
                    at, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pack(done)
        yield pack([(*at, state.hexdigest())] if at else [])

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "sha"])

    pieces = ends.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(joined, "a long, b long, conv_id long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id").mapInArrow(hashed, "a long, b long, sha string")


def trie(rows: DataFrame, convs: DataFrame, counters: int | None = None) -> DataFrame:
    """The nodes of ``rows`` (of ``prefixes``) and the root, with the columns of the query. ``convs``: conv_id, n."""
    rows = cut(rows)
    shared = screen(rows, counters)
    rows = cut(rows.withColumns({"shared": shared("a", "b"), "pshared": (F.col("depth") == 1) | shared("pa", "pb")}))
    none = F.lit(0).cast("long")
    root = convs.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("pa"), none.alias("pb"), none.alias("before"), (F.col("n") == 0).alias("is_end"), F.lit(True).alias("pshared"), none.alias("words"))
    maybe = cut(rows.where("shared").drop("shared").unionByName(root))
    alone = rows.where("not shared")

    nodes = maybe.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("depth", "conv_id", "pa", "pb", "before", "pshared")), F.count("*").alias("n_convs"))
    nodes = cut(nodes)
    kids = nodes.where("depth > 0").select("pa", "pb").unionByName(alone.where("pshared").select("pa", "pb")).groupBy("pa", "pb").agg(F.count("*").alias("n_children")).toDF("a", "b", "n_children")
    nodes = cut(nodes.join(kids, ["a", "b"], "left").fillna(0, ["n_children"]))

    # For each conversation: the words down to where it is the smallest member, and whether it stands for a leaf.
    facts = nodes.select("conv_id", F.col("before").alias("upto"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    facts = facts.unionByName(alone.where("pshared or is_end").select("conv_id", F.col("before").alias("upto"), F.col("is_end").cast("long").alias("leaf")))
    facts = facts.unionByName(maybe.where("is_end").select("conv_id", (F.col("before") + F.col("words")).alias("upto"), none.alias("leaf")))
    facts = facts.groupBy("conv_id").agg(F.min("upto").alias("upto"), F.max("leaf").alias("leaf"))
    sums = spread(maybe, facts, ["conv_id"]).groupBy("a", "b").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("upto") - F.col("before"), none)).alias("saved_tokens"))

    nodes = nodes.join(sums, ["a", "b"]).join(end_hashes(maybe.where("is_end")), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = cut(nodes.select("pa", "pb", "pshared", *columns))
    own = F.when(F.col("is_end"), F.col("conv_id").cast("string")).otherwise("").cast("binary")
    tails = alone.select("pa", "pb", "pshared", "conv_id", "depth", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("is_end"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), none.alias("saved_tokens"), F.sha2(own, 256).alias("ends_sha256"))

    below = cut(nodes.where("pshared and depth > 0").unionByName(tails.where("pshared")))
    names = maybe.groupBy("a", "b").agg(F.min("conv_id").alias("parent_conv_id")).toDF("pa", "pb", "parent_conv_id")
    out = spread(below, names, ["pa", "pb"])
    for more, parent in ((nodes.where("depth = 0"), F.lit(None).cast("long")), (nodes.where("not pshared").unionByName(tails.where("not pshared")), F.col("conv_id"))):
        out = out.unionByName(more.withColumn("parent_conv_id", parent))
    return out.select("conv_id", "depth", "parent_conv_id", *columns[2:])


def conversation_trie(conversations: DataFrame, family: int = 20, heads: int = 4, counters: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text), rebuilt as ``rebuilt`` says; ``heads`` = 1 takes them as they are.

    One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. Repeated turns are turns of their own. An empty table has no nodes, not even the root.
    """
    turns, convs = rebuilt(placed(conversations), family, heads)
    return trie(prefixes(turns, convs), convs, counters)


def query(spark, sf_dir):
    return conversation_trie(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE crc_step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
rows_ AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS key
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(key)) AS pos, key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rows_),
lists AS (SELECT conv_id, list({'key': key, 'words': words} ORDER BY pos) AS turns FROM own GROUP BY conv_id),
bytes_ AS (SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM lists),
heads AS (
  SELECT conv_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) % 4 AS h
  FROM bytes_, crc),
made AS (
  SELECT l.conv_id, list_concat(coalesce(b.turns, [])[1:h], l.turns[h + 1:]) AS turns
  FROM lists l JOIN heads USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 20),
each AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS d, turns FROM made),
nodes AS (
  SELECT list_transform(turns[1:d], lambda x: x.key) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN turns[d].words ELSE 0 END) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256
  FROM each GROUP BY ALL),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (p)),
above AS (SELECT p[1:e] AS p, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM whole)),
sums AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY p)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums ON sums.p = w.p LEFT JOIN nodes u ON w.d > 0 AND u.p = w.p[1:w.d - 1]"""
