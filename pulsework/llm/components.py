"""Connected components by alternating large-star and small-star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, forget, mark, spread


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): each node of the edges with the smallest node that it is connected with.

    Repeated edges, self-loops and both directions are allowed; edges with a null end are left out. No edges give
    an empty table. Each round rewrites the edges in two joins on nodes; the edges of a hub, a node with a large part of
    all edges, stay where they are in these. The rounds grow with the logarithm of the longest chain.
    """
    since = mark()
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    while True:
        both = e.union(e.select("v", "u"))
        large = cut(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
        e = cut(small.select("s.u", "s.v").where("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(e.sparkSession, since, keep=e)
        if now == was or not now[0]:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): the pairs with the least of u and all its v."""
    return spread(pairs, pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), ["u"])
