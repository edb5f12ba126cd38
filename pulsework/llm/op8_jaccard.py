"""N-gram Jaccard join with set-relation skipping.

Two texts link when their sets of word shingles have a Jaccard similarity of at least ``percent`` %. The join is
exact: a prefix filter finds candidates, and whole sets decide. Two kinds of skipping keep it from quadratic work:

* *Index-level.* The index lists hold (set size, position) with each token. Sizes fall into geometric blocks, and the
  position of a token bounds the sizes that can still reach the overlap, so a probe names only the blocks in that
  range and never meets the others.
* *Answer-level.* A set's answer is its class, all that chains of links reach. Sets that share a band of min-hashes are compared
  with the first and the last of them, its leaders. A set that is verified to link with a leader has the leader's answer, whatever
  is in it, without a comparison of its own; the same is done along the index lists, with one leader of a list at a time.
  In long lists each set that the leaders leave outside the largest class is then compared with its nearest one of another class.
  What these answers don't tell is found afterwards among pairs of different classes, and joins the classes. Equal sets share one answer from the start. Pairs inside a class are not listed.

Tokens are ordered by rising frequency: the ``hot`` most frequent ones, counted over all documents, come last, which
keeps shared passages and boilerplate out of the prefixes. The order decides only the cost.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .tables import cut, forget, fresh, mark, read, small_batches, spread
from .textnp import Words, blocks, mix, shingle_sets, shingles

#: The most tokens whose frequency is known everywhere (8 bytes each), and the least frequency of such a token.
HOT, HOT_LEAST = 100_000, 16
#: Bytes of text whose shingles are counted together.
COUNTED = 1 << 20
#: Turns in which the sets of each index list are compared with leaders, before pairs are made, and leaders of a long list.
TURNS, LEADERS = 1, 4
#: Sets of one token that one task compares.
SETS_A_PART = 20_000
#: Sets of a long list that are compared with each other for the nearest, the largest classes in which it is looked for, and 64-bit words compared at a time.
SETS_NEAR, LARGE, CELLS = 2_000, 3, 1 << 21
#: Pairs of min-hashes by which a set finds its leaders.
BANDS = 6
#: The fewest bits of a parity bitmap; larger sets have as many as the power of two that isn't below their size. Wide ones have four times
#: as many, so that hardly a pair that isn't similar passes.
BITS = 512
#: Sets of a list that are paired without a look at their wide bitmaps, so a set makes no more rows of a list than this.
FEW_SETS = 32
#: Bits of the filter that spares most texts the shuffle; a fixed bound, so on very large inputs it lets more through.
FILTER = 1 << 26


def hot_tokens(docs: DataFrame, hot: int = HOT, k: int = 5) -> np.ndarray:
    """The most frequent shingles in rising order of frequency; at most ``hot``.

    Texts are counted in place, ``COUNTED`` bytes or one longer text at a time, and only what repeats inside such a part is sent on, so a
    shingle that is in more documents than there are parts can't be missed.
    """

    def count(batches):
        for batch in batches:
            parts, size = [], 0
            for _, offsets, data in blocks(batch.column(0)):
                if size + len(data) > COUNTED and parts:
                    yield repeated(parts)
                    parts, size = [], 0
                parts.append(shingles(Words(offsets, data), k)[0])
                size += len(data)
            if parts:
                yield repeated(parts)

    def repeated(parts):
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "token").limit(hot).collect()
    return np.array([r.token for r in reversed(found)], np.int64).view(np.uint64)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n, k1, k2, bands, odd, wide): the set's size, a 128-bit hash of the set, ``BANDS`` hashes of two min-hashes each, and
    bitmaps (``BITS`` bits, or more for large sets) that tell of which residues of the hashes the set has an odd number."""
    seeds = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))

    def sign(batches):
        for batch in batches:
            n, keys, bands, odd, wide = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = np.array([((s ^ x) * np.uint64(0xD6E8FEB86659FD93)).min() for x in seeds]) if len(s) else seeds
                m = 4 * max(BITS, 1 << (len(s) - 1).bit_length())
                bits = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
                wide.append(np.packbits(bits).view(np.int64))
                odd.append(np.packbits(bits.reshape(4, -1).sum(0) & 1).view(np.int64))
                bands.append(mix(low[::2] + mix(low[1::2])))
            two = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2) if keys else np.zeros((0, 2), np.int64)
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            listed = lambda x, sizes: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), listed(flat, [BANDS] * len(n)), listed(whole(odd), map(len, odd)), listed(whole(wide), map(len, wide))], ["doc_id", "n", "k1", "k2", "bands", "odd", "wide"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, bands array<long>, odd array<long>, wide array<long>")


def prefixes(docs: DataFrame, hot: np.ndarray, percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, n, tokens): the first tokens of each set in the global order, as many as the threshold needs."""
    sort = np.argsort(hot, kind="stable")
    names, ranks = hot[sort], sort
    quick = np.zeros(1 << 20, bool)
    quick[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def first(batches):
        for batch in batches:
            ids, parts = batch.column(0), []
            for row, s in enumerate(shingle_sets(batch.column(1), k)):
                n = len(s)
                if not n or not ids[row].is_valid:
                    continue
                p = n - -(-percent * n // 100) + 1
                at = np.flatnonzero(quick[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if len(at):
                    place = np.searchsorted(names, s[at])
                    same = names[np.minimum(place, len(names) - 1)] == s[at]
                    at, place = at[same], place[same]
                if len(at):
                    cold = np.delete(s, at)
                    s = cold[:p] if len(cold) >= p else np.concatenate([cold, s[at][np.argsort(ranks[place])]])
                parts.append((row, n, s[:p]))
                if len(parts) >= 2000:
                    yield pack(ids, parts)
                    parts = []
            if parts:
                yield pack(ids, parts)

    def pack(ids, parts):
        ends = np.cumsum([0, *(len(s) for _, _, s in parts)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, _, s in parts]).view(np.int64)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _, _ in parts])), pa.array([n for _, n, _ in parts], pa.int32()), tokens], ["doc_id", "n", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(first, "doc_id long, n int, tokens array<long>")


def maybe_in(ids: DataFrame):
    """A test that holds for all of the ids (doc_id) and, by a bitmap of hashes of ``FILTER`` bits at most, for few others."""
    n = ids.count()
    bits = min(FILTER, 1 << max(16, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()

    @F.arrow_udf("boolean")
    def test(place: pa.Array) -> pa.Array:
        i = place.to_numpy(zero_copy_only=False)
        return pa.array((table[i >> 6] >> (i & 63)) & 1 == 1)

    return lambda column: test(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)))


def verified(docs: DataFrame, signed: DataFrame, pairs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough.

    Sets differ in at least as many shingles as their parity bitmaps differ in bits; pairs whose bitmaps differ in too
    many bits can't be similar and are left before any set is fetched. ``percent`` is at least 50.
    """
    odd = signed.select("doc_id", "n", "odd").dropDuplicates(["doc_id"])
    both = spread(cut(pairs), odd.toDF("a", "na", "oa"), ["a"]).join(odd.toDF("b", "nb", "ob"), "b")
    pairs = cut(both.where(_may_be_similar("na", "oa", "nb", "ob", percent)).select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(batches):
        for batch in batches:
            made = [s.view(np.int64) for s in shingle_sets(batch.column(1), k)]
            ends = np.cumsum([0] + [len(s) for s in made])
            values = np.concatenate(made) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], ["doc_id", "s"])

    held = docs.select("doc_id", "text").where(maybe_in(ids)("doc_id")).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    held = cut(held.mapInArrow(sets, "doc_id long, s array<long>"))
    both = spread(pairs, held.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), ["a"]).join(held.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _may_be_similar(na: str, oa: str, nb: str, ob: str, percent: int):
    """False if the bitmaps (columns) of two sets and their sizes rule out that they are similar enough.

    Halving a bitmap by exclusive or gives the bitmap of half as many residues, so the two can have one size: sets of similar sizes have
    bitmaps that differ by a factor of two at most.
    """
    m = F.least(F.size(oa), F.size(ob))
    halved = lambda x: F.when(F.size(x) > m, F.zip_with(F.slice(x, F.lit(1), m), F.slice(x, m + 1, m), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(halved(oa), halved(ob), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (F.size(oa) <= 2 * F.size(ob)) & (F.size(ob) <= 2 * F.size(oa)) & ((100 + percent) * apart <= (100 - percent) * (F.col(na) + F.col(nb)))


def jaccard_components(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns are not looked at).

    ``component_id`` is the smallest doc_id that a chain of links reaches. Texts without words (null, empty or blank)
    have no shingles and are a class of their own. Rows with a null doc_id link with equal sets only, and have a null
    component_id unless such a set has a doc_id. Of rows that repeat a doc_id with other texts one text stands for all.
    Shingles are compared by 64-bit hashes. An empty table gives an empty result.
    """
    # all work on texts is done in here, before the result is read
    with small_batches(docs.sparkSession):
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, k)


def _components(docs: DataFrame, percent: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    hot = hot_tokens(docs, k=k)
    signed = cut(signatures(docs, k))
    classes = cut(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    reps = cut(classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct())

    # tables that are needed no more are deleted on the way
    since = mark()
    lists = Window.partitionBy("token").orderBy("n", "doc_id")
    rows = prefixes(docs, hot, percent, k).join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", F.posexplode("tokens").alias("pos", "token"))
    # In a list by size, only the neighbours matter: if they are out of reach, so are all others.
    shared = rows.withColumns({"x": F.lag("n").over(lists), "y": F.lead("n").over(lists)})
    shared = shared.where(f"100 * x >= {percent} * n or 100 * n >= {percent} * y and {100 + percent} * (n - pos) >= {percent} * (n + y)")
    shared = cut(shared.drop("x", "y"))

    # Answer-level skipping: compare with the two leaders of each band first.
    banded = cut(signed.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", F.posexplode("bands").alias("band", "key")))
    leads = banded.groupBy("band", "key").agg(F.min(F.struct("doc_id", "n")).alias("x"), F.max(F.struct("doc_id", "n")).alias("y")).where("x != y")
    tries = spread(banded, leads, ["band", "key"]).select(F.explode(F.array("x", "y")).alias("s"), F.col("doc_id").alias("b"), "n")
    tries = tries.where((F.col("s.doc_id") != F.col("b")) & (100 * F.least("s.n", "n") >= percent * F.greatest("s.n", "n"))).select(F.col("s.doc_id").alias("a"), "b").distinct()
    taken = cut(components(verified(docs, signed, tries, percent, k)))
    forget(spark, since, keep=[shared, taken])

    # The same along the index lists: each set of a list is compared with leaders of another class, new ones in each turn. Long lists have
    # several, so that of a large group whose sets are partly linked few are left outside its class, and few links are found again among pairs.
    entry = cut(shared.join(taken.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")))
    whole = reps.join(taken.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    for turn in range(TURNS):
        # any set of the list may lead it
        leader = [F.min_by(F.struct("doc_id", "n", "pos", "comp"), F.xxhash64("doc_id", F.lit(turn * LEADERS + j))).alias(f"h{j}") for j in range(LEADERS)]
        heads = entry.groupBy("token").agg(*leader, F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("sets")).where("x != y")
        heads = heads.select("token", F.when(F.col("sets") > FEW_SETS, F.array_distinct(F.array(*(f"h{j}" for j in range(LEADERS))))).otherwise(F.array("h0")).alias("heads"))
        tries = spread(entry, heads, ["token"]).select("*", F.explode("heads").alias("h")).where((F.col("comp") != F.col("h.comp")) & (100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")))
        tries = tries.where((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("h.n") - F.col("h.pos")) >= percent * (F.col("n") + F.col("h.n")))
        tries = tries.select(F.col("h.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        merged = cut(_merged(verified(docs, signed, tries, percent, k), whole))
        entry, whole = cut(_renamed(entry, merged)), cut(_renamed(whole, merged))
        forget(spark, since, keep=[entry, whole])

    # Index-level skipping: probe only the blocks that the position leaves in reach; pairs of one class have their answer.
    # a token of very many sets is dealt into parts, each with all of the index side
    mixed = entry.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("n").alias("top"), (F.floor(F.count("*") / SETS_A_PART) + 1).cast("int").alias("parts"), F.count("*").alias("sets")).where("x != y").select("token", "top", "parts", "sets")
    entry = cut(spread(entry, mixed, ["token"]))
    forget(spark, since, keep=[entry, whole])
    # In long lists the bitmaps are compared inside the join: of sets that share a token but aren't similar hardly a row is made. Lists stay without
    # bitmaps, which are fetched where they are compared, of the sets of these lists alone.
    many = F.col("sets") > FEW_SETS
    # Before that each set outside a long list's largest class is compared with its nearest one of another class: two classes of a large group
    # may be joined by very many links, of which one is enough. Lists of which all pairs that may be similar were among these are done with.
    found = cut(_nearest(entry.where(many), signed, percent))
    merged = cut(_merged(verified(docs, signed, found.where("a is not null").select("a", "b").distinct(), percent, k), whole))
    left = found.where("token is not null").select("token").distinct()
    long = entry.where(F.col("sets") > SETS_NEAR).unionByName(entry.where(many & (F.col("sets") <= SETS_NEAR)).join(left, "token", "left_semi"))
    entry, whole = cut(_renamed(entry.where(~many).unionByName(long), merged)), cut(_renamed(whole, merged))
    forget(spark, since, keep=[entry, whole])
    mixed = entry.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("token")
    entry = cut(spread(entry, mixed, ["token"]))
    pairs = _probed(entry.where(~many), percent).unionByName(_probed(entry.where(many), percent, signed)).distinct()
    more = verified(docs, signed, pairs, percent, k)
    whole = _renamed(whole, _merged(more, whole)).select(F.col("doc_id").alias("rep"), "comp")
    named = cut(classes.join(whole, "rep", "left").select("k1", "k2", "comp"))
    forget(spark, since, keep=named)
    rows = signed.select("doc_id", "n", "k1", "k2")
    found = spread(rows.where("n > 0"), named, ["k1", "k2"]).select("doc_id", "n", "comp")
    every = found.unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("comp")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _probed(entry: DataFrame, percent: int, signed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of sets of different classes that an index list (token, with doc_id, n, pos, comp, top, parts) brings together in reach of the
    threshold, and which may be similar by their bitmaps (of ``signed``, if it is given). Lists fall into blocks by size; a pair may come from several lists."""
    ratio = 100 / percent
    block = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(ratio)))
    # overlap >= percent / (100 + percent) * (n + m), and it is at most the number of tokens from the position on
    n, pos = F.col("n"), F.col("pos")
    most = F.least(F.floor((100 + percent) * (n - pos) / percent).cast("long") - n, "top")
    side = lambda x: [F.col("doc_id").alias(x), n.alias(f"{x}n"), pos.alias(f"{x}p"), F.col("comp").alias(f"{x}c")]
    index = entry.where((pos < n - F.ceil(2 * percent * n / (100 + percent)) + 1) & (most >= n)).select("token", *side("a"), F.explode(F.sequence(block(n), block(most))).alias("block"), "parts")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    probe = entry.select("token", *side("b"), block(n).alias("block"), F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    if signed is not None:
        wide = _bitmaps(entry, signed)
        index, probe = (spread(cut(side), wide.toDF(x, f"{x}w"), [x]) for side, x in ((index, "a"), (probe, "b")))
    near = (F.col("ac") != F.col("bc")) & ((F.col("bn") > F.col("an")) | (F.col("bn") == F.col("an")) & (F.col("b") > F.col("a"))) & (percent * F.col("bn") <= 100 * F.col("an")) & ((100 + percent) * F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= percent * (F.col("an") + F.col("bn")))
    return index.join(probe, ["token", "block", "part"]).where(near if signed is None else near & _may_be_similar("an", "aw", "bn", "bw", percent)).select("a", "b")


def _bitmaps(entry: DataFrame, signed: DataFrame) -> DataFrame:
    """(doc_id, wide) of the sets of index lists (doc_id), and of few others."""
    ids = cut(entry.select("doc_id").distinct())
    return signed.select("doc_id", "wide").where(maybe_in(ids)("doc_id")).dropDuplicates(["doc_id"])


def _nearest(long: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(a, b, token): for each set b of an index list (token, doc_id, n, comp, sets) outside the list's largest class the set a of another class whose
    bitmap (of ``signed``) is nearest, of each of the ``LARGE`` largest classes and of all, if it may be similar. Lists are dealt into parts of about ``SETS_NEAR`` sets, each list in another way; no pair is
    ruled out by that, it is made later. A row with a token alone: pairs of this list that may be similar are not among the rows. Lists of more than
    ``SETS_NEAR`` sets have such pairs whether they are named or not."""

    def near(table: pa.Table) -> pa.Table:
        ids, n, comp = (table.column(c).to_numpy() for c in ("doc_id", "n", "comp"))
        names, of, many = np.unique(comp, return_inverse=True, return_counts=True)
        large = np.argsort(-many, kind="stable")[:LARGE]
        least, found, alike = np.full((len(ids), LARGE + 1), np.inf), np.full((len(ids), LARGE + 1), -1), np.zeros(len(ids), np.int64)
        lists = table.column("wide").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        sizes = np.diff(ends)
        for m in np.unique(sizes).tolist() if len(names) > 1 else []:
            # sets with twice as many bits are compared as in _may_be_similar
            at = np.flatnonzero((sizes == m) | (sizes == 2 * m))
            bits = np.stack([values[ends[i] : ends[i] + m] ^ (values[ends[i] + m : ends[i + 1]] if sizes[i] > m else np.uint64(0)) for i in at])
            small = np.flatnonzero(of[at] != large[0])
            step = max(1, CELLS // bits.size)
            for part in (small[i : i + step] for i in range(0, len(small), step)):
                apart = np.bitwise_count(bits[part][:, None] ^ bits[None]).sum(2, dtype=np.int64)
                able = ((100 + percent) * apart <= (100 - percent) * (n[at[part]][:, None] + n[at][None])) & (of[at[part]][:, None] != of[at][None])
                # each pair is compared once, at the smaller one's number of bits
                able &= (sizes[at[part]] == m)[:, None] | (sizes[at] == m)[None]
                alike[at[part]] += able.sum(1)
                apart = np.where(able, apart, np.inf)
                for j in range(len(large) + 1):
                    own = np.flatnonzero(of[at] == large[j]) if j < len(large) else np.arange(len(at))
                    if len(own):
                        best = own[apart[:, own].argmin(1)]
                        value = apart[np.arange(len(part)), best]
                        better = value < least[at[part], j]
                        least[at[part[better]], j], found[at[part[better]], j] = value[better], at[best[better]]
        b, j = np.nonzero(found >= 0)
        ordered = np.sort(found, 1)
        named = (ordered[:, 0] >= 0) + ((ordered[:, 1:] >= 0) & (ordered[:, 1:] != ordered[:, :-1])).sum(1)
        left = table.column("token").to_pylist()[:1] if (alike > named).any() else []
        return pa.table({"a": pa.array([*ids[found[b, j]].tolist(), *(None for _ in left)], pa.int64()), "b": pa.array([*ids[b].tolist(), *(None for _ in left)], pa.int64()), "token": pa.array([*(None for _ in b), *left], pa.int64())})

    part = F.pmod(F.xxhash64("token", "doc_id"), F.ceil(F.col("sets") / SETS_NEAR)).alias("part")
    rows = spread(cut(long.select("token", part, "doc_id", "n", "comp")), _bitmaps(long, signed), ["doc_id"])
    rows = rows.select("token", "part", "doc_id", "n", "comp", "wide")
    return rows.groupBy("token", "part").applyInArrow(near, "a long, b long, token long").distinct()


def _merged(links: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, comp): the classes (of ``whole``: doc_id, comp) that the links (a, b) join, and what they become."""
    ends = links.join(whole.toDF("a", "ca"), "a").join(whole.toDF("b", "cb"), "b")
    return components(ends.select("ca", "cb").distinct(), "ca", "cb")


def _renamed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows with their class (comp) as it is after the merge."""
    both = rows.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("_top")), "comp", "left")
    return both.withColumn("comp", F.coalesce("_top", "comp")).select(rows.columns)


def query(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (a null one comes last).

    Rows are told apart by a number of their own, not by doc_id: rows with a null doc_id and different texts under one
    doc_id are linked, kept or dropped as any other. Texts without words stay; of equal ones under one doc_id, one.
    """
    row = fresh(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), percent)
    groups = rows.select(F.col(row).alias("_row"), "doc_id", F.xxhash64("text").alias("h")).join(groups.toDF("_row", "n", "comp"), "_row")
    blank = (F.col("n") == 0) & F.col("doc_id").isNotNull()
    of = [F.when(~blank, F.col("comp")).alias("comp"), F.when(blank, F.col("doc_id")).alias("d"), F.when(blank, F.col("h")).alias("t")]
    keep = groups.groupBy(*of).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "_row")).alias("first"))
    return rows.join(cut(keep.select(F.col("first._row").alias(row))), row, "left_semi").select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size_of AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size_of p ON p.doc_id = a JOIN size_of q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
least_ AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM documents LEFT JOIN size_of USING (doc_id) LEFT JOIN least_ USING (doc_id)"""
