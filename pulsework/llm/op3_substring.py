"""Substring dedup over sliding spans of sentences and parts of sentences.

A text is cut into parts: at line ends, after words that end a sentence, and in stretches of ``CUT`` words without such an
end after the word with the smallest hash. The words alone decide the latter two, so equal passages are cut alike whatever
stands around them. Spans are every run of ``RUN`` consecutive sentences, however long, and, so that passages are found which hold no whole
sentences, the fewest consecutive parts with at least ``words`` words that lead from a place to a place the words decide, or back
from a place where no such span ends. Spans are hashed, the hashes are joined over the whole corpus,
and a part is removed if any span that covers it is not the first of its kind. The first is the one with the smallest
(doc_id, part number). Every run of ``words + 3 * CUT - 2`` words (48) that an earlier place has loses words; at either end
of a run less than a span may stay.

A span that stands in very many documents would be one task's work. What a task sees more than once is therefore settled
there, and only the first place goes into the join: a span has as many rows in it as there are tasks' blocks, not documents.
"""

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .op8_jaccard import FILTER
from .tables import cut, met, read, small_batches
from .textnp import Words, blocks, mix, powers

#: The most words of a part, and the sentences of a run.
CUT, RUN = 10, 3
#: Spans that a task settles together, and the most doc_ids with several texts that are broadcast.
BLOCK, BROADCAST_ROWS = 200_000, 500_000
#: Bytes of text that a task cuts at a time, as it needs about 60 times as much memory.
BYTES = 1 << 18
_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_BASES = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


class Cuts:
    """The words of a block of texts (without case), and after which of them the words alone decide to cut (``inner``), a sentence
    ends (``whole``), and a part ends (``every``). A place is a number of words of the block; first[d] is where text d begins."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        w = Words(offsets, data, lower=False)
        self.first, self.counts, n = w.first, w.counts, len(w)
        self.hashes, self.owner = w.hashes(), w.owner()
        ends = np.isin(data[w.ends - 1], np.frombuffer(b".!?", np.uint8))
        self.inner = ends.copy()
        if n >= CUT:
            low = np.lib.stride_tricks.sliding_window_view(self.hashes, CUT).argmin(1) + np.arange(n - CUT + 1)
            before = np.concatenate([[0], np.cumsum(ends)])
            alone = (before[CUT - 1 : n] == before[: n - CUT + 1]) & (self.owner[CUT - 1 :] == self.owner[: n - CUT + 1])
            self.inner[low[alone]] = True
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        self.whole = ends
        self.whole[:-1] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
        self.whole[self.first[1:][self.counts > 0] - 1] = True
        self.every = self.inner | self.whole

    def parts(self) -> np.ndarray:
        """How many parts each text has."""
        return np.bincount(self.owner[self.every], minlength=len(self.counts))


def cuts_of(column):
    """Yields (first row, Cuts) of blocks of an Arrow column of texts."""
    for row, offsets, _ in blocks(column, BYTES):
        for at, offsets, data in blocks(pc.utf8_lower(column.slice(row, len(offsets) - 1))):
            yield row + at, Cuts(offsets, data)


def parts_of(text: str) -> list[str]:
    """The parts with all they are separated by; joined they give the text."""
    raw = _WORD.findall(text)
    if not raw:
        return [text][: len(text)]
    ((_, cuts),) = cuts_of(pa.array([text]))
    at = [0, *accumulate(map(len, raw))]
    lead = len(text) - at[-1]
    ends = [0, *(lead + at[i + 1] for i in np.flatnonzero(cuts.every))]
    return [text[i:j] for i, j in zip(ends, ends[1:])]


def spans_of(cuts: Cuts, words: int) -> tuple[np.ndarray, ...]:
    """(text, 64 bits of hash, 32 more, first part, parts in it) of each span of a block."""
    first, owner, n = cuts.first, cuts.owner, len(cuts.hashes)
    ends = np.flatnonzero(cuts.every) + 1
    new = np.ones(n, bool)
    new[1:] = cuts.every[:-1]
    starts, inner = np.flatnonzero(new), np.flatnonzero(cuts.inner) + 1
    begins = np.zeros(n, bool)
    begins[first[:-1][cuts.counts > 0]] = True

    # every run of sentences
    last = np.flatnonzero(cuts.whole)
    s0, e0 = np.concatenate([[0], last[:-1] + 1])[: len(last)], last + 1
    s, e = s0[: max(0, len(last) - RUN + 1)], e0[RUN - 1 :]
    one = owner[s] == owner[e - 1]
    from_, to = [s[one]], [e[one]]

    # forward to a place that the words decide
    at = np.searchsorted(inner, starts + words)
    s, e = starts[at < len(inner)], inner[at[at < len(inner)]]
    same = owner[s] == owner[e - 1]
    s, e = s[same], e[same]
    from_.append(s), to.append(e)

    # and back from the others
    decided = begins.copy()
    decided[1:] |= cuts.inner[:-1]
    reached = np.zeros(n + 1, bool)
    reached[e[decided[s]]] = True
    e = ends[(ends - first[owner[ends - 1]] >= words) & ~reached[ends]]
    places = np.flatnonzero(decided)
    from_.append(places[np.searchsorted(places, e - words, "right") - 1]), to.append(e)

    s, e = np.concatenate(from_), np.concatenate(to)
    out = []
    for base in _BASES:
        up, down = powers(base, n + 1), powers(pow(base, -1, 1 << 64), n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(cuts.hashes ^ np.uint64(base)) * up[:n], dtype=np.uint64)])
        out.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)).view(np.int64))
    number = np.searchsorted(starts, s)
    text = owner[s] if n else s
    return text, out[0], out[1] >> 32, number - np.searchsorted(starts, first[text]), np.searchsorted(starts, e) - number


def spans(docs: DataFrame, words: int = 20) -> DataFrame:
    """(h1, h2, t, doc_id, place) of spans (96 bits of hash) of each text of ``docs`` (doc_id, text, t). A place is start << 32 | n << 1 | later
    in one number, as there are very many.

    ``later`` marks places that follow an equal one which the same task has seen; their hash is mixed with the place and means nothing.
    """

    def settled(parts):
        h1, h2, start, n, doc, text = (np.concatenate([p[i] for p in parts]) for i in range(6))
        order = np.lexsort((start, text, doc, h2, h1))
        h1, h2, start, n, doc, text = (x[order] for x in (h1, h2, start, n, doc, text))
        equal = np.zeros(len(order), bool)
        equal[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        again = equal.copy()
        again[1:] &= (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (start[1:] == start[:-1])
        h1 = np.where(equal, h1 ^ mix((doc ^ (start << 32)).view(np.uint64)).view(np.int64), h1)
        rows = [h1, h2.astype(np.int32), text.astype(np.int32), doc, start << 32 | n << 1 | equal]
        return pa.RecordBatch.from_arrays([pa.array(x[~again]) for x in rows], ["h1", "h2", "t", "doc_id", "place"])

    def run(batches):
        parts, many = [], 0
        for batch in batches:
            ids, crcs = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            for row, cuts in cuts_of(batch.column(1)):
                text, *found = spans_of(cuts, words)
                if len(text):
                    parts.append((*found, ids[row + text], crcs[row + text]))
                    many += len(text)
                if many > BLOCK:
                    yield settled(parts)
                    parts, many = [], 0
        if parts:
            yield settled(parts)

    return docs.select(F.col("doc_id").cast("long"), "text", "t").mapInArrow(run, "h1 long, h2 int, t int, doc_id long, place long")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _t, which tells texts under one doc_id apart: their CRC-32 where a doc_id has several, else 0."""
    crc = (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - (1 << 31)).cast("int")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(crc).alias("a"), F.max(crc).alias("b")).where("a != b").select("doc_id")
    several = cut(several.withColumn("_several", F.lit(True)))
    if not several.count():
        return docs.withColumn("_t", F.lit(0))
    return met(docs, several, ["doc_id"], "text", BROADCAST_ROWS, "left").withColumn("_t", F.when(F.col("_several"), crc).otherwise(0)).drop("_several")


def _parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id is one of the ids or, by a broadcast bitmap of hashes of ``FILTER`` bits at most, may be; and the others. Rows aren't shuffled, and no Python worker is asked."""
    bits = min(FILTER, 1 << max(16, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(doc_id as long)), {bits}) & 63 as int))")
    bitmap = F.broadcast(ids.groupBy(F.shiftright(at, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    here = (F.shiftright(at, 6) == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0)
    return rows.join(bitmap, here, "left_semi"), rows.join(bitmap, here, "left_anti")


def _n_parts(texts: pa.Array) -> np.ndarray:
    n = np.concatenate([cuts.parts() for _, cuts in cuts_of(texts)] or [np.zeros(0, np.int64)])
    return np.maximum(n, pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False))  # white space alone is a part


def dedup_spans(docs: DataFrame, words: int = 20) -> DataFrame:
    """The columns of ``docs`` with the remaining text, and n_sentences, n_removed (both of parts), removed (numbers of the parts).

    Rows with a null doc_id or text (kept as it is: null) lose nothing, and a passage in them removes nothing elsewhere. Rows
    that share doc_id and text are the same document and lose the same parts; different texts under one doc_id are documents
    of their own, in the order of their CRC-32. Texts without a whole span, such as empty or short ones, stay as they are.
    Columns of its own named n_sentences, n_removed or removed are replaced. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("removed", "n_sentences", "n_removed")]
    rows = _numbered(docs.select(F.struct(*(c for c in own if c != "text")).alias("_own"), "doc_id", "text"))
    # one shuffle, read in order: a span's later places are known without a second pass
    order = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "t", "place"))
    hit = spans(rows.where("doc_id is not null").select("doc_id", "text", F.col("_t").alias("t")), words).withColumn("order", order).where("order > 1 or (place & 1) = 1")
    gone = hit.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_text")).agg(F.collect_set("place").alias("_places"))
    parts = F.transform("_places", lambda p: F.sequence(F.shiftright(p, 32).cast("int"), (F.shiftright(p, 32) + F.shiftright(p.bitwiseAND(F.lit(0xFFFFFFFF)), 1) - 1).cast("int")))
    with small_batches(docs.sparkSession):
        gone = cut(gone.select("_doc", "_text", F.array_sort(F.array_distinct(F.flatten(parts))).alias("_gone")))
    # texts that lose nothing aren't shuffled, and of them Python gives back a number alone
    some, others = _parted(rows, gone.select(F.col("_doc").alias("doc_id")))

    @F.arrow_udf("struct<text string, n_sentences int, n_removed int>")
    def keep(texts: pa.Array, removed: pa.Array) -> pa.Array:
        lost = pc.fill_null(pc.list_value_length(removed), 0)
        less = pc.greater(lost, 0)
        left = []
        for text, drop in zip(texts.filter(less), removed.filter(less), strict=True):
            drop = set(drop.as_py())
            left.append("".join(p for i, p in enumerate(parts_of(text.as_py())) if i not in drop))
        left = pc.replace_with_mask(texts, less, pa.array(left, texts.type))
        return pa.StructArray.from_arrays([left.cast(pa.string()), pa.array(_n_parts(texts), pa.int32()), lost.cast(pa.int32())], ["text", "n_sentences", "n_removed"])

    @F.arrow_udf("int")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(_n_parts(texts), pa.int32())

    nothing = F.array().cast("array<int>")
    some = some.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("_t") == F.col("_text")), "left").withColumn("_kept", keep("text", "_gone"))
    some = some.select("_own", "_kept.text", "_kept.n_sentences", "_kept.n_removed", F.coalesce("_gone", nothing).alias("removed"))
    out = some.unionByName(others.select("_own", "text", counted("text").alias("n_sentences"), F.lit(0).alias("n_removed"), nothing.alias("removed")))
    return out.select(*(F.col("text" if c == "text" else f"_own.{c}").alias(c) for c in own), "n_sentences", "n_removed", "removed")


def query(spark, sf_dir):
    out = dedup_spans(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_sentences", "n_removed", "removed")
