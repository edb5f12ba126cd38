"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ``ORDER`` characters over lower-case letters and single spaces between words. n-grams of all texts that
may be learnt from are counted in Spark; continuation counts, discounts and back-off weights are aggregated from these counts
there too. Probabilities and back-off weights are folded into hashes of ``HASH_BITS`` bits, of equal hashes the most frequent n-gram's,
so the sorted hash arrays that go to the tasks have a bound whatever the size of the corpus (2 ** ``HASH_BITS`` entries of an order and
a language). A text gets the language with the lowest cross-entropy for each character.

Rejection and score are calibrated on a quarter of the texts, all of them and whole, by a model of the others: a limit on the cross-entropy of each language that narrows
with the length, and a logistic curve over the margin between the two best languages.
"""

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labelled import sigmoid
from .tables import cut, fresh, read
from .textnp import blocks, mix

ORDER, HASH_BITS = 4, 21
#: The share of right texts that a limit lets through.
PASS = 0.999
#: Distinct n-grams that a task holds before it sends them on, and probabilities that it looks up at a time.
HELD, CELLS = 1 << 20, 1 << 22

_ODD = mix(np.arange(11, 11 + ORDER, dtype=np.uint64)) | np.uint64(1)


def held_out():
    """Rows that are never learnt from: crc32 of the doc_id as text can be divided by 5."""
    return F.coalesce(_fold() == 0, F.lit(False))


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


@cache
def letters() -> np.ndarray:
    """For each code point the lower-case letter or the combining mark that it stands for, or 32."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x32400):
        if unicodedata.category(c := chr(i))[0] in "LM":
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def streams(column):
    """Yields (first row, ends, codes, has letters) of runs of whole texts.

    A text becomes ``ORDER`` - 1 spaces, its words with one space between them, and a space; text i ends before ``ends[i + 1]``.
    A text without letters has spaces and no n-gram.
    """
    table = letters()
    for at, offsets, data in blocks(column):
        codes = table[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        letter = codes != 32
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        begins[np.unique(chars[:-1][np.diff(chars) > 0])] = letter[chars[:-1][np.diff(chars) > 0]]
        total = np.concatenate([[0], np.cumsum(letter.astype(np.int64) + begins)])
        text = np.repeat(np.arange(len(chars) - 1), np.diff(chars))
        out = np.full(total[-1] + ORDER * (len(chars) - 1) - (len(chars) - 1), 32, np.uint32)
        at_letter = np.flatnonzero(letter)
        out[total[at_letter + 1] - 1 + (ORDER - 1) * text[at_letter] + ORDER - 2] = codes[at_letter]
        ends = total[chars] + (ORDER - 1) * np.arange(len(chars))
        yield at, ends, out, np.diff(total[chars]) > 0


def places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of each text end, and how many each text has."""
    n = np.maximum(np.diff(ends) - (ORDER - 1), 0)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - np.repeat(first, n) + np.repeat(ends[:-1] + ORDER - 1, n), n


def hashed(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k characters up to each place."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h += codes[at - j].astype(np.uint64) * _ODD[j]
    return mix(h)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def _codes(grams) -> np.ndarray:
    """An array of code points for n-grams of one length."""
    raw = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
    return raw.reshape(len(grams), -1) if len(grams) else np.zeros((0, ORDER), np.uint32)


def _hash_of(grams: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points."""
    k = grams.shape[1]
    return hashed(grams.ravel(), np.arange(len(grams)) * k + k - 1, k)


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n, most: n-grams of all rows that may be learnt from, and of those of them that aren't for the calibration."""

    def count(batches):
        names: dict[str, int] = {}
        keys, rows = [np.zeros(0, np.uint64)], [np.zeros((0, ORDER + 3), np.int64)]  # code points, language, fold, count
        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for first, ends, codes, _ in streams(batch.column(0)):
                at, n = places(ends)
                of = 2 * np.repeat(lang[first : first + len(n)], n) + np.repeat(fold[first : first + len(n)], n)
                key, where, many = np.unique(mix(hashed(codes, at, ORDER) + mix(of.astype(np.uint64))), return_index=True, return_counts=True)
                at, of = at[where], of[where]
                keys.append(key)
                rows.append(np.stack([*(codes[at - j] for j in range(ORDER - 1, -1, -1)), of >> 1, of & 1, many], 1).astype(np.int64))
                if sum(map(len, keys)) > HELD:
                    keys, rows = merged(keys, rows)
                    if len(keys[0]) > HELD // 2:
                        yield pack(rows[0], list(names))
                        keys, rows = [keys[0][:0]], [rows[0][:0]]
        yield pack(merged(keys, rows)[1][0], list(names))

    def merged(keys, rows):
        key, where, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        every = np.concatenate(rows)
        out = every[where]
        out[:, -1] = np.bincount(back, every[:, -1], len(key)).astype(np.int64)
        return [key], [out]

    def pack(rows, names):
        grams = np.ascontiguousarray(rows[:, :ORDER].astype(np.uint32)).view(f"<U{ORDER}").ravel()
        lang = pa.DictionaryArray.from_arrays(pa.array(rows[:, ORDER].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array(rows[:, ORDER + 1] == 1), pa.array(grams.tolist(), pa.string()), pa.array(rows[:, ORDER + 2])], ["lang", "fold", "gram", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() > 0)).select("text", "lang", (_fold() == 1).cast("long"))
    rows = rows.mapInArrow(count, "lang string, fold boolean, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fold"), 0).otherwise(F.col("n"))).alias("most"))


def levels(counts: DataFrame):
    """For each order k, from 1: rows (lang, gram, n, alpha, gamma, total): the discounted share of the n-gram after its context, and of its context
    the weight of the next shorter one and the count. n: occurrences at ``ORDER``, below it the distinct characters before."""
    out, rows = [], counts
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            rows = rows.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        rows = cut(rows.select("lang", "gram", "n"))
        once = rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        once = once.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.expr("n1 / nullif(n1 + 2 * n2, 0)"), F.lit(0.5)))).alias("d"))
        w = Window.partitionBy("lang", F.substring("gram", 1, k - 1))
        level = rows.withColumns({"total": F.sum("n").over(w), "types": F.count("*").over(w)}).join(F.broadcast(once), "lang")  # a row for each language
        out.append((k, level.select("lang", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"), (F.col("d") * F.col("types") / F.col("total")).alias("gamma"), "total")))
    return out[::-1]


class Model:
    """The sorted hash arrays of all languages."""

    def __init__(self, counts: DataFrame):
        @F.arrow_udf("long")
        def place(gram: pa.Array) -> pa.Array:
            return pa.array(bucket(_hash_of(_codes(gram.to_pylist()))))

        def folded(rows, gram, value, weight):
            top = rows.groupBy("lang", place(gram).alias("bucket")).agg(F.max_by(F.struct(gram.alias("g"), value), F.struct(weight, gram)).alias("x"))
            return top.select("lang", "x.g", F.col(f"x.{value}").alias("v")).toArrow()  # 2 ** HASH_BITS rows a language at most

        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        self.grams, self.logs, self.probs, self.contexts, self.gammas = {}, {}, {}, {}, {}
        if not self.langs:
            return
        for k, level in levels(counts):
            level = cut(level)
            context = F.substring("gram", 1, k - 1)
            if k > 1:
                self.contexts[k], self.gammas[k], _ = self._dense(folded(level, context, "gamma", "total"), 1.0)
            else:
                gamma = {r.lang: r.g for r in level.groupBy("lang").agg(F.max("gamma").alias("g")).collect()}
                self.gammas[1] = np.array([[gamma[x] for x in self.langs]], np.float32)
            self.grams[k], alpha, codes = self._dense(folded(level, F.col("gram"), "alpha", "n"), 0.0)
            lower = self.probability(codes[:, 1:], k - 1) if k > 1 else np.full((1, len(self.langs)), 1 / (len(codes) + 1), np.float32)
            if k == 1:
                self.unknown = self.gammas[1] * lower
            self.probs[k] = alpha + self._gamma(codes, k) * lower
        self.logs = np.log(self.probs[ORDER])

    def _dense(self, found: pa.Table, empty: float):
        """Sorted hashes, a value for each of them and each language, and the n-grams."""
        codes = _codes(found["g"].to_pylist())
        places, first, back = np.unique(bucket(_hash_of(codes)), return_index=True, return_inverse=True)
        out = np.full((len(places), len(self.langs)), empty, np.float32)
        out[back, np.searchsorted(self.langs, found["lang"].to_numpy(zero_copy_only=False).astype(str))] = found["v"].to_numpy()
        return places.astype(np.int32), out, codes[first]

    def _gamma(self, codes: np.ndarray, k: int) -> np.ndarray:
        if k == 1:
            return self.gammas[1]
        at, known = _find(self.contexts[k], bucket(_hash_of(codes[:, :-1])))
        return np.where(known[:, None], self.gammas[k][at], np.float32(1))

    def probability(self, codes: np.ndarray, k: int) -> np.ndarray:
        """For rows of k code points, the probability of the last after the others in each language."""
        at, known = _find(self.grams[k], bucket(_hash_of(codes)))
        out = self.probs[k][at]
        if not known.all():
            rest = codes[~known]
            out[~known] = self._gamma(rest, k) * self.probability(rest[:, 1:], k - 1) if k > 1 else self.unknown
        return out

    def entropies(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text of an Arrow column the cross-entropy (nats a character) in each language, the characters, and whether it has a letter."""
        found, sizes, lettered = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for _, ends, codes, has in streams(column):
            at, n = places(ends)
            first = np.cumsum(n) - n
            total = np.zeros((len(n), len(self.langs)))
            step = max(1, CELLS // max(1, len(self.langs)))
            for a in range(0, len(at) if self.langs else 0, step):
                part = at[a : a + step]
                row, known = _find(self.grams[ORDER], bucket(hashed(codes, part, ORDER)))
                logs = self.logs[row]
                if not known.all():
                    odd = part[~known]
                    logs[~known] = np.log(self.probability(np.stack([codes[odd - j] for j in range(ORDER - 1, -1, -1)], 1), ORDER))
                texts = np.flatnonzero((n > 0) & (first < a + len(part)) & (first + n > a))
                total[texts] += np.add.reduceat(logs, np.maximum(first[texts] - a, 0), axis=0)
            found.append(-total / np.maximum(n, 1)[:, None])
            sizes.append(n)
            lettered.append(has)
        return np.concatenate(found), np.concatenate(sizes), np.concatenate(lettered)


def _find(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_hashes, h.astype(np.int32)), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


def fit(docs: DataFrame):
    """The model, the curve of the score (slope, base) and the limits (mean, width) of each language, from ``docs`` (doc_id, text, lang).

    All rows that may be learnt from are counted, and all of those kept from the trial model calibrate: null texts, langs and doc_ids teach nothing. Without any, there are no languages.
    """
    counts = cut(counted(docs))
    model, trial = Model(counts.select("lang", "gram", "n")), Model(counts.where("most > 0").select("lang", "gram", F.col("most").alias("n")))
    curve, limits = (1.0, 0.0), {}
    if not trial.langs:
        return model, curve, limits

    @F.arrow_udf("lang string, best double, margin double, n long, has boolean")
    def tried(text: pa.Array) -> pa.Array:
        entropy, n, has = trial.entropies(text)
        lang = pa.array(np.array(trial.langs)[entropy.argmin(1)].tolist(), pa.string())
        return pa.StructArray.from_arrays([lang, *map(pa.array, (entropy.min(1), _margin(entropy, n), n, has))], ["lang", "best", "margin", "n", "has"])

    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() == 1)).select("lang", tried("text").alias("x"))
    own = cut(own.where("x.has").select("x.lang", "x.best", "x.margin", "x.n", (F.col("x.lang") == F.col("lang")).alias("right")))
    # all margins, in steps of a thousandth of their size: some ten thousand rows, however many the texts are
    steps = own.groupBy(F.round(F.log1p("margin") * 1000).alias("step"), "right").agg(F.avg("margin").alias("x"), F.count("*").alias("n")).orderBy("step", "right").toArrow()
    if steps.num_rows:
        x, right, n = (steps[c].to_numpy() for c in ("x", "right", "n"))
        curve = logistic(x, right.astype(float), n)
    own = own.where("right").join(F.broadcast(own.where("right").groupBy("lang").agg(F.avg("best").alias("mean"))), "lang")  # a row for each language
    # all distances from the mean, in steps of a thousandth of their size too; the limit is the least step that lets through enough
    z = (F.col("best") - F.col("mean")) * F.sqrt("n")
    over = F.ceil(F.signum(z) * F.log1p(F.abs(z)) * 1000).cast("double")
    far = own.groupBy("lang", "mean", over.alias("step")).agg(F.count("*").alias("n")).orderBy("lang", "step").toArrow()
    names, mean, step, n = (far[c].to_numpy(zero_copy_only=False) for c in ("lang", "mean", "step", "n"))
    for lang in set(names.tolist()):
        of = names == lang
        total = np.cumsum(n[of])
        last = step[of][np.searchsorted(total, PASS * total[-1])] / 1000
        limits[lang] = (float(mean[of][0]), float(np.sign(last) * np.expm1(abs(last))))
    return model, curve, limits


def _margin(entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distance of the two best languages in nats, times the root of the length."""
    two = np.sort(entropy, 1)[:, :2]
    return (two[:, 1] - two[:, 0] if two.shape[1] == 2 else np.full(len(two), 1.0)) * np.sqrt(n)


def logistic(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic regression by Newton's method, each row counted ``many`` times, drawn a little towards 1 and 0."""
    w, rows = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], 1)
    for _ in range(30):
        p = sigmoid(rows @ w)
        slope = rows.T @ (many * (p - y)) + 0.1 * (w - [1, 0])
        w = w - np.linalg.solve(rows.T @ (rows * (many * p * (1 - p))[:, None]) + 0.1 * np.eye(2), slope)
        w[0] = max(w[0], 0.01)
    return float(w[0]), float(w[1])


def identified(docs: DataFrame, fitted) -> DataFrame:
    """``docs`` with lang_pred, score, entropy (nats a character) and rejected; own columns of these names are replaced.

    lang_pred is ``und``, and score 0, for a null text, one without a letter, and where no language was learnt; equal cross-entropies go to the first
    name. score is the calibrated probability that the language is right. rejected: the text is less like its language than the calibration
    allows; the caller may take it as none of the languages. Repeated rows get the same, an empty table gives an empty one.
    """
    model, (slope, base), limits = fitted
    names = np.array([*model.langs, "und"])
    mean, width = (np.array([limits.get(x, (np.inf, 0.0))[i] for x in model.langs]) for i in (0, 1))

    @F.arrow_udf("lang string, score double, entropy double, rejected boolean")
    def find(text: pa.Array) -> pa.Array:
        entropy, n, has = model.entropies(text)
        if not model.langs:
            has[:] = False
            entropy = np.zeros((len(has), 1))
        best = entropy.argmin(1)
        least = entropy.min(1)
        score = np.where(has, sigmoid(slope * _margin(entropy, n) + base), 0.0)
        over = has & (least > mean[best] + width[best] / np.sqrt(np.maximum(n, 1))) if model.langs else has
        columns = [pa.array(names[np.where(has, best, len(model.langs))].tolist(), pa.string()), pa.array(score), pa.array(np.where(has, least, np.nan), mask=~has), pa.array(over)]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "entropy", "rejected"])

    x = fresh(docs, "_found")
    out = docs.withColumn(x, find("text"))
    return out.withColumns({"lang_pred": F.col(f"{x}.lang"), "score": F.col(f"{x}.score"), "entropy": F.col(f"{x}.entropy"), "rejected": F.col(f"{x}.rejected")}).drop(x)


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
