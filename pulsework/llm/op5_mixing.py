"""Mixing sources to target weights with soft membership. DataFrame functions only.

A naive-Bayes classifier over hashed words, learned by one aggregation over labelled rows, gives each document a posterior
over domains (by default its language). Rates of documents are then fitted so that the expected tokens of each domain, the
sum of rate * tokens * posterior, equal the targets: scaled projected-gradient least squares from a rate of 1, with the
rates projected to at least ``least``. Only the totals of the domains travel to the driver; a document's rate is an
expression of its own posterior and of the steps so far.
"""

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, read

#: Buckets of hashed words: the driver holds a number for each and each domain.
BUCKETS = 1 << 13
#: Labelled doc_ids that the classifier learns from at most, chosen by a hash: they are broadcast, so no text is shuffled.
LEARN = 20_000
#: Share of the tokens that each domain would have at this power of its present share.
FLATTEN = 0.7
STEPS, CLOSE = 50, 1e-9
_GAP = r"[\x20\x09-\x0D]+"


@dataclass
class Mix:
    """What ``mixed`` needs, and what came of the fit: tokens of each domain as they are, as wanted and as reached."""

    domains: list[str]
    weights: np.ndarray  # the logarithm of the share of each bucket in each domain, and last of the domain's rows
    least: float
    steps: list[list[float]] = field(default_factory=list)
    have: np.ndarray | None = None
    target: np.ndarray | None = None
    reached: np.ndarray | None = None

    @property
    def residual(self) -> float:
        """The largest difference from a target, as a share of the largest target; 0 without targets."""
        return 0.0 if self.target is None else float(np.abs(self.reached - self.target).max() / self.target.max())


def _buckets(text: str = "text") -> Column:
    """The bucket of each word (between white space, in lower case). A null text has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def learnt(rows: DataFrame, domain: str) -> tuple[list[str], np.ndarray]:
    """The domains of the rows (with _b, the buckets of their words) and the classifier's weights; rows without a domain teach nothing."""
    some = rows.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("d"), "_b")
    n = {r.d: r.n for r in some.groupBy("d").agg(F.count("*").alias("n")).collect()}  # as many as there are domains
    names = sorted(n)
    counts = np.ones((len(names), BUCKETS))
    seen = some.select("d", F.explode("_b").alias("b")).groupBy("d", "b").agg(F.count("*").alias("n")).toArrow()  # a row for each bucket of each domain at most
    place = {d: i for i, d in enumerate(names)}
    np.add.at(counts, (np.array([place[d] for d in seen["d"].to_pylist()], int), seen["b"].to_numpy()), seen["n"].to_numpy())
    logs = np.log(counts / counts.sum(1, keepdims=True)) if names else np.zeros((0, BUCKETS))
    return names, np.hstack([logs, np.log([[n[d] / sum(n.values())] for d in names] or np.zeros((0, 1)))])


def _with_posterior(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with _tokens (words between white space) and _p, the posterior of each domain."""
    out = docs.withColumn("_b", _buckets())
    table = [F.from_json(F.lit(json.dumps([round(float(x), 5) for x in row[:-1]])), "array<double>") for row in mix.weights]
    logs = [F.aggregate("_b", F.lit(float(row[-1])), lambda s, b: s + F.get(t, b)) for t, row in zip(table, mix.weights, strict=True)]  # noqa: B023
    out = out.select("*", F.size("_b").cast("long").alias("_tokens"), F.array(*logs).cast("array<double>").alias("_log")).drop("_b")
    risen = out.withColumn("_e", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    return risen.withColumn("_p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_log", "_e")


def fit(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, least: float = 0.0, keep: list[str] | None = None) -> tuple[Mix, DataFrame]:
    """The fitted mix, and a table of _tokens and _p (and the columns ``keep``) of each row of ``docs``.

    The classifier learns the column ``domain`` from rows of ``docs`` whose doc_id is in ``labels`` (``LEARN`` doc_ids at most);
    without such rows, from all. ``weights``: the share of tokens wanted of each domain (0 for one that isn't named), by default its present share to
    the power FLATTEN. The sum of the targets is the smallest that asks no domain for fewer tokens than it has. Null texts have
    no tokens and count for nothing; repeated rows count each. The fit ends at ``STEPS`` steps, when it is close, or when the
    projection leaves no better one; ``residual`` of the mix tells how close it came.
    """
    some = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN)
    known = docs.select("doc_id", domain, "text").join(F.broadcast(some), "doc_id", "left_semi")
    domains, table = learnt(known.select(domain, _buckets().alias("_b")), domain)
    if not domains:
        domains, table = learnt(docs.select(domain, _buckets().alias("_b")), domain)
    mix, k = Mix(domains, table, least), len(domains)
    keep = keep or []
    rows = cut(_with_posterior(docs.select(*{*keep, "text"}), mix).select(*keep, "_tokens", "_p"))
    if not domains:
        return mix, rows
    p = [F.get("_p", F.lit(i)) for i in range(k)]
    one = rows.agg(*(F.sum(F.col("_tokens") * p[i]).alias(f"s{i}") for i in range(k)), *(F.sum(F.col("_tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    have = np.array([one[f"s{i}"] or 0.0 for i in range(k)])
    gram = np.array([[one[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    if have.sum() <= 0:
        return mix, rows
    share = np.array([weights.get(d, 0.0) for d in domains]) if weights else (have / have.sum()) ** FLATTEN
    share = share / share.sum()
    target = share * max(h / s for h, s in zip(have, share, strict=True) if s > 0)
    mix.have, mix.target, now = have, target, have
    while len(mix.steps) < STEPS and np.abs(now - target).max() > CLOSE * target.max():
        mix.steps.append(np.linalg.lstsq(gram + 1e-12 * np.trace(gram) * np.eye(k), now - target, rcond=None)[0].tolist())
        rated = rows.withColumn("_rate", _rate(mix.steps, least))
        sums = rated.agg(*(F.sum(F.col("_tokens") * p[i] * F.col("_rate")).alias(f"s{i}") for i in range(k))).first()
        was, now = now, np.array([sums[f"s{i}"] for i in range(k)])
        if np.abs(was - now).max() <= CLOSE * target.max():
            break  # the projection leaves no better fit
    mix.reached = now
    return mix, rows


def _rate(steps, least: float) -> Column:
    """All steps are one literal, so the expression, and what is compiled for it, is the same at every step."""
    if not steps:
        return F.lit(1.0)
    e = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in step) + ")" for step in steps) + ")")
    dot = lambda step: F.aggregate(F.zip_with("_p", step, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(e, F.lit(1.0), lambda rate, step: F.greatest(F.lit(float(least)), rate - dot(step)))


def rated(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with _tokens and _p) with tokens, domain (of the largest posterior; ties go to the first by name), posterior and rate; columns of these names are replaced.

    Without any domain (an empty table, or nulls only) domain and posterior are null and the rate is 1.
    """
    out = rows.withColumn("tokens", F.col("_tokens"))
    if not mix.domains:
        return out.withColumns({"domain": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "rate": F.lit(1.0)}).drop("_tokens", "_p")
    names, top = F.array(*(F.lit(d) for d in mix.domains)), F.array_max("_p")
    return out.withColumns({"domain": F.get(names, (F.array_position("_p", top) - 1).cast("int")), "posterior": top, "rate": _rate(mix.steps, mix.least)}).drop("_tokens", "_p")


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with tokens, domain, posterior and rate, as ``rated`` has them; columns of its own of these names are replaced."""
    own = [c for c in docs.columns if c not in ("tokens", "domain", "posterior", "rate")]
    out = rated(_with_posterior(docs.select(F.struct(*own).alias("_own"), "text"), mix), mix)
    return out.select("_own.*", "tokens", "domain", "posterior", "rate")


def dealt(docs: DataFrame, mix: Mix) -> DataFrame:
    """Each row of ``docs``, with its own columns as they are, as often as its rate says: the whole part, and once more if a hash of its doc_id falls below the rest."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1e6
    out = _with_posterior(docs.select(F.struct(*docs.columns).alias("_own"), "text", "doc_id"), mix).withColumn("_rate", _rate(mix.steps, mix.least) if mix.domains else F.lit(1.0))
    times = (F.floor("_rate") + F.when(chance < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")
    out = out.select("_own", F.explode_outer(F.array_repeat(F.lit(1), times)).alias("_copy")).where("_copy is not null")
    return out.select("_own.*")


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    mix, rows = fit(docs, read(spark, sf_dir, "labels"), keep=["doc_id"])
    return rated(rows, mix).select("doc_id", "tokens", "domain", "posterior", "rate", F.lit(mix.residual).alias("residual"))
