"""Mixing documents to target domain weights, in DataFrame functions alone.

Domains are the classes of the labelled table. A naive Bayes classifier over
hashed words learns them from a bounded sample (``LABELLED_DOCS`` labelled rows
chosen by hash) and gives every document posteriors p(d, k). A document of
n(d) words at rate r(d) adds r(d) n(d) p(d, k) to the expected total of domain
k; the rates minimise the squared distance of these totals from the targets,
r >= 0, by projected gradient descent from r = 1. Steps are scaled by n(d), so
that the rate, not the word, is the unit of change, and by the trace of the
Gram matrix, which bounds its largest eigenvalue. Each round is one
aggregation over the documents; only the residuals, one number a domain, pass
through the driver, and a document's rate is refolded from them.

``copies`` turns rates into whole numbers: the floor, and one more where a hash
of the row falls below the remainder. Texts without words (null ones too) have
the priors as posteriors, no effect on totals and rate 1. Null and unlabelled
ids are classified like others; of repeated labels of an id the least text
form holds. Without labelled rows there is one domain, ``all``; unless the
weights name it, every rate is 1. Domains that labels name but documents never show
are left out of the fit, and the other targets share their weight. Repeated
rows get rates of their own. Empty tables give no rows. Extra columns pass
through; the added ones start with ``mix_``, and :func:`mix` puts them in the
place of input columns that start so (:func:`mixed_rows` keeps those). The
descent ends at the tolerance, or where ``STALL`` rounds bring less than a
thousandth of the squared error: targets may be out of reach, and what is left
is told in a warning.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shielded, staged, words_of

LABELLED_DOCS = 4000
BUCKETS = 32_768
SMOOTHING = 0.5
TEMPER = 0.5  # words of a text depend on each other: their evidence counts as the power n ** -TEMPER of it
STALL = 16  # rounds over which the descent must gain something
FOLD = 8  # rounds between two tables of the documents' states
TOLERANCE = 1e-4  # of all words


def label_domain() -> Column:
    """The domain of a row of ``labels``: toxic, junk (low quality) or clean."""
    return F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") <= 0, "junk").when(F.col("quality").isNotNull(), "clean")


def buckets_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def classifier(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float], list[list[float]]]:
    """Domains, log priors and log likelihoods (bucket, domain): a table of ``BUCKETS`` rows at most."""
    marked = labels.select("doc_id", label_domain().alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = marked.count()
    share = min(1.0, LABELLED_DOCS / max(n, 1))
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit("domains")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * LABELLED_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = staged(rows.select("domain", buckets_of(words_of(F.col("text"))).alias("b")), "labelled-words")
    priors = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not priors:
        discard(rows)
        return ["all"], [0.0], [[0.0] for _ in range(BUCKETS)]
    domains = sorted(priors)
    # each word counts once for a document, so that long documents are not a domain's only voice
    counts = rows.select("domain", F.explode(F.array_distinct("b")).alias("b")).groupBy("b", "domain").agg(F.count("*").alias("n")).collect()
    discard(rows)
    table = [[SMOOTHING] * len(domains) for _ in range(BUCKETS)]
    for r in counts:
        table[r.b][domains.index(r.domain)] += r.n
    sums = [sum(row[k] for row in table) for k in range(len(domains))]
    total = sum(priors.values())
    likely = [[math.log(row[k] / sums[k]) for k in range(len(domains))] for row in table]
    return domains, [math.log(priors[d] / total) for d in domains], likely


def literal(values: list[float]) -> Column:
    """A constant array of doubles, one string in the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def posteriors(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with mix_n (words) and mix_p (array of posteriors by domain, in the order returned)."""
    domains, prior, likely = classifier(docs, labels)
    table = [literal([row[k] - row[0] for row in likely]) for k in range(1, len(domains))]
    own = docs.columns
    counted = docs.select(*own, words_of(F.col("text")).alias("mix_w"))
    counted = counted.select(*own, F.size("mix_w").cast("long").alias("mix_n"), buckets_of(F.col("mix_w")).alias("mix_b"))
    zero = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in range(1, len(domains))), F.lit(0).alias("n"))
    add = lambda acc, b: F.struct(*(((acc[f"s{k}"] + F.get(table[k - 1], b)).alias(f"s{k}")) for k in range(1, len(domains))), (acc["n"] + 1).alias("n"))
    summed = counted.select(*own, "mix_n", F.aggregate("mix_b", zero, add).alias("mix_s"))
    scale = F.pow(F.greatest(F.col("mix_n"), F.lit(1)).cast("double"), F.lit(-TEMPER))
    scores = [F.lit(0.0)] + [F.lit(prior[k] - prior[0]) + F.col(f"mix_s.s{k}") * scale for k in range(1, len(domains))]
    top = summed.select(*own, "mix_n", F.array(*scores).alias("mix_z")).withColumn("mix_m", F.array_max("mix_z"))
    e = top.withColumn("mix_e", F.transform("mix_z", lambda z: F.exp(z - F.col("mix_m"))))
    total = F.aggregate("mix_e", F.lit(0.0), lambda a, x: a + x)
    return e.withColumn("mix_t", total).withColumn("mix_p", F.transform("mix_e", lambda x: x / F.col("mix_t"))).drop("mix_z", "mix_m", "mix_e", "mix_t"), domains


def folded(rounds: list[list[float]], domains: int, start: Column | None = None) -> Column:
    """State (r: rate, y: rate carried on by its momentum) after ``rounds``, each a momentum and the scaled residuals."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")) if start is None else start
    if not rounds:
        return start
    each = F.transform(F.split(F.lit(";".join(",".join(map(repr, r)) for r in rounds)), ";"), lambda s: F.split(s, ",").cast("array<double>"))

    def step(state, e):
        moved = sum((F.get(e, F.lit(k + 1)) * F.get(F.col("mix_p"), F.lit(k)) for k in range(domains)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), state["y"] - moved)
        return F.struct(r.alias("r"), (r + F.get(e, F.lit(0)) * (r - state["r"])).alias("y"))

    return F.aggregate(each, start, step)


def rate(rounds: list[list[float]], domains: int) -> Column:
    """The fitted rate of a document, refolded from 1."""
    return F.when(F.col("mix_n") > 0, folded(rounds, domains)["r"]).otherwise(F.lit(1.0))


def fit_rates(known: DataFrame, domains: list[str], weights: dict[str, float], scale: float = 1.0) -> list[list[float]]:
    """The rounds of the descent. ``known`` has mix_n and mix_p; targets are ``scale`` times its words, dealt by ``weights``."""
    k = len(domains)
    p = [F.col("mix_p")[i] for i in range(k)]
    n = F.col("mix_n").cast("double")
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    first = known.agg(sums(n), *(sums(n * p[i]) for i in range(k)), *(sums(n * p[i] * p[i]) for i in range(k))).first()
    total, held, gram = first[0], first[1 : k + 1], first[k + 1 :]
    given = [max(weights.get(d, 0.0), 0.0) if held[i] > 0 else 0.0 for i, d in enumerate(domains)]
    if sum(given) <= 0 or total <= 0:
        return []
    targets = [scale * total * g / sum(given) for g in given]
    # residuals are relative to what a domain holds; the change of totals is then W G e with G(i, j) = sum n p_i p_j,
    # whose trace bounds its eigenvalues
    w = [1.0 / h if h > 0 else 0.0 for h in held]
    step = 1.0 / sum(a * b for a, b in zip(w, gram))
    rounds: list[list[float]] = []
    state = known.filter("mix_n > 0").select("mix_n", "mix_p", F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")).alias("mix_state"))
    fresh: list[list[float]] = []
    old = None
    now, t = list(held), 1.0
    squares: list[float] = []
    while True:
        error = [a - b for a, b in zip(now, targets)]
        if max(map(abs, error)) <= TOLERANCE * total:
            break
        squares.append(sum(e * e for e in error))
        if len(squares) > 2 * STALL and min(squares[-STALL:]) > 0.999 * min(squares[-2 * STALL : -STALL]):
            warnings.warn(f"the mixture misses its targets by up to {max(map(abs, error)) / total:.2%} of all words", stacklevel=2)
            break
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        this = [(t - 1) / after, *(step * a * b for a, b in zip(w, error))]
        t = after
        rounds.append(this)
        fresh.append(this)
        if len(fresh) > FOLD:
            state = staged(state.withColumn("mix_state", folded(fresh, k, F.col("mix_state"))), "mix-state")
            if old is not None:
                discard(old)
            old, fresh = state, []
        y = folded(fresh, k, F.col("mix_state"))["y"]
        now = list(state.select("mix_n", "mix_p", y.alias("y")).agg(*(sums(F.col("y") * n * p[i]) for i in range(k))).first())
    if old is not None:
        discard(old)
    return rounds


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 1.0) -> DataFrame:
    """``docs`` with mix_n, mix_p, mix_domain (the likeliest), mix_rate and mix_copies."""
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("mix_")))
    found, domains = posteriors(docs, labels)
    known = staged(found, "posteriors")
    narrow = known.select("mix_n", "mix_p")
    rated = known.withColumn("mix_rate", rate(fit_rates(narrow, domains, weights, scale), len(domains)))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("mix_rate")
    rated = rated.withColumn("mix_copies", (whole + F.when(chance < F.col("mix_rate") - whole, 1).otherwise(0)).cast("long"))
    best = F.array_position("mix_p", F.array_max("mix_p")).cast("int") - 1
    return rated.withColumn("mix_domain", F.get(F.array(*map(F.lit, domains)), best)).drop("mix_s")


def apply_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as its copies say, with ``columns`` alone."""
    return mixed.filter("mix_copies > 0").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy")).select(*columns)


def mixed_rows(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 1.0) -> DataFrame:
    """``docs``, each row as often as its fitted rate says; all columns stay, whatever their names."""
    docs, given = shielded(docs, "mix_")
    return given(apply_copies(mix(docs, labels, weights, scale), docs.columns))
