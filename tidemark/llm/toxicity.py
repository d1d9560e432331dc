"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

A text is its lower-case UTF-8 bytes with single spaces between words and around
them. An expression is a run of ``TOP`` bytes: the last byte is predicted from
the others, its history, which may cross words. No history, byte or expression
is left out, so the counts grow with the training texts, whatever their script.
B_c(h, x) is the number of different training texts of class c that hold
history h followed by x, B their sum and C their sums over x: repetition within
a text and exact copies lend no weight. For class c, from the longest history:

    p_c(x | h)  = max(B_c(h, x) - D_c(h, x), 0) / C_c(h) + L(h) q_c(x | h)
    p(x | h)    = max(B(h, x) - d, 0) / C(h) + d T(h) / C(h) p_kn(x | h')
    D_c(h, x)   = E + LEVEL sqrt(E) + d,   E = C_c(h) q_c(x | h)

p is the shared model, T the number of different x, h' the history without its
first byte, and p_kn the interpolated Kneser-Ney model of continuation counts
(how many bytes stand before a run) down to single bytes. The backoff q_c is p
times the ratio that the class has at the shorter history, p_c(x | h') /
p(x | h'), so a rare expression is judged by the counts of its shorter form; at
the shortest class history (``LOW`` bytes with x) q_c is p. The discount takes
what the shared counts explain: a class keeps what is beyond them, and where
neither keeps anything the classes agree. L(h) gives away what both classes'
discounts took.

A text's evidence is the sum over its different expressions of log p_toxic -
log p_ordinary, less what ordinary text is expected to show after the same
histories, less the mean of ordinary texts per expression, over the number of
expressions to the power ``POWER``. A rising curve (pooled adjacent violators)
maps it to a score. The curve is fitted on training texts in ``FOLDS`` parts,
each scored by the model of the other parts, so no text judges itself; equal
texts are in one part.

Only expressions with a ratio of their own and histories with an expectation
are looked up. Up to ``BROADCAST_ENTRIES`` of them (counted, 16 bytes each in a task) are
sent to the tasks; a larger model is joined to the expressions of the texts.

Training rows are the labelled rows whose crc32(doc_id as text) mod 3 is not 1.
Scores come from the text alone. Texts without words (null ones too) score the
training share of toxic texts. Rows with a null id are scored, never learnt
from; of repeated labels of an id the higher holds; null labels are no labels;
a text that is labelled both ways counts for both classes.
Without training rows of both classes every score is 0. Extra columns of the
input are ignored by :func:`score` and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import arrow_rows, discard, shielded, staged

TOP, LOW = 5, 4  # bytes of an expression, and of its shorter form
DISCOUNT = 0.75
LEVEL = 2.0
POWER = 0.75
FOLDS = 4
MODELS = FOLDS + 1  # the last one is learnt from all parts
SCALE = 8.0
HELD_GRAMS = 1_000_000  # different expressions that a task holds before it sends them on
BROADCAST_ENTRIES = 8_000_000
BROADCAST_LABELS = 4_000_000
THRESHOLD = 0.7
NONE = 1e-9
GROUPS = [f"c{k}" for k in range(2 * FOLDS)]


def packed(text: str | None) -> np.ndarray:
    """The text's bytes as the models read them; empty for texts without words."""
    words = (text or "").lower().split()
    return np.frombuffer(f"{' ' * (TOP - 1)}{' '.join(words)} ".encode("utf-8", "replace"), np.uint8) if words else np.zeros(0, np.uint8)


def expressions(raw: np.ndarray, size: int = TOP) -> np.ndarray:
    """The different runs of ``size`` bytes as numbers, first byte highest."""
    if len(raw) < size:
        return np.zeros(0, np.int64)
    n = len(raw) - size + 1
    key = np.zeros(n, np.int64)
    for j in range(size):
        key <<= 8
        key |= raw[j : j + n]
    key.sort()
    return key[np.r_[True, key[1:] != key[:-1]]]


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """group (2 * fold + label) and text of the training rows, equal ones once."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    marked = marked.select(F.col("doc_id").cast("long").alias("id"), (F.col("label") > 0).cast("int").alias("label"))
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.crc32(F.col("id").cast("string")) % 3 != 1)
    rows = rows.join(marked, "id").select("label", "text", F.xxhash64("text").alias("h0"), F.xxhash64("text", F.lit(1)).alias("h1"))
    once = rows.groupBy("h0", "h1", "label").agg(F.first("text").alias("text"))
    return once.select((2 * F.pmod("h1", F.lit(FOLDS)) + F.col("label")).cast("int").alias("group"), "text")


def summed(keys: list[np.ndarray], groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and, for each, in how many of the arrays of each group it is."""
    key = np.concatenate(keys)
    group = np.repeat(np.array(groups, np.int64), [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    key, group = key[order], group[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    out = np.zeros((len(new), 2 * FOLDS), np.int32)
    np.add.at(out, (np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(key)])), group), 1)
    return key[new], out


def merged(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        return b
    key, row = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = np.zeros((len(key), 2 * FOLDS), np.int32)
    np.add.at(out, row, np.concatenate([a[1], b[1]]))
    return key, out


def count_texts(rows: DataFrame) -> DataFrame:
    """size, g and, for each group, the number of texts that hold the run g of so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple | None] = {LOW: None, TOP: None}

        def out(size):
            key, n = held[size]
            held[size] = None
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), size, np.int32)), pa.array(key), *(pa.array(n[:, k]) for k in range(2 * FOLDS))], ["size", "g", *GROUPS])

        for batch in batches:
            groups, texts = batch.column(0).to_pylist(), [packed(t) for t in batch.column(1).to_pylist()]
            for size in held:
                keys = [expressions(t, size) for t in texts]
                held[size] = merged(held[size], summed(keys, groups))
                if len(held[size][0]) >= HELD_GRAMS:
                    yield out(size)
        for size in held:
            if held[size] is not None and len(held[size][0]):
                yield out(size)

    found = rows.mapInArrow(run, f"size int, g long, {', '.join(f'{c} int' for c in GROUPS)}")
    return found.groupBy("size", "g").agg(*(F.sum(c).alias(c) for c in GROUPS))


def _low(size: int) -> Column:
    """The run without its first byte, of ``size`` bytes then."""
    return F.col("g").bitwiseAND(F.lit((1 << 8 * size) - 1))


def _history() -> Column:
    return F.shiftright("g", 8)


def interpolated(counts: DataFrame, lower: DataFrame | None, size: int) -> DataFrame:
    """g and p: Kneser-Ney probabilities of the runs of ``size`` bytes with n continuations."""
    if lower is None:
        total = counts.agg(F.sum("n")).first()[0] or 1
        return counts.select("g", (F.col("n") / total).alias("p"))
    same = Window.partitionBy(_history())
    held = counts.withColumn("all", F.sum("n").over(same)).withColumn("kinds", F.count("*").over(same)).withColumn("low", _low(size - 1))
    held = held.join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
    return held.select("g", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("all") + DISCOUNT * F.col("kinds") / F.col("all") * F.col("q")).alias("p"))


def class_ratios(counts: DataFrame, lower: DataFrame, size: int, shorter: DataFrame | None) -> DataFrame:
    """j (model), g, h, ratio r, p0 (the ordinary class's probability) and whether a class keeps something of its own."""
    of = lambda j, label: sum(F.col(f"c{2 * f + label}") for f in range(FOLDS) if f != j).cast("double")
    each = F.array(*(F.struct(F.lit(j).alias("j"), of(j, 0).alias("n"), of(j, 1).alias("t")) for j in range(MODELS)))
    held = counts.select("g", _history().alias("h"), _low(size - 1).alias("low"), sum(F.col(c) for c in GROUPS).alias("b"), each.alias("e"))
    same = Window.partitionBy("h")
    held = held.select("*", F.sum("b").over(same).alias("all"), F.count("*").over(same).alias("kinds")).join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
    p = F.greatest(F.col("b") - DISCOUNT, F.lit(0.0)) / F.col("all") + DISCOUNT * F.col("kinds") / F.col("all") * F.col("q")
    held = held.select("g", "h", "low", p.alias("p"), F.explode("e").alias("e")).select("g", "h", "low", "p", "e.*")
    if shorter is None:
        held = held.withColumn("s", F.lit(1.0))
    else:
        held = held.join(shorter.select("j", F.col("g").alias("low"), F.exp("r").alias("s")), ["j", "low"], "left").withColumn("s", F.coalesce("s", F.lit(1.0)))
    same = Window.partitionBy("j", "h")

    def kept(x: str, prior: Column) -> Column:
        expected = F.col(f"{x}_all") * prior
        return F.greatest(F.col(x) - expected - LEVEL * F.sqrt(expected) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{x}_all"), F.lit(1.0))

    held = held.withColumns({"n_all": F.sum("n").over(same), "t_all": F.sum("t").over(same)})
    held = held.withColumns({"kn": kept("n", F.col("p")), "kt": kept("t", F.col("p") * F.col("s"))})
    held = held.withColumn("back", F.greatest(1 - F.sum(F.col("kn") + F.col("kt")).over(same) / 2, F.lit(1e-6)) * F.col("p"))
    held = held.withColumn("p0", F.col("kn") + F.col("back"))
    r = F.log(F.col("kt") + F.col("back") * F.col("s")) - F.log("p0")
    return held.select("j", "g", "h", r.alias("r"), "p0", ((F.col("kn") > 0) | (F.col("kt") > 0)).alias("own"))


def fitted(counts: DataFrame) -> DataFrame:
    """The models as rows kind, j, g, r: runs of TOP (kind 0) and LOW (1) bytes with ratios of their own, expectations of histories (2)."""
    low, top = counts.filter(F.col("size") == LOW), counts.filter(F.col("size") == TOP)
    after = lambda runs, size: runs.groupBy(_low(size).alias("g")).agg(F.count("*").alias("n"))
    levels = {LOW - 1: after(low, LOW - 1), LOW: after(top, LOW)}
    for size in range(LOW - 2, 0, -1):
        levels[size] = after(levels[size + 1], size)
    p: DataFrame | None = None
    shared = {}
    for size in range(1, LOW + 1):
        p = shared[size] = interpolated(levels[size], p, size)
        if size == LOW - 1:  # read twice
            p = shared[size] = staged(p, "toxicity-shared")
    short = staged(class_ratios(low, shared[LOW - 1], LOW, None).filter("own").select("j", "g", "r"), "toxicity-short")
    long = staged(class_ratios(top, shared[LOW], TOP, short), "toxicity-long")
    usual = long.groupBy("j", "h").agg((F.sum(F.col("p0") * F.col("r")) / F.sum("p0")).alias("r")).filter(F.abs("r") > NONE)
    parts = [long.filter("own"), short, usual.withColumnRenamed("h", "g")]
    parts = [x.select(F.lit(kind).alias("kind"), "j", "g", "r") for kind, x in enumerate(parts)]
    model = staged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "toxicity-model")
    for done in (short, long, shared[LOW - 1]):
        discard(done)
    return model


@dataclass
class Lookup:
    """One model's entries by kind: sorted runs and their values."""

    runs: list[np.ndarray]
    values: list[np.ndarray]

    def of(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = self.runs[kind]
        if not len(runs):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(runs, key), len(runs) - 1)
        hit = runs[at] == key
        return np.where(hit, self.values[kind][at], 0.0), hit

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Summed log-likelihood ratios less their expectations, and the number of expressions."""
        key = expressions(packed(text))
        own, hit = self.of(0, key)
        less, _ = self.of(1, key & ((1 << 8 * LOW) - 1))
        usual, _ = self.of(2, key >> 8)
        return float((np.where(hit, own, less) - usual).sum()), len(key)


def lookups(model: DataFrame, models: list[int]) -> list[Lookup]:
    rows = model.filter(F.col("j").isin(models)).select("j", "kind", "g", "r").toArrow()
    j, kind, g, r = (c.to_numpy() for c in rows.columns)
    order = np.lexsort((g, kind, j))
    place, g, r = (3 * j + kind)[order], g[order], r[order]
    cut = lambda k: slice(*np.searchsorted(place, [k, k + 1]))
    return [Lookup([g[cut(3 * m + k)] for k in range(3)], [r[cut(3 * m + k)] for k in range(3)]) for m in models]


def evidence(texts: DataFrame, model: DataFrame, chosen: Column, models: list[int]) -> DataFrame:
    """``texts`` with tox_s and tox_n: evidence by the model ``chosen`` (of ``models``), and number of expressions.

    The model is sent to the tasks if it is counted to be small, and joined otherwise.
    """
    model = model.filter(F.col("j").isin(models))
    if model.count() <= BROADCAST_ENTRIES:
        return _evidence_sent(texts, model, chosen, models)
    return _evidence_joined(texts, model, chosen)


def _evidence_sent(texts: DataFrame, model: DataFrame, chosen: Column, models: list[int]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(dict(zip(models, lookups(model, models))))
    names, n_own, at = [*texts.columns, "tox_s", "tox_n"], len(texts.columns), texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value[j].evidence(t.as_py()) for t, j in zip(batch.column(at), batch.column(n_own).to_pylist())]
            s, n = pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], s, n], names)

    schema = StructType([*texts.schema.fields, StructField("tox_s", DoubleType()), StructField("tox_n", LongType())])
    return texts.withColumn("tox_model", chosen.cast("int")).mapInArrow(run, schema)


def _evidence_joined(texts: DataFrame, model: DataFrame, chosen: Column) -> DataFrame:
    rows = staged(texts.select("*", chosen.cast("int").alias("tox_model"), F.monotonically_increasing_id().alias("tox_row")), "toxicity-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, j, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                key = expressions(packed(text.as_py()))
                columns = [pa.array(np.full(len(key), row, np.int64)), pa.array(np.full(len(key), j, np.int32)), pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, ["tox_row", "tox_model", "g"])

    told = rows.select("tox_row", "tox_model", "text").mapInArrow(run, "tox_row long, tox_model int, g long")
    told = told.select("*", F.col("g").alias("own"), _low(LOW).alias("less"), _history().alias("usual"))
    for kind, key in enumerate(("own", "less", "usual")):
        side = model.filter(F.col("kind") == kind).select(F.col("j").alias("tox_model"), F.col("g").alias(key), F.col("r").alias(f"{key}_v"))
        told = told.join(side, ["tox_model", key], "left")
    part = F.coalesce("own_v", "less_v", F.lit(0.0)) - F.coalesce("usual_v", F.lit(0.0))
    sums = told.groupBy("tox_row").agg(F.sum(part).alias("tox_s"), F.count("*").alias("tox_n"))
    found = rows.join(sums, "tox_row", "left")
    return found.select(*texts.columns, F.coalesce("tox_s", F.lit(0.0)).alias("tox_s"), F.coalesce("tox_n", F.lit(0)).cast("long").alias("tox_n"))


def normalised(drift: float) -> Column:
    """The evidence per expression to the power ``POWER``, on a scale that tells small and large values apart."""
    n = F.greatest(F.col("tox_n"), F.lit(1)).cast("double")
    return F.asinh(SCALE * (F.col("tox_s") - F.lit(drift) * n) / F.pow(n, F.lit(POWER)))


def fit_curve(bins: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of a rising curve through the histograms (class, bin).

    Bins without texts join their neighbours; each block has half a text of either class beside its own.
    """
    n0, n1 = bins.astype(float)
    blocks: list[list[float]] = []  # ordinary, toxic, sum of centres
    for k in np.flatnonzero(n0 + n1):
        blocks.append([n0[k], n1[k], (n0[k] + n1[k]) * centres[k]])
        while len(blocks) > 1 and blocks[-2][1] * sum(blocks[-1][:2]) >= blocks[-1][1] * sum(blocks[-2][:2]):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    prior = n1.sum() / max(n0.sum() + n1.sum(), 1)
    x = np.array([s / (a + b) for a, b, s in blocks])
    y = np.maximum.accumulate([(b + prior) / (a + b + 1) for a, b, _ in blocks])
    # beyond the outer knots the curve goes on to 0 and 1, slowly, so that evidence still orders texts
    x = np.concatenate([[min(x[0], centres[0]) - 1e-6], x, [max(x[-1], centres[-1]) + 1e-6]])
    y = np.concatenate([[y[0] * 0.5], y, [(y[-1] + 1) / 2]])
    return x, y


BINS, SPREAD = 8192, 12.0
CENTRES = (np.arange(BINS) + 0.5) / BINS * 2 * SPREAD - SPREAD


@dataclass
class Scorer:
    """The fitted model (None: nothing to learn from), the drift of ordinary texts and the curve."""

    model: DataFrame | None
    drift: float = 0.0
    x: np.ndarray | None = None
    y: np.ndarray | None = None
    share: float = 0.0

    def score(self) -> Column:
        """Score from tox_s and tox_n: a walk along the knots, in generated code."""
        z = normalised(self.drift)
        knots = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(self.x, self.y)))
        start = F.struct(F.lit(float(self.x[0])).alias("x"), F.lit(float(self.y[0])).alias("y"), F.lit(float(self.y[0])).alias("at"))

        def step(acc, k):
            between = acc["y"] + (k["y"] - acc["y"]) * (z - acc["x"]) / F.greatest(k["x"] - acc["x"], F.lit(1e-12))
            return F.struct(k["x"].alias("x"), k["y"].alias("y"), F.when(z <= acc["x"], acc["at"]).otherwise(F.least(k["y"], between)).alias("at"))

        return F.when(F.col("tox_n") > 0, F.aggregate(knots, start, step)["at"]).otherwise(F.lit(self.share))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    arrow_rows(docs.sparkSession)
    rows = staged(training(docs, labels), "toxicity-training")
    label = (F.col("group") % 2).alias("label")
    totals = {r.label: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        discard(rows)
        return Scorer(None)
    counts = staged(count_texts(rows), "toxicity-counts")
    model = fitted(counts)
    discard(counts)
    told = staged(evidence(rows, model, F.floor(F.col("group") / 2), list(range(FOLDS))).drop("text"), "toxicity-evidence").filter("tox_n > 0")
    s, n = told.filter("group % 2 = 0").agg(F.sum("tox_s"), F.sum("tox_n")).first()
    scorer = Scorer(model, float(s or 0.0) / max(n or 0, 1), share=totals[1] / sum(totals.values()))
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((normalised(scorer.drift) + SPREAD) / (2 * SPREAD) * BINS)))
    bins = np.zeros((2, BINS))
    for r in told.groupBy(label, at.alias("bin")).agg(F.count("*").alias("n")).collect():
        bins[r.label, r.bin] = r.n
    discard(rows)
    scorer.x, scorer.y = fit_curve(bins, CENTRES) if bins.any() else (np.array([0.0, 1.0]), np.array([scorer.share] * 2))
    return scorer


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def with_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (without columns named tox_...) with tox_score."""
    scorer = fit(docs.select("doc_id", "text"), labels)
    if scorer.model is None:
        return docs.withColumn("tox_score", F.lit(0.0))
    return evidence(docs, scorer.model, F.lit(FOLDS), [FOLDS]).withColumn("tox_score", scorer.score())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    found = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return found.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay, whatever their names."""
    docs, given = shielded(docs, "tox_")
    return given(with_score(docs, labels).filter(F.col("tox_score") < threshold))
