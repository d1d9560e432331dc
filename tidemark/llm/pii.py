"""Personal data: pattern spans and information-theoretic sanitisation, in DataFrame functions alone.

Base spans come from four patterns (email, ip, card, phone), leftmost and
without overlap per kind; matches that fail their check are dropped. A match's
place follows from the lengths of the matches and of the pieces between them,
summed in runs of ``RUN``, so the work grows with the text.

The method adds spans of kind ``term``. Every valid match is a protected
entity; its context is the words of its line, ``CONTEXT_WORDS`` (and at most
``CONTEXT_CHARS`` characters) on either side, and equal lines count once, so copies lend no support. Over the corpus's lines a term
reveals entity e by log2(p(e | term) / p(e)) bits, p(e | term) being the share
of the term's distinct lines that have it near e, smoothed by one more line without e. Terms with
p(e | term) >= ``MIN_SHARE`` (unsmoothed), ``MIN_BITS`` bits and ``MIN_EVIDENCE`` bits over all of their lines with e
exceed the disclosure threshold, so one line is enough in a corpus of some thousand lines: their occurrences become spans wherever they
stand, unless a base span covers them. :func:`sanitise` generalises spans to
their kind.

Null texts count as empty. Repeated rows and ids keep one result each. Texts of
any length are searched whole. Empty tables give no rows. Extra columns pass
through, whatever their names: spans have the names that the caller asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, staged

#: The patterns of the contract, with possessive repeats and starts that cannot differ from the
#: leftmost match but keep the search linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
ORDER = {k: i for i, k in enumerate([*KINDS, "term"])}
CONTEXT_WORDS = 5
CONTEXT_CHARS = 400
RUN = 64
MIN_SHARE = 0.5
MIN_BITS = 4.0
MIN_EVIDENCE = 10.0  # chance brings a term and an entity together less often than once in 2^10
BROADCAST_TERMS = 20_000
WORD = r"\p{L}\p{M}\p{N}"
SPAN = "struct<start:int,ord:int,stop:int,value:string>"


def digits_of(match: Column) -> Column:
    return F.translate(match, " -+().", "")


def luhn(digits: Column) -> Column:
    def step(total, i):
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = 2 * d - F.when(2 * d > 9, F.lit(9)).otherwise(F.lit(0))
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, F.lit(False)).otherwise(F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    n = F.length(digits_of(match))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(match))).otherwise(F.lit(False))
    return n.between(9, 15)


def matches(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    return F.when(sign, found).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often a loop in the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(pieces: Column, found: Column) -> Column:
    """Places of the matches ``found`` between the ``pieces`` of a text: running sums, in two steps."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(acc, x):
        return F.struct((acc["at"] + x["p"] + x["m"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["p"])).alias("starts"))

    def summed(steps):
        runs = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))
        return F.transform(runs, lambda k: F.aggregate(F.slice(steps, k * RUN + 1, F.lit(RUN)), zero, add))

    def shift(acc, run):
        moved = F.transform(run["starts"], lambda x: x + acc["at"])
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["runs"], F.array(moved)).alias("runs"))

    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("runs"))
    return F.flatten(F.aggregate(let(steps, summed), whole, shift)["runs"])


def located(kind: str, found: Column, pieces: Column) -> Column:
    """Spans of all matches of one kind."""
    span = lambda at, m: F.struct(at.alias("start"), F.lit(ORDER[kind]).alias("ord"), (at + F.length(m)).alias("stop"), m.alias("value"))
    return F.when(F.size(found) > 0, F.zip_with(starts(pieces, found), found, span)).otherwise(F.array()).cast(f"array<{SPAN}>")


def placed(kind: str, found: Column, text: Column) -> Column:
    """Spans of the valid ones among the matches of one kind."""
    return F.filter(located(kind, found, F.split(text, PATTERNS[kind], -1)), lambda s: valid(kind, s["value"]))


def with_base_spans(docs: DataFrame, base: str = "base") -> DataFrame:
    """``docs`` with ``base``: all base spans by start, then kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.columns
    marks = fresh(docs, *(f"pii_m_{k}" for k in KINDS))
    found = docs.select("*", *(matches(k, t).alias(m) for k, m in zip(KINDS, marks)))
    return found.select(*kept, F.sort_array(F.concat(*(placed(k, F.col(m), t) for k, m in zip(KINDS, marks)))).alias(base))


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["ord"] == ORDER[kind])


def terms_of(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"[^{WORD}]+"), lambda w: w != ""))


def contexts(spanned: DataFrame) -> DataFrame:
    """entity, line (hash), context: the words around each entity in its line, with all base spans blanked."""
    text = F.coalesce("text", F.lit(""))
    hit = spanned.select(text.alias("text"), F.explode("base").alias("span"))
    before = F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("span.start")), "\n", -1)
    after = F.substring_index(F.substring(F.col("text"), F.col("span.stop") + 1, F.length("text")), "\n", 1)
    near = lambda side, where: F.split(F.substring(side, where * CONTEXT_CHARS if where < 0 else 1, CONTEXT_CHARS), SPACE_CLASS)
    hit = hit.select(F.lower("span.value").alias("entity"), F.xxhash64(before, "span.value", after).alias("line"), near(before, -1).alias("b"), near(after, 1).alias("a"))
    side = lambda words: F.array_join(words, " ")
    first = F.greatest(F.size("b") - CONTEXT_WORDS, F.lit(1))
    context = F.concat_ws(" ", side(F.slice("b", first, F.lit(CONTEXT_WORDS + 1))), side(F.slice("a", 1, CONTEXT_WORDS + 1)))
    for pattern in PATTERNS.values():
        context = F.regexp_replace(context, pattern, " ")
    return hit.select("entity", "line", context.alias("context")).distinct()


def disclosing_terms(spanned: DataFrame, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS, min_evidence: float = MIN_EVIDENCE) -> DataFrame | None:
    """Terms above the disclosure threshold in each text that holds them: pii_h, pii_n (hash and length), term; None where no entity has a term."""
    near = staged(contexts(spanned), "entity-contexts")
    pairs = near.select("entity", "line", F.explode(terms_of(F.col("context"))).alias("term")).distinct()
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("joint"))
    near_any = pairs.select("term", "line").distinct().groupBy("term").agg(F.count("*").alias("near_any"))
    # a term has at least as many lines as it has near entities
    joint = staged(joint.join(near_any, "term").filter(F.col("joint") >= min_share * F.col("near_any")).drop("near_any"), "joint-terms")
    if joint.isEmpty():
        return None
    wanted = small(joint.select(F.xxhash64("term").alias("t")).distinct())
    lines = spanned.select(F.xxhash64("text").alias("pii_h"), F.length("text").alias("pii_n"), F.explode(F.split("text", "\n")).alias("line")).filter("line != ''")
    n = lines.agg(F.approx_count_distinct(F.xxhash64("line"), 0.01)).first()[0]
    held = lines.select("pii_h", "pii_n", F.xxhash64("line").alias("line"), F.explode(terms_of(F.col("line"))).alias("term"))
    held = staged(held.withColumn("t", F.xxhash64("term")).join(wanted, "t", "left_semi").drop("t"), "term-places")
    totals = held.select("term", "line").distinct().groupBy("term").agg(F.count("*").alias("lines"))
    entity = near.select("entity", "line").distinct().groupBy("entity").agg(F.count("*").alias("entity_lines"))
    scored = joint.join(totals, "term").join(entity, "entity")
    bits = F.log2(F.col("joint") / (F.col("lines") + 1) * F.lit(float(max(n, 1))) / F.col("entity_lines"))
    telling = (F.col("joint") >= min_share * F.col("lines")) & (bits >= min_bits) & (F.col("joint") * bits >= min_evidence)
    return held.join(scored.filter(telling).select("term").distinct(), "term", "left_semi").select("pii_h", "pii_n", "term").distinct()


def small(terms: DataFrame, times: int = 50) -> DataFrame:
    """Broadcast a table of hashes only where it is counted to be small; else it is shuffled."""
    limit = times * BROADCAST_TERMS
    return F.broadcast(terms) if terms.limit(limit + 1).count() <= limit else terms


def term_spans(text: Column, terms: Column) -> Column:
    """Whole-word places of ``terms`` (letters and digits) in ``text``, upper or lower case."""
    pattern = F.concat(F.lit(f"(?iu)(?<![{WORD}])(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(f")(?![{WORD}])"))
    pieces = F.call_function("split", text, pattern)
    found = F.call_function("regexp_extract_all", text, pattern, F.lit(0))

    return located("term", found, pieces)


def with_spans(docs: DataFrame, base: str = "base", spans: str = "spans", **thresholds) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (base and term spans by start, then kind)."""
    spanned = with_base_spans(docs, base)
    risky = disclosing_terms(with_base_spans(docs.select("text")), **thresholds)
    if risky is None:
        return spanned.withColumn(spans, F.col(base))
    h, n, terms = fresh(spanned, "pii_h", "pii_n", "pii_terms")
    held = staged(risky.groupBy(F.col("pii_h").alias(h), F.col("pii_n").alias(n)).agg(F.collect_set("term").alias(terms)), "disclosing-terms")
    found = spanned.withColumns({h: F.xxhash64("text"), n: F.length("text")}).join(small(held, 1), [h, n], "left").drop(h, n)
    clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    added = F.when(F.size(terms) > 0, F.filter(term_spans(F.col("text"), F.col(terms)), clear))
    return found.withColumn(spans, F.sort_array(F.concat(base, F.coalesce(added, F.array().cast(f"array<{SPAN}>"))))).drop(terms)


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans generalised to the kind of its first span, as ``[EMAIL]``."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ORDER))

    def step(acc, s):
        covered = s["start"] < acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["ord"]))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(covered, acc["out"]).otherwise(more).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with every span of ``text`` generalised; its other columns stay, ``n_chars`` follows the text."""
    columns = docs.columns
    base, spans = fresh(docs, "pii_base", "pii_spans")
    done = with_spans(docs, base, spans, **thresholds).withColumn("text", masked(F.col("text"), F.col(spans)))
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return done.select(*columns)
