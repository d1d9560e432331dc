"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

The measures of the contract (word counts, symbols, repeated lines and repeated
3-word windows) are reported for every document and decide its base verdict.
The rules of the method are expressions that say *reject*; what a rule needs
beyond these measures, such as a scan of the words for letters or of the lines'
ends, is part of its expression. The rules form one CASE chain that stops at
the first rejection, after the base verdict: a document that some rule rejects
costs nothing of the rules behind it. A bounded sample (``SAMPLE_DOCS``
documents chosen by hash) gives each rule's cost (time beyond a bare scan of
the sample, the least of ``RUNS`` runs) and selectivity (share rejected); the
chain runs in descending order of rejection per cost. The order changes the
work, never the verdict.

Null texts count as empty: no words, rejected as too short. Repeated rows and
ids are judged one by one; empty tables give no rows; columns of the input
other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, words_of

SAMPLE_DOCS = 1000
RUNS = 3
MIN_WORDS = 50
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and the words themselves."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    base = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    words = F.col("words")
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    base = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        windows.alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("ordered", ordered).drop("windows")
    o = F.col("ordered")
    same = lambda s, i: F.coalesce(F.get(o, i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(o, i + 1)["h"] == s["h"], F.lit(False))
    base = base.withColumn("places", F.sort_array(F.transform(F.filter(o, same), lambda s: s["i"]))).drop("ordered")
    p = F.col("places")
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rejections over the measures and the words; each is false, never null, on any row."""
    c = F.col
    letter_words = F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))
    return {
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")),
        "few_letters": 10 * letter_words < 6 * c("n_words"),
    }


def cascade(order: list[str], found: dict[str, Column]) -> Column:
    """Whether no rule rejects; those behind a rejection are not evaluated."""
    verdict = F.when(F.lit(False), F.lit(False))
    for name in order:
        verdict = verdict.when(found[name], F.lit(False))
    return verdict.otherwise(F.lit(True))


def rule_order(docs: DataFrame, found: dict[str, Column]) -> list[str]:
    """Rules by rejection per cost, as a bounded sample shows them."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    kept = staged(measures(docs.filter(chosen).limit(2 * SAMPLE_DOCS)), "rule-sample")
    sample = kept.filter(~base_failed())  # the rules run on what passes the base verdict
    bare = F.size("words") < 0  # reads what the rules read

    def run(reject: Column) -> tuple[float, int, int]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected, rows = sample.agg(F.coalesce(F.sum(reject.cast("int")), F.lit(0)), F.count("*")).first()
            took.append(time.perf_counter() - began)
        return min(took), rejected, rows

    idle, _, _ = run(bare)
    score = {}
    for name, reject in found.items():
        took, rejected, rows = run(bare | reject)
        score[name] = (rejected / max(rows, 1)) / max(took - idle, 1e-3)
    discard(kept)
    return sorted(found, key=lambda name: (-score[name], name))


def judge(docs: DataFrame) -> DataFrame:
    """Measures of each document with ``base_failed`` and the cascade's ``kept``."""
    docs = docs.select("doc_id", "text")
    found = rules()
    order = rule_order(docs, found)
    judged = measures(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, found))).drop("words")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM t),
tri AS (SELECT rid, unnest(range(len(words) - 2)) AS i, unnest(list_transform(range(len(words) - 2), lambda k: words[k + 1] || ' ' || words[k + 2] || ' ' || words[k + 3])) AS g
        FROM w WHERE len(words) >= 3),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid),
m AS (SELECT t.doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_letter_words,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM t JOIN w USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_letter_words < 6 * n_words) AS kept
FROM m
"""
