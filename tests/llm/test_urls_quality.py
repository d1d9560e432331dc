import itertools
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import url_lists as U

from .helpers import edge, edge_rows, empty


def test_as_of_evaluation(spark):
    entries = spark.createDataFrame(
        [("bad.org", "x", True, date(2024, 1, 10)), ("bad.org", "x", False, date(2024, 2, 1)), ("bad.org", "x", True, date(2024, 3, 1)), ("a.bad.org", "y", True, date(2024, 1, 15)), ("bad.org", "x", True, date(2024, 1, 10)), (None, "x", True, date(2024, 1, 1)), ("z.com", None, True, date(2024, 1, 1)), ("z.com", None, False, date(2024, 1, 1))],
        "pattern string, category string, listed boolean, at date",
    )
    rows = [("http://A.bad.org:80/p", date(2024, 1, 9)), ("http://a.bad.org/p", date(2024, 1, 10)), ("https://u@a.bad.org/", date(2024, 1, 20)), ("http://bad.org", date(2024, 2, 1)), ("http://bad.org", date(2024, 5, 1)), ("http://notbad.org", date(2024, 5, 1)), ("http://z.com", date(2024, 5, 1)), ("nonsense", date(2024, 5, 1)), (None, date(2024, 5, 1)), ("http://bad.org", None), ("http://bad.org", date(2024, 5, 1))]
    captures = spark.createDataFrame([(i, u, d, "p", "k") for i, (u, d) in enumerate(rows)], "id int, url string, fetched_at date, pattern string, category string")
    found = {r.id: (r.url_entries, r.url_pattern, r.url_blocked) for r in U.evaluate(captures, entries).collect()}
    assert found == {0: (0, None, False), 1: (1, "bad.org", True), 2: (2, "a.bad.org", True), 3: (0, None, False), 4: (1, "bad.org", True), 5: (0, None, False), 6: (0, None, False), 7: (0, None, False), 8: (0, None, False), 9: (0, None, False), 10: (1, "bad.org", True)}
    clash = captures.withColumns({c: F.lit("x") for c in ("url_entries", "URL_HOST", "url_at", "url_blocked")})
    again = U.evaluate(clash, entries)
    assert {r.id: (r.url_entries, r.url_pattern, r.url_blocked) for r in again.collect()} == found and {r.url_at for r in again.collect()} == {"x"}
    assert U.evaluate(captures.limit(0), entries).collect() == []
    assert U.evaluate(captures, entries.limit(0)).filter("url_blocked").count() == 0


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for t in tri:
        count[t] = count.get(t, 0) + 1
    covered = {i + j for i, t in enumerate(tri) if count[t] > 1 for j in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def test_measures_against_brute_force(spark):
    texts = ["a b c a b c a", "x\ny\nx\n \n\nx", "## $5 & | <b> *", "a b c d a b c", "word " * 60, " ".join(f"w{i}" for i in range(80)), "ü é\x0bß\x0cq\r\nz"]
    rows = [*((r[0], r[1]) for r in edge_rows()), *((100 + i, t) for i, t in enumerate(texts))]
    judged = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged), key=repr)
    assert found == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all(not r.kept for r in judged if r.base_failed)
    assert [r.kept for r in judged if r.doc_id == 105] == [True]


def test_edges(spark):
    assert Q.judge(edge(spark)).count() == len(edge_rows())
    assert Q.judge(empty(spark)).collect() == []
    docs = edge(spark)
    order = Q.rule_order(docs, Q.rules())
    assert sorted(order) == sorted(Q.rules())


def test_rules_behind_a_rejection_are_not_evaluated(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    fails = F.when(F.col("text") == "a", F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False)).cast("boolean")
    found = {"first": F.col("text") == "a", "second": fails}
    kept = rows.select("doc_id", Q.cascade(["first", "second"], found).alias("kept")).collect()
    assert {r.doc_id: r.kept for r in kept} == {1: False, 2: True}
    with pytest.raises(Exception, match="evaluated"):
        rows.select(Q.cascade(["second", "first"], found)).collect()


def test_the_order_never_changes_the_verdict(spark):
    text = "word 12 34 ## 56 " * 30
    rows = [(1, text), (2, "plain words of a text " * 30), (3, "\n".join(["same line of some words here"] * 40)), (4, " ".join(f"word{i}" for i in range(80)))]
    docs = Q.measures(spark.createDataFrame(rows, "doc_id long, text string"))
    found = Q.rules()
    seen = {tuple(sorted((r.doc_id, r.kept) for r in docs.select("doc_id", Q.cascade(list(order), found).alias("kept")).collect())) for order in itertools.permutations(found)}
    assert len(seen) == 1
