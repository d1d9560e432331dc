import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii as P

from .helpers import edge, edge_rows, empty


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TEXTS = [
    "a@b.co_x@c.de é 1.2.3.4.5.6.7.8 +1 (386) 555-3733",
    "4111111111111111 4111-1111-1111-1111 99994111111111111111 4111111111111112",
    "+1 555 123 4567 x@y 000.0001.255.256 00001.2.3.4 +1.2.3.4",
    "1" * 12_000 + " " + "a" * 12_000 + "@b.c",
    "+" * 50 + "12345678901 a@b.c@d.e.f..g@h.i-j.k",
    "5500 0000 0000 0004-1 10.0.0.1.1 \U0001f600 me@x.org",
]


def test_base_spans(spark):
    rows = [*((r[0], r[1]) for r in edge_rows()), *((50 + i, t) for i, t in enumerate(TEXTS))]
    got = P.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", P.span_text(F.col("base")).alias("s")).collect()
    assert sorted(((r.doc_id, r.s) for r in got), key=repr) == sorted(((i, brute(t)) for i, t in rows), key=repr)
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_disclosing_terms_are_added_and_base_stays(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_TERMS", limit)
    rows = [(k, f"w{k} cipher zanzibar jo@x.org q{k} rest") for k in range(9)] + [(100 + k, f"filler line {k}\nother words {k} rest") for k in range(300)]
    rows.append((500, "Zanzibar alone, zanzibars not"))
    got = {r.doc_id: r.s for r in P.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", P.span_text(F.col("spans")).alias("s")).collect()}
    assert got[0] == "term:3:9,term:10:18,email:19:27"
    assert got[500] == "term:0:8" and got[100] == ""


def test_copies_lend_no_support(spark):
    rows = [(k, "the same sentence about jo@x.org stands here") for k in range(50)] + [(90 + k, f"other words {k}") for k in range(90)]
    got = P.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select(P.span_text(F.col("spans")).alias("s")).distinct().collect()
    assert {r.s for r in got} == {"email:24:32", ""}


def test_sanitise(spark):
    df = spark.createDataFrame([(1, "mail jo@x.org, ip 10.0.0.1 end", 3), (2, None, 7), (3, "", 0), (4, "none", 4)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.sanitise(df).collect()}
    assert got == {1: ("mail [EMAIL], ip [IP] end", 25), 2: (None, 7), 3: ("", 0), 4: ("none", 4)}
    assert P.sanitise(edge(spark)).columns == edge(spark).columns
    assert P.sanitise(empty(spark)).collect() == []


def test_one_or_two_lines_disclose_terms(spark):
    rows = [(1, "head\nAb Quill jo@x.org +1 (386) 555-3733\ntail"), (2, "Vex said ann@y.org"), (3, "ann@y.org knows Vex"), (4, "the common kim@z.org the")]
    rows += [(100 + k, f"the common line {k}\nhas other words {k} said knows head tail {k // 2}") for k in range(1500)]
    got = {r.doc_id: r.s for r in P.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", P.span_text(F.col("spans")).alias("s")).collect()}
    assert got[1].startswith("term:5:7,term:8:13,email:14:22,phone:")
    assert got[2] == "term:0:3,email:9:18" and got[3] == "email:0:9,term:16:19"
    assert got[4] == "email:11:20" and got[100] == ""


def test_many_spans_take_time_in_proportion(spark):
    import time

    def took(n):
        text = " ".join(f"a{i}@m{i}.example.org é {i % 256}.1.2.3\n" for i in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        found = P.with_base_spans(rows).select(P.span_text(F.col("base")).alias("s")).first().s.split(",")
        spent = time.perf_counter() - began
        want = [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(r"(?P<email>a\d+@m\d+\.example\.org)|\d+\.1\.2\.3", text) for k in ["email" if m["email"] else "ip"]]
        assert found == want
        return spent

    took(100)
    assert took(16_000) < 15


def test_columns_of_any_name_pass(spark):
    names = ["base", "spans", "pii_h", "pii_n", "pii_terms", "PII_M_EMAIL", "pii_base", "pii_spans", "line", "term"]
    rows = spark.createDataFrame([(1, "write to a@b.example now"), (2, None)], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = {r.doc_id: r for r in P.sanitise(rows).collect()}
    assert got[1].text == "write to [EMAIL] now" and got[2].text is None
    assert all(got[i][n] == n for i in (1, 2) for n in names)
