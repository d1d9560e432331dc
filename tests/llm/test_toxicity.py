import math
import random
import zlib
from collections import Counter, defaultdict

from tidemark.llm import toxicity as X

from .helpers import edge, empty, label_table

BAD = ["vile", "scum", "idiot", "trash"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "de", "ki", "lo", "mu", "re") for b in ("n", "s", "t", "la", "ro", "mi")] + ["the", "of", "and", "to"] * 3
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(len(text) // 12 + 1):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df, lt = spark.createDataFrame(docs, "doc_id long, text string"), label_table(spark, labels)
    rows = X.score(df, lt).collect()
    truth = {i: t for i, _, t in labels}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.95
    kept = {r.doc_id for r in X.drop_toxic(df.withColumnRenamed("doc_id", "doc_id"), lt).collect()}
    assert kept == {r.doc_id for r in rows if r.score < X.THRESHOLD}


def test_scores_follow_the_text_alone(spark):
    docs, labels = corpus(300)
    twin = [(10_000 + i, t) for i, t in docs[:50]]
    df = spark.createDataFrame(docs + twin, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in X.score(df, label_table(spark, labels)).collect()}
    assert all(rows[i] == rows[10_000 + i] for i, _ in docs[:50])


def test_edges(spark):
    labels = label_table(spark, [(1, 1, 0), (2, 1, 1), (6, 0, 1), (7, 1, 0), (8, 1, 0), (None, 1, 1), (3, None, None), (8, 1, 1)])
    assert X.score(edge(spark), labels).count() == edge(spark).count()
    none = X.score(edge(spark), label_table(spark)).collect()
    assert {r.score for r in none} == {0.0}
    assert X.score(empty(spark), labels).collect() == []
    named = edge(spark).withColumnsRenamed({"n": "tox_n", "key": "tox_s", "words": "TOX_score"})
    kept = X.drop_toxic(named, labels)
    assert kept.columns == named.columns and 0 < kept.count() <= edge(spark).count()
    kept = X.drop_toxic(edge(spark), label_table(spark))
    assert kept.columns == edge(spark).columns and kept.count() == edge(spark).count()


def brute_model(texts, model):
    """The ratios and expectations of one model by loops over dictionaries: texts are (group, text)."""
    sets = {(g, t) for g, t in texts}
    runs = lambda t, m: {X.packed(t).tobytes()[i : i + m] for i in range(len(X.packed(t)) - m + 1)}
    held = {m: [(g, runs(t, m)) for g, t in sets] for m in (X.LOW, X.TOP)}
    kinds = {m: {r for _, rs in held[m] for r in rs} for m in held}
    n = {X.LOW: Counter(r[1:] for r in kinds[X.TOP]), X.LOW - 1: Counter(r[1:] for r in kinds[X.LOW])}
    for m in range(X.LOW - 2, 0, -1):
        n[m] = Counter(r[1:] for r in n[m + 1])
    d = X.DISCOUNT

    def interpolate(counts, lower):
        total, types = Counter(), Counter()
        for r, c in counts.items():
            total[r[:-1]] += c
            types[r[:-1]] += 1
        return {r: max(c - d, 0) / total[r[:-1]] + d * types[r[:-1]] / total[r[:-1]] * lower(r[1:]) for r, c in counts.items()}

    kn = {1: {r: c / sum(n[1].values()) for r, c in n[1].items()}}
    for m in range(2, X.LOW + 1):
        kn[m] = interpolate(n[m], kn[m - 1].__getitem__)
    ratios, usual, shorter = {}, {}, {}
    for m in (X.LOW, X.TOP):
        counts = {c: Counter() for c in (0, 1)}
        both = Counter()
        for g, rs in held[m]:
            both.update(rs)
            if g // 2 != model:
                counts[g % 2].update(rs)
        p = interpolate(both, kn[m - 1].__getitem__)
        sums = {c: defaultdict(float) for c in (0, 1)}
        for c in (0, 1):
            for r, k in counts[c].items():
                sums[c][r[:-1]] += k
        kept, taken = {}, defaultdict(float)
        for r in both:
            for c in (0, 1):
                e = sums[c][r[:-1]] * p[r] * (math.exp(shorter.get(r[1:], 0.0)) if c else 1.0)
                kept[c, r] = max(counts[c][r] - e - X.LEVEL * math.sqrt(e) - d, 0) / max(sums[c][r[:-1]], 1)
                taken[r[:-1]] += kept[c, r] / 2
        found, mass, moment = {}, defaultdict(float), defaultdict(float)
        for r in both:
            back = max(1 - taken[r[:-1]], 1e-6) * p[r]
            p0 = kept[0, r] + back
            value = math.log(kept[1, r] + back * math.exp(shorter.get(r[1:], 0.0))) - math.log(p0)
            mass[r[:-1]] += p0
            moment[r[:-1]] += p0 * value
            if kept[0, r] or kept[1, r]:
                found[r] = value
        ratios[m], shorter = found, found
        usual = {h: moment[h] / mass[h] for h in mass}
    return ratios, usual


def test_model_equals_brute_force(spark):
    docs, labels = corpus(300, 11)
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:20])]  # copies lend no weight
    labels += [(1000 + i, 1, labels[i][2]) for i in range(20)]
    df, lt = spark.createDataFrame(docs, "doc_id long, text string"), label_table(spark, labels)
    rows = X.training(df, lt)
    texts = [(r.group, r.text) for r in rows.collect()]
    assert len(texts) == len(set(t for _, t in texts))
    model = X.fitted(X.count_texts(rows))
    held = {(r.kind, r.j, r.g): r.r for r in model.collect()}
    number = lambda r: int.from_bytes(r, "big")
    for j in (0, X.FOLDS):
        ratios, usual = brute_model(texts, j)
        want = {(0, j, number(r)): v for r, v in ratios[X.TOP].items()} | {(1, j, number(r)): v for r, v in ratios[X.LOW].items()}
        want |= {(2, j, number(h)): v for h, v in usual.items() if abs(v) > X.NONE}
        got = {k: v for k, v in held.items() if k[1] == j}
        assert got.keys() == want.keys() and any(k[0] == 0 for k in want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        lookup = X.lookups(model, [j])[0]
        for _, t in docs[:5]:
            raw = X.packed(t).tobytes()
            runs = {raw[i : i + X.TOP] for i in range(len(raw) - X.TOP + 1)}
            s = sum(ratios[X.TOP].get(r, ratios[X.LOW].get(r[1:], 0.0)) - usual.get(r[:-1], 0.0) for r in runs)
            got_s, n = lookup.evidence(t)
            assert n == len(runs) and abs(got_s - s) < 1e-6


def test_a_joined_model_scores_as_a_sent_one(spark, monkeypatch):
    docs, labels = corpus(80, 5)
    df = spark.createDataFrame([*docs, (5000, None), (5001, " "), (None, "vile scum")], "doc_id long, text string")
    sent = {(r.doc_id, round(r.score, 9)) for r in X.score(df, label_table(spark, labels)).collect()}
    monkeypatch.setattr(X, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(X, "BROADCAST_LABELS", 0)
    joined = {(r.doc_id, round(r.score, 9)) for r in X.score(df, label_table(spark, labels)).collect()}
    assert sent == joined and len(sent) == 83


def test_unseen_forms_of_a_toxic_stem(spark):
    rng = random.Random(9)
    syllables = [a + b for a in "bdgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        text = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(5 * toxic):
            text.insert(rng.randrange(len(text)), "qwexo" + word())
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows = X.score(spark.createDataFrame(docs, "doc_id long, text string"), label_table(spark, labels)).filter("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in rows) > 0.98 * len(rows)
