"""Operators without SQL against plain-Python versions of what they compute."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from palimpsest.llm import decontamination, near_dedup
from palimpsest.llm import quality_classifier as classifier

# ------------------------------------------------------------------ decontamination: every window, by the table form of LCS


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_leaks(docs, items):
    """(every pair that must be found, every pair that may be found): a span is a window of 64 words and 32 around it."""
    texts = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    asked = {i: re.findall(r"\w+", t.lower()) for i, t in items}
    quoted = {tuple(w[k : k + 3]) for w in asked.values() for k in range(len(w) - 2)}
    df, distinct = Counter(), {tuple(w) for w in texts.values()}
    known = {x for w in asked.values() for x in w}
    for w in distinct:
        free = [True] * len(w)
        for k in range(len(w) - 2):
            if w[k : k + 3] and tuple(w[k : k + 3]) in quoted:
                free[k : k + 3] = [False] * 3
        df.update({x for x, f in zip(w, free, strict=True) if f and x in known})
    common = {x for x in known if df[x] > 0.05 * len(distinct)}
    if common == known:
        common = set()

    def leak(unit, span):
        rare = [x for x in unit if x not in common]
        answered = len(rare) >= 4 and set(rare[-4:]) <= set(span)
        if rare and lcs_length(rare, span) < 0.6 * len(rare):
            return False
        return answered or lcs_length(unit, span) >= 0.8 * len(unit)

    must, may = set(), set()
    for i, w in texts.items():
        for item, full in asked.items():
            if len(full) < 8:
                if any(w[k : k + len(full)] == full for k in range(len(w) - len(full) + 1)) and full:
                    must.add((i, item))
                continue
            for at in range(0, max(1, len(full) - 32), 32):
                unit = full[at : at + 64]
                have = [x for x in w if x in known]
                if sum((Counter(unit) & Counter(have)).values()) < 0.5 * len(unit):
                    continue
                for start in range(-32, len(w), 32):
                    span = w[max(0, start - 32) : start + 96]
                    if not leak(unit, span):
                        continue
                    may.add((i, item))
                    near = any(leak(unit, span[k : k + 2 * len(unit)]) for k in range(len(span)) if span[k] in unit)
                    if near or 2 * len(unit) >= 128:
                        must.add((i, item))
    return must, must | may


def test_leaks_equal_every_window(spark, docs):
    rng = random.Random(77)
    usual = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(30)]
    word = lambda: rng.choice(usual) if rng.random() < 0.5 else "".join(rng.choice("klmnopqrst") for _ in range(5))
    fill = lambda n: [word() for _ in range(n)]
    items = [(k, fill(n)) for k, n in enumerate([3, 5, 7, 8, 9, 12, 15, 20, 30, 45, 64, 65, 100, 150])]
    items += [(50, items[8][1]), (51, rng.choices(usual, k=14))]
    rows = [(i, fill(rng.randrange(0, 200))) for i in range(60)]
    for k, t in items:
        for d, change in enumerate((0.0, 0.1, 0.2, 0.3, 0.45, 0.6)):
            part = [w if rng.random() >= change else rng.choice([[], [word()], [w, word()]]) for w in t]
            flat = [x for p in part for x in (p if isinstance(p, list) else [p])]
            rows.append((1000 + k * 10 + d, fill(rng.randrange(0, 90)) + flat + fill(rng.randrange(0, 90))))
    rows += [(5000, [x for w in items[9][1] for x in (w, *fill(1))]), (5001, items[12][1][:70])]
    texts = [(i, " ".join(w)) for i, w in rows] + [(6000, None), (6001, "")]
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    must, may = brute_leaks(texts, [(k, " ".join(t)) for k, t in items])
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(texts), benchmark).collect()}
    assert len(must) > 40
    assert must <= found <= may


def test_segments_and_batches_change_nothing(spark, docs, monkeypatch):
    rng = random.Random(9)
    fill = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n))
    items = [(k, fill(n)) for k, n in enumerate([5, 12, 30, 64, 120])]
    rows = [(i, fill(150)) for i in range(30)] + [(100 + i, f"{fill(3900 + 61 * i)} {t} {fill(5000)}") for i, t in items]
    rows += [(200 + j, f"{fill(j)} {items[3][1]} {fill(700)}") for j in range(300, 700, 37)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = {(100 + i, i) for i, _ in items} | {(200 + j, 3) for j in range(300, 700, 37)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(rows), benchmark).collect()} == expected
    monkeypatch.setattr(decontamination, "SEGMENT", 400)
    monkeypatch.setattr(decontamination, "HALVES", 20)
    monkeypatch.setattr(decontamination, "BLOCK", 2)
    monkeypatch.setattr(decontamination, "_CHARS", 1000)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(rows), benchmark).collect()} == expected


def test_columns_named_answer(spark, docs):
    rng = random.Random(4)
    fill = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n))
    text = fill(40)
    cut = " ".join(w if k % 3 else fill(1) for k, w in enumerate(text.split()))
    rows = [(i, fill(100)) for i in range(30)] + [(100, f"{fill(30)} {text} {fill(30)}"), (101, f"{fill(30)} {cut} {fill(30)}")]
    last = set(text.split()[-4:]) <= set(cut.split())
    number = spark.createDataFrame([(1, text, 5)], "item_id long, text string, answer int")
    assert {r.doc_id for r in decontamination.leaks(docs(rows), number).collect()} == ({100, 101} if last else {100})
    kept = [w for w in text.split() if w in cut.split()]
    named = spark.createDataFrame([(1, text, " ".join(kept[:2]))], "item_id long, text string, answer string")
    assert {r.doc_id for r in decontamination.leaks(docs(rows), named, answer_col="answer").collect()} == {100, 101}


# ------------------------------------------------------------------ quality classifier: names instead of buckets, dicts instead of arrays


def grams(text):
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
    low = [t.lower() for t in tokens]
    shapes = []
    for i, t in enumerate(tokens):
        s = ("A" if len(t) > 1 and t.isupper() else "Aa" if t[0].isupper() else "a") if t.isalpha() else "9" if t.isdecimal() else t[:4]
        shapes.append("=" if i and low[i] == low[i - 1] else "==" if i > 1 and low[i] == low[i - 2] and t.isalpha() else s)
    out = {("w", w) for w in low} | {("b", *p) for p in zip(low, low[1:], strict=False)}
    for n in (1, 2, 3):
        for run, times in Counter(zip(*(shapes[k:] for k in range(n)), strict=False)).items():
            out.add(("s", *run))
            out |= {("s", k, *run) for k in range(1, 8) if times * 2**k >= len(tokens)}
    return out


def plain_machine(rows, y):
    """Weights by name (of indicators times ratio), squared ratios, bias."""
    n = classifier.BUCKETS
    up, down = (Counter(g for r, s in zip(rows, y, strict=True) if s == side for g in r) for side in (1, -1))
    total = [n + sum(c.values()) for c in (up, down)]
    ratio = defaultdict(lambda: math.log(1 / total[0]) - math.log(1 / total[1]))
    ratio |= {g: math.log((1 + up[g]) / total[0]) - math.log((1 + down[g]) / total[1]) for g in up | down}
    w, bias, alpha = defaultdict(float), 0.0, [0.0] * len(y)
    norms = [math.sqrt(sum(ratio[g] ** 2 for g in r)) or 1.0 for r in rows]
    order, shuffle = np.arange(len(y)), np.random.default_rng(7)
    for _ in range(classifier.EPOCHS):
        shuffle.shuffle(order)
        for i in order:
            v = {g: ratio[g] / norms[i] for g in rows[i]}
            gradient = y[i] * (sum(w[g] * x for g, x in v.items()) + bias) - 1
            new = min(max(alpha[i] - gradient / (sum(x * x for x in v.values()) + 1), 0), len(y) / (2 * y.count(y[i])))
            for g, x in v.items():
                w[g] += (new - alpha[i]) * y[i] * x
            bias += (new - alpha[i]) * y[i]
            alpha[i] = new

    def margin(r):
        norm = math.sqrt(sum(ratio[g] ** 2 for g in r))
        return bias + (sum(w[g] * ratio[g] for g in r) / norm if norm else 0.0)

    return margin


def test_classifier_equals_plain_python(spark, docs):
    rng = random.Random(15)
    good = lambda: " ".join(rng.choice(["the", "river", "Ran"]) for _ in range(rng.randint(3, 6)))
    bad = lambda: " ".join(rng.choice(["BUY", "river", "7!"]) for _ in range(rng.randint(3, 6)))
    table = [(i, good() if i % 3 else bad()) for i in range(60)] + [(100, None), (101, ""), (102, "unseen"), (103, "the river " * 4000)]
    labels = [(i, int(i % 3 > 0) if i % 11 else int(i % 3 == 0)) for i in range(60)]
    every = {g for _, t in table for g in grams(t)}
    assert all(len(grams(t)) == len(classifier.features(t)) for _, t in table)
    assert len({int(b) for _, t in table for b in classifier.features(t)}) == len(every)  # no two names fall into one bucket here

    taught = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    text = dict(table)
    rows, y = [grams(text[i]) for i, _ in taught], [1 if v else -1 for _, v in taught]
    fold, place = [], Counter()
    for s in y:
        fold.append(place[s] % classifier.FOLDS)
        place[s] += 1
    margins = [0.0] * len(y)
    for k in range(classifier.FOLDS):
        other = plain_machine([r for r, f in zip(rows, fold, strict=True) if f != k], [s for s, f in zip(y, fold, strict=True) if f != k])
        margins = [other(r) if f == k else m for r, f, m in zip(rows, fold, margins, strict=True)]
    up, down = y.count(1), y.count(-1)
    target = [(up + 1) / (up + 2) if s > 0 else 1 / (down + 2) for s in y]
    slope, offset = 1.0, 0.0
    for _ in range(20_000):  # plain gradient descent where the operator takes Newton steps
        p = [1 / (1 + math.exp(-slope * m - offset)) for m in margins]
        slope -= 0.05 * sum((a - t) * m for a, t, m in zip(p, target, margins, strict=True))
        offset -= 0.05 * sum(a - t for a, t in zip(p, target, strict=True))
    machine = plain_machine(rows, y)
    got = classifier.score(docs(table), spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(table)
    for r in got:
        expected = 1 / (1 + math.exp(-slope * machine(grams(text[r.doc_id])) - offset))
        assert abs(r.score - expected) < 2e-3 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_classifier_repeats(spark, docs):
    rows = [(i, "good words here" if i % 2 else "BAD !!! 77") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (2, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    doubled = [*rows, *rows, (1, "BAD !!! 77"), (None, "good words here"), (None, "good words here")]
    once = {(r.doc_id, r.score) for r in classifier.score(docs(doubled), labels).collect()}
    again = classifier.score(docs(doubled[::-1]), labels).collect()
    assert len(again) == len(doubled) and {(r.doc_id, r.score) for r in again} == once
    assert {r.score for r in classifier.score(docs(rows), labels.limit(0)).collect()} == {0.5}
    assert classifier.score(docs([]), labels).count() == 0


# ------------------------------------------------------------------ near duplicates: recall on a whole table


def test_near_dedup_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    sets, holders = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
        for x in sets[i]:
            holders[x].append(i)
    both = Counter((i, j) for h in holders.values() for i in h for j in h if i < j)
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), n in both.items():
        if 100 * n >= 80 * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    got = near_dedup.groups(table, shingle=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), top(i)) for i, _ in rows}
