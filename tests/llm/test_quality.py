import re
import zlib

from palimpsest.llm import quality_classifier as classifier
from palimpsest.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "w " * 8, "w " * 9, "a b c d e f g h " * 3 + "tail", "x\ny\nx \nx\n\n", "#|é 🙂\x85z\xa0q", " ".join(map(str, range(500))) * 2]


def test_measures_equal_brute_force():
    for text in TEXTS:
        assert rules.measure(text) == brute(text)


def test_score(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id " * 30), (3, "twice")]
    got = rules.score(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.score(docs([])).count() == 0


def test_a_bad_host_goes_and_a_good_one_stays(docs):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "short") for i in range(30)] + [(100 + i, good) for i in range(30)] + [(500, good), (501, good)]
    host = {i: "bad" for i in range(30)} | {500: "bad", 501: None}
    table = docs(rows, source=host)
    kept = {r.doc_id for r in rules.score(table).collect() if r.kept}
    assert kept == {100 + i for i in range(30)} | {501}
    left = rules.keep(table)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == kept


def test_prior_is_the_overall_rate_where_hosts_agree():
    a, b = rules.prior(4, 400, 40, 4 * 100**2, 4 * 10 * 10 / 100)
    assert abs(a / (a + b) - 0.1) < 1e-9 and a + b > 1000


def corpus():
    clean = [(i, f"The {i} quiet rivers ran past stone and field number {i * 7}, and all of it was calm.") for i in range(60)]
    junk = [(1000 + i, f"BUY!! NOW!! {i} CHEAP!! CHEAP!! CLICK!! HERE!! {i}") for i in range(60)]
    return clean, junk


def test_classifier_on_held_out_rows(spark, docs):
    clean, junk = corpus()
    labels = spark.createDataFrame([(i, 1) for i, _ in clean] + [(i, 0) for i, _ in junk] + [(None, 1), (5, None)], "doc_id long, quality int")
    table = docs([*clean, *junk, (9000, None), (9001, ""), (None, "calm fields")])
    got = {r.doc_id: r for r in classifier.score(table, labels).collect()}
    assert len(got) == 123
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if i is not None:
            assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i].predicted == 1 for i, _ in clean) and all(got[i].predicted == 0 for i, _ in junk)
    kept = classifier.keep(table, labels)
    assert kept.columns == table.columns
    assert classifier.score(docs([]), labels).count() == 0


def test_held_out_labels_teach_nothing(spark, docs):
    clean, junk = corpus()
    held = [i for i, _ in clean + junk if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(i, int(i < 1000)) for i, _ in clean + junk]
    wrong = [(i, 1 - y if i in held else y) for i, y in right]
    table = docs(clean + junk)
    scores = [sorted((r.doc_id, r.score) for r in classifier.score(table, spark.createDataFrame(y, "doc_id long, quality int")).collect()) for y in (right, wrong)]
    assert scores[0] == scores[1]


def test_one_class_gives_even_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in classifier.score(docs([(1, "a"), (2, "b")]), labels).collect()} == {0.5}
