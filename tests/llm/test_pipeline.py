"""The pipeline against brute force, stage by stage, on a small corpus."""

import random
import re
import zlib

import pytest

from palimpsest.llm import quality_classifier as classifier

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, prose(30)) for i in range(8)]
    docs = [(i, prose(rng.randint(40, 120))) for i in range(80)]
    docs += [(100 + i, " ".join(f"{word()}### {word()}&&&" for _ in range(40))) for i in range(40)]
    docs += [(200 + i, docs[i][1]) for i in range(10)]
    docs += [(300 + i, docs[20 + i][1].replace(" ", " extra ", 1)) for i in range(10)]
    docs += [(400 + i, f"{prose(50)} {t} {prose(50)}") for i, t in items]
    docs += [(500, "too short"), (501, None), (502, ""), (503, "again and again " * 40), (504, prose(6000))]
    labels = [(i, 1) for i in range(80)] + [(100 + i, 0) for i in range(40)]
    return docs, items, labels


def expected(docs, items, labels):
    def clean(text):
        w = WORD.findall(text or "")
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    rows = {i: t for i, t in docs if clean(t)}
    taught = sorted((i, y) for i, y in labels if i in rows and zlib.crc32(str(i).encode()) % 5)
    model = classifier.fit([classifier.features(rows[i]) for i, _ in taught], [y for _, y in taught])
    rows = {i: t for i, t in rows.items() if model.score(t) >= 0.3}

    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, first = {i: shingles(t) for i, t in rows.items()}, {}
    for i in sorted(sets):
        first[i] = min([first[j] for j in first if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], default=i)
    rows = {i: t for i, t in rows.items() if first[i] == i}
    return {i for i, t in rows.items() if not any(text in t for _, text in items)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    tables = {
        "documents": ([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (items, "item_id long, text string"), "labels": ([(*x, 0) for x in labels], "doc_id long, quality int, toxic int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    keep = expected(docs, items, labels)
    assert {r.doc_id for r in got} == keep and 60 < len(keep) < 90
    assert sum(r.piece > 0 for r in got if r.doc_id == 504) > 0
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    _, items, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
