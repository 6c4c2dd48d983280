import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing, token_count, token_file
from palimpsest.llm.bpe import ByteCounter, WordEncoder, byte_level, safe
from palimpsest.llm.common import shared_dir
from palimpsest.llm.elias_fano import EliasFano

files = pytest.importorskip("public_tokenizers")
WORDS = files.path("word_bpe_49k.json")
BYTES = files.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello, world's end.", "<|endoftext|> a<|startoftext|>b", "Σας İ ﬁ é", "中文 🙂\x1c x", "  a\n\n\tb ", "word " * 3000, "x" * 5000]


def ids(text):
    return WordEncoder(WORDS).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2100), max_size=30))
def test_encoders_equal_the_library(text):
    e, c = WordEncoder(WORDS), ByteCounter(BYTES)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == ids(text)
    assert c.count(text) == len(c.library.encode(text, add_special_tokens=False).ids)


def test_merges_of_letters_equal_the_library():
    e, rng = WordEncoder(WORDS), random.Random(3)
    stems = [v.removesuffix("</w>") for v in e.library.get_vocab()]
    stems = [v for v in stems if v.isascii() and v.isalpha() and v.islower()]
    letters = "abcdefghijklmnopqrstuvwxyzéèüñßçœ"
    words = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 16))) for _ in range(4000)]
    for w in words:
        assert np.frombuffer(e._piece(w), e.dtype).tolist() == [t.id for t in e.library.model.tokenize(byte_level(w))]


def test_safe_text_has_no_special_strings():
    assert safe("plain été — text") and not safe("<|endoftext|>") and not safe("a\x1cb") and not safe("½")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    coded = EliasFano(EliasFano.encode(values))
    assert coded.values().tolist() == values
    for i in {0, 1, 255, 256, 257, len(values) - 1} & set(range(len(values))):
        assert coded.select(i) == values[i]


def test_token_counts(docs):
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (1, "again")]
    got = token_count.count_tokens(docs(rows), BYTES).collect()
    expected = [(i, len((t or "").encode()), ByteCounter(BYTES).count(t)) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, expected))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_count.count_tokens(docs([]), BYTES).count() == 0


def test_token_files(spark, docs):
    rows = [(i * 3 - 4, t) for i, t in enumerate(TEXTS)] + [(None, "n"), (None, "n"), (1000, "dup"), (1000, "dup")]
    folder = shared_dir(spark, "test")
    got = token_file.read(spark, token_file.write(docs(rows).repartition(3), folder, WORDS), folder).collect()
    assert len(got) == len(rows)
    at = 0
    texts = dict(rows)
    for r in sorted(got, key=lambda r: r.start):
        x = [*ids(texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:])
    assert token_file.read(spark, token_file.write(docs([]), folder + "x", WORDS), folder + "x").count() == 0


def test_shards_give_single_documents(spark, docs):
    folder = shared_dir(spark, "test")
    manifest = token_file.write(docs([(i, f"text number {i}") for i in range(50)]).coalesce(1), folder, WORDS).collect()
    for m in manifest:
        shard = token_file.Shard(f"{folder}/{m.file}")
        for i, doc in enumerate(shard.doc_ids()):
            assert shard.document(i).tolist() == [*ids(f"text number {doc}"), 1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(histogram):
    slots, used = packing.plan(list(histogram.items()), 64)
    bins = {}
    for length, first, last, each, sequence, offset in slots:
        for rank in range(first, last):
            step = rank - first
            bins.setdefault(sequence + step // each, []).append((offset + step % each * length, length))
    assert sum(map(len, bins.values())) == sum(histogram.values()) and len(bins) == used
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    # First-fit decreasing's bound holds for best fit too.
    assert used <= 11 / 9 * -(-sum(n * c for n, c in histogram.items()) // 64) + sum(n > 32 for n in histogram for _ in range(histogram[n])) + 1


@pytest.mark.parametrize("size", [2048, 16])
def test_packing(docs, size):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"some words {i}") for i in range(60)]
    got = packing.pack(docs(rows), WORDS, size=size).collect()
    texts, own = dict(rows), {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        x, at = [*ids(t), 0], 0
        for k, r in enumerate(sorted(own[i], key=lambda r: r.piece)):
            part = x[at : at + size]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += size
        assert at >= len(x)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(docs([]), WORDS).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=1500), st.integers(0, 1500), st.integers(0, 1500))
def test_elias_fano_blocks(values, i, j):
    values = sorted(values)
    coded = EliasFano(EliasFano.encode(values))
    assert coded.values(i, j).tolist() == values[i:j] and coded.values().tolist() == values


def test_one_id_fills_several_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(token_file, "READ_DOCS", 7)
    rows = [(None, f"text {i % 3}") for i in range(200)] + [(5, f"other {i}") for i in range(200)] + [(i, "x y z") for i in range(6, 60)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = shared_dir(spark, "test")
        manifest = token_file.write(docs(rows), folder, WORDS)
        got = token_file.read(spark, manifest, folder).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 2 and max(m.n_docs for m in shards) < 200
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known == [None] * 200 + [5] * 200 + list(range(6, 60))
    sums = lambda t: (len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 1], "<u4").tobytes()))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(sums(t) for _, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("part", [4096, 3])
def test_packing_repeats(docs, monkeypatch, part):
    monkeypatch.setattr(packing, "RANK_ROWS", part)
    rows = [(None, "a b")] * 40 + [(1, "a b")] * 40 + [(2, None), (2, None), (3, "word " * 5000), (3, "word " * 5000)]
    got = packing.pack(docs(rows), WORDS).collect()
    assert sum(r.doc_id is None for r in got) == 40 and sum(r.doc_id == 1 for r in got) == 40 and sum(r.doc_id == 2 for r in got) == 2
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
    assert len(seqs) == 6  # 4 full pieces, and 2052 tokens in others
