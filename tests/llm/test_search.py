import gzip
import os
import random
import re

import pytest

from palimpsest.llm import components, decontamination, license_scan, near_dedup, url_filter, warc
from palimpsest.llm.common import shared_dir


def shingles(text, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows, n=2):
    sets, up = {i: shingles(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_corpus():
    rng, rows = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    for g in range(6):
        base = [word() for _ in range(90)]
        for k in range(25):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(90)] = word()
            rows.append((g * 100 + k, " ".join(copy).title() if k % 2 else " ".join(copy)))
    return rows + [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE"), (9004, "\t \n"), (9005, "one two"), (9006, "x " * 9000)]


def test_near_dedup_equals_brute_force(docs):
    rows = near_corpus()
    expected = brute_groups(rows)
    got = {r.doc_id: r for r in near_dedup.groups(docs(rows), shingle=2).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_dedup_edges(docs):
    table = docs([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a b c"), (2, "a b c"), (None, "x y z"), (None, "x y z"), (None, "x  y z"), (None, ""), (7, None), (7, "")])
    got = near_dedup.groups(table, shingle=2).collect()
    found = [("2", "2", True)] * 2 + [("4", "2", False)] * 2 + [("7", "7", True)] * 2 + [("None", "2", False)] * 2 + [("None", "None", True)] * 4
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == found
    assert near_dedup.groups(docs([]), shingle=2).count() == 0
    kept = near_dedup.keep(table, shingle=2)
    assert kept.columns == table.columns and sorted(str((r.doc_id, (r.text or "").split())) for r in kept.collect()) == ["(2, ['a', 'b', 'c'])", "(7, [])", "(None, ['x', 'y', 'z'])", "(None, [])"]


def test_ids_with_several_texts_are_one_node(docs):
    a, b, c = ("one two three four", "five six seven eight", "nine ten eleven twelve")
    table = docs([(2, a), (4, a), (4, b), (7, b), (7, c), (9, c), (10, "none of these")])
    got = near_dedup.groups(table, shingle=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (4, 2, False), (4, 2, False), (7, 2, False), (7, 2, False), (9, 2, False), (10, 10, True)]
    assert sorted(r.doc_id for r in near_dedup.keep(table, shingle=2).collect()) == [2, 10]
    several = docs([(2, a), (2, b), (2, a), (3, b)])
    assert [r.doc_id for r in near_dedup.keep(several, shingle=2).collect()] == [2]


def _union_find(edges):
    up = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            x = y
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("kind", ["chain", "descending", "shuffled chain", "star", "random", "grid"])
def test_components(spark, monkeypatch, kind):
    rng = random.Random(5)
    order = list(range(2000))
    if kind == "shuffled chain":
        rng.shuffle(order)
    edges = list(zip(order, order[1:], strict=False))
    if kind == "descending":
        edges = [(b, a) for a, b in edges]
    elif kind == "star":
        edges = [(1000, i) for i in range(2000) if i != 1000]
    elif kind == "random":
        edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)]
        edges = [e for e in edges if e[0] != e[1]] + edges[:5] + [(7, 7)]
    elif kind == "grid":
        edges = [(i, i + 1) for i in range(1600) if i % 40 != 39] + [(i, i + 40) for i in range(1560)]
    rounds, cut = [], components.common.cut
    monkeypatch.setattr(components.common, "cut", lambda df, folder, name, rows=None: rounds.append(name) or cut(df, folder, name, rows))
    got = components.components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark, "components"), kind.replace(" ", "-"))
    expected = _union_find(e for e in edges if e[0] != e[1])
    assert {r.node: r.comp for r in got.collect()} == expected
    doublings = [r for r in rounds if re.search(r"-up-\d+-\d+$", r)]
    assert len(doublings) <= {"chain": 12, "descending": 12, "star": 3}.get(kind, 40)


def test_estimates_are_near_the_truth(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        k = int(2000 * 2 * share / (1 + share))
        m = near_dedup.minima([pool[:2000], np.concatenate([pool[:k], pool[2000 : 4000 - k]])])
        row = spark.createDataFrame([tuple(x.tolist() for x in near_dedup.planes(m))], "a array<long>, b array<long>")
        s = row.select(near_dedup.estimate(row.a, row.b).alias("s")).first().s
        assert abs(s - share) < near_dedup.MARGIN / 1.5


def benchmark_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, fill(200)) for i in range(40)]
    docs += [(100 + i, f"{fill(77 + 3 * i)} {t.upper()}. {fill(50)}") for i, t in items]
    changed = [(i, t.split()) for i, t in items[:4]]
    docs += [(200 + i, fill(20) + " " + " ".join(w if k % 4 else word() for k, w in enumerate(t[:-4])) + " " + " ".join(t[-4:])) for i, t in changed]
    return items, docs


def test_leaks(spark, docs):
    items, rows = benchmark_rows()
    table = docs([*rows, (None, None), (300, ""), (301, "short")])
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (None, "x y")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, benchmark).collect()}
    assert found == {(100 + i, i) for i, _ in items} | {(200 + i, i) for i in range(4)}
    kept = decontamination.keep(table, benchmark)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(range(40)) | {None, 300, 301}
    assert decontamination.leaks(docs([]), benchmark).count() == 0
    assert decontamination.leaks(table, benchmark.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(table[-1][j] + 1 if x == y else max(row[-1], table[-1][j + 1]))
            table.append(row)
        assert decontamination.lcs(decontamination._masks(a), len(a), b) == table[-1][-1]


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    bad = any(w in url_filter.BLOCKED_WORDS for w in host.replace("-", ".").split("."))
    rule = max(fits)[1:] if fits else (None, "block" if bad else "allow")
    return host, path, *rule


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://net", "http://net/", "http://xnet/", "http://a.net?x=/", "http://u@example.com:80/de/", "ftp://example.com/de/a", "http://www.casino-win.com/",
        "http://casinos.com", "http://spam.org/fr/x", "http://x.org/FR/", "http://free-bets.example.net/en", "a://b://c.net/", "http://é.net/ü", "http://example.net/en/" + "x" * 9000]


def test_url_rules(spark):
    rows = [(i, u, "rule") for i, u in enumerate(URLS)] + [(None, "http://net/", "r"), (1, "", "dup"), (1, "", "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = [url_filter.list_rule(*r) for r in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))] + url_filter.default_patterns()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *url_brute(u))) for i, u, _ in rows)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_many_rules_go_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 1)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = [url_filter.list_rule(*r) for r in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))] + url_filter.default_patterns()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: url_brute(u) for i, u in enumerate(URLS)}


def test_archives(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (5, "http://c/", ""), (7, "http://é\n/", "é" * 50000), (None, "http://n/", "same"), (1, "http://b/", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folder = shared_dir(spark, "warc")
    assert sum(r.n_records for r in warc.write(pages, folder).collect()) == 7
    records = warc.read(spark, folder)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.page_records(records).collect()}
    d = lambda s: warc.digest(s.encode())
    same, none = (4, d("same")), (0, d(""))
    assert got == {(3, "revisit", 1, *same), (1, "response", None, *same), (2, "response", None, *none), (5, "revisit", 2, *none), (7, "response", None, 100000, d("é" * 50000)), (None, "revisit", 1, *same)}
    full = {r.record_id: r.payload for r in records.filter("record_type = 'response'").collect()}
    assert bytes(full["urn:page:7"]).decode() == "é" * 50000 and bytes(full["urn:page:1"]) == b"same"
    assert {r.record_id for r in warc.read(spark, folder, payload=False).filter("target_uri IN ('http://a/', 'http://c/')").collect()} == {"urn:page:3", "urn:page:5"}
    empty = shared_dir(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_filters_are_pushed_to_the_reader():
    reader = warc.WarcReader("x", True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert reader.wanted == {"record_type": {"response"}} and len(left) == 1


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    prose = "The river ran on.\nNothing of note was seen.\n"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x.txt", prose), (3, "a/b/y.txt", prose + apache + "\n" + prose), (4, "a/b/c/COPYING", apache), (5, "a/b/c/d/e.txt", prose), (6, "other/z.txt", prose),
        (7, None, None), (8, "a/b/q.txt", ""), (9, "top.txt", prose * 3000), (2, "a/b/x.txt", prose),
    ]
    files = spark.createDataFrame([(*r, "L") for r in rows], "doc_id long, path string, text string, license string")
    got = sorted((r.doc_id, r.license, r.inherited_from) for r in license_scan.scan(files).collect())
    assert got == [(1, "MIT", None), (2, "MIT", "a"), (2, "MIT", "a"), (3, "Apache-2.0", None), (4, "Apache-2.0", None), (5, "Apache-2.0", "a/b/c"), (6, None, None), (7, None, None), (8, "MIT", "a"), (9, None, None)]
    assert license_scan.scan(files.limit(0)).count() == 0


def test_blocks_find_what_pairs_find(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BIG", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "REST", 0)
    rows = near_corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs(rows), shingle=2).collect()}
    assert got == brute_groups(rows)


def test_frequent_leaks(spark, docs):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(7))
    fill = lambda n: " ".join(word() for _ in range(n))
    usual = [word() for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(usual) if rng.random() < 0.7 else word() for _ in range(n))
    copied, quoted, changed, common = fill(30), fill(30), fill(30), " ".join(rng.choice(usual) for _ in range(20))
    paraphrase = " ".join(w if k % 4 else word() for k, w in enumerate(changed.split()[:-4])) + " " + " ".join(changed.split()[-4:])
    one, two = f"{prose(60)} {copied} {prose(60)}", f"{prose(60)} {paraphrase} {prose(60)}"
    rows = [(i, prose(150)) for i in range(100)] + [(1000 + i, one) for i in range(60)] + [(1100 + i, two) for i in range(30)]
    rows += [(2000 + i, f"{prose(45 + i)} {quoted} {prose(30)}") for i in range(20)] + [(3000 + i, f"{prose(70 + 9 * i)} {common} {prose(30)}") for i in range(4)]
    benchmark = spark.createDataFrame([(0, copied), (1, quoted), (2, changed), (3, common)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(rows), benchmark).collect()}
    asked = {1: 0, 2: 1, 3: 3}
    assert found == {(i, 2 if 1100 <= i < 2000 else asked[i // 1000]) for i, _ in rows if i > 999}


def test_verbatim_items_of_every_length(spark, docs):
    rng = random.Random(33)
    words = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(400)]
    share = [1 / (k + 3) for k in range(400)]
    fill = lambda n: rng.choices(words, share, k=n)
    items = [(n, fill(n)) for n in range(3, 65)]
    rows = [(n * 10 + k, " ".join(fill(rng.randrange(40, 140)) + t + fill(90))) for n, t in items for k in range(3)] + [(10000 + i, " ".join(fill(200))) for i in range(100)]
    rows += [(20000 + n, " ".join(w for x in t for w in (x, "other"))) for n, t in items[:5]]
    benchmark = spark.createDataFrame([(n, " ".join(t)) for n, t in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(rows), benchmark).collect()}
    whole = {(i, n) for i, text in rows for n, t in items if f" {' '.join(t)} " in f" {text} "}
    assert whole <= found and {(n * 10 + k, n) for n, _ in items for k in range(3)} <= whole
    assert {x for x in found if x[1] < 8} == {x for x in whole if x[1] < 8}
    assert not {x for x in found if 10000 <= x[0] and x[1] > 15} - whole


def test_rows_without_an_id_of_their_own(spark, docs):
    items, rows = benchmark_rows()
    leak = rows[40][1]
    table = docs([*rows, (None, leak), (None, rows[0][1]), (None, None), (5, leak), (100, rows[1][1])])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, benchmark).collect()}
    assert {(None, 0), (5, 0), (100, 0)} <= found
    kept = [(r.doc_id, r.text) for r in decontamination.keep(table, benchmark).collect()]
    assert sorted(kept, key=str) == sorted([*rows[:40], (None, rows[0][1]), (None, None), (100, rows[1][1])], key=str)


def _foreign(spark, name, data):
    """Records of one file that something else wrote."""
    folder = shared_dir(spark, "foreign")
    path = folder.removeprefix("file://")
    os.makedirs(path)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data)
    return folder


def _record(block, kind="response", content="application/http;msgtype=response", n=None, ident="1"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{ident}>\r\nContent-Type: {content}\r\nContent-Length: {len(block) if n is None else n}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    bodies = [
        _record(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 999\r\n\r\nbody \r\n\r\n of it", ident="a"),
        _record(b"HTTP/1.1 200 OK\r\nno end of headers", ident="b"),
        _record(b"", ident="c"),
        _record(b"plain text", "resource", "text/plain", ident="d"),
        _record(b"HTTP/1.1 200 OK\r\nContent-Length: -4\r\n\r\n", "revisit", ident="e"),
        _record(b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n", "revisit", ident="f"),
        _record(b"k: v\r\n", "warcinfo", "application/warc-fields", ident="g"),
        _record(b"z" * 700_000, "resource", "image/png", ident="h"),
    ]
    expected = {"a": (15, b"body \r\n\r\n of it"), "b": (34, b"HTTP/1.1 200 OK\r\nno end of headers"), "c": (0, b""), "d": (10, b"plain text"), "e": (None, None), "f": (12, None), "g": (6, b"k: v\r\n"), "h": (700_000, b"z" * 700_000)}
    for name, data in (("a.warc", b"".join(bodies)), ("a.warc.gz", b"".join(map(gzip.compress, bodies))), ("a.warc", gzip.compress(b"".join(bodies)))):
        folder = _foreign(spark, name, data)
        got = {r.record_id[-1]: (r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read(spark, folder).collect()}
        got["c"] = (got["c"][0], b"")
        assert got == expected
        slim = {r.record_id[-1]: r.payload_bytes for r in warc.read(spark, folder, payload=False).filter("record_type IN ('resource', 'revisit')").collect()}
        assert slim == {"d": 10, "e": None, "f": 12, "h": 700_000}


def test_broken_archives(spark):
    good, packed = _record(b"whole", "resource", "text/plain", ident="a"), gzip.compress(_record(b"whole", "resource", "text/plain", ident="a"))
    cases = [good + _record(b"cut", n=5000), good + b"WARC/1.0\r\nWARC-Type: x", good + _record(b"", n="many"), packed + packed[:-12], packed + b"not gzip"]
    for data in cases:
        folder = _foreign(spark, "x.warc", data)
        assert [r.record_id for r in warc.read(spark, folder, broken="skip").collect()][:1] == ["urn:x:a"]
        with pytest.raises(Exception, match=r"x\.warc"):
            warc.read(spark, folder).collect()


def test_licences_of_repeated_rows(spark):
    mit, apache = "Released under the MIT License, with some more words to it.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "d/a", mit)] * 8 + [(2, "d/b", mit), (3, "d/c", mit), (3, "d/c", apache), (None, None, mit), (None, None, apache), (4, "d/d", mit)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = license_scan.scan(files).collect()
    assert len(got) == len(rows) and len({r.similarity for r in got if r.license == "MIT"}) == 1
    assert sorted(str(r.license) for r in got if r.doc_id == 3) == sorted(str(r.license) for r in got if r.doc_id is None) == ["Apache-2.0", "MIT"]


def test_versions_and_whole_licences(spark):
    texts = dict(license_scan.TEXTS)
    rows = [
        (1, "a.txt", "Licensed under the GNU General Public License, version 2."), (2, "b.txt", "Licensed under the GNU General Public License, version 3."),
        (3, "x/LICENSE", "Copyright 2020 A. Person\n\n" + texts["BSD-2-Clause"]), (4, "y/COPYING.txt", texts["ISC"].replace(" ", "\n", 40)), (5, "z/prose.txt", texts["ISC"]),
        (6, "lib.txt", "This library is licensed under the GNU Lesser General Public License, version 2.1."), (7, "old.txt", "Licensed under the Apache License, Version 1.1."),
    ]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: "GPL-2.0", 2: "GPL-3.0", 3: "BSD-2-Clause", 4: "ISC", 5: None, 6: "LGPL-2.1", 7: None}


def test_literals_of_expressions():
    cases = {
        r"/ads/": ("ads",), r"^[^/]*\.example\.com/de/": ("com", "de", "example"), r"casino\d+": (), r"/casino\d+/x/": ("x",), r"/(?:a1|b2)/c": (), r"/(?:a1/x|b2/x)/": (),
        r"/(?:/a1/x/|/b2/x/)": ("x",), r"(?:/foo/)?bar/": (), r"(?:/foo/)+bar-": ("foo",), r"[./]foo(?=[/?]|$)": ("foo",), r"[./]foo(?!x)": (), r"\bfoo\b": (), r"/FOO/": ("foo",), r"^foo$": ("foo",),
        r"/fo[o0]/": (), r"(": (), r"/a{2}/": (), r"(?x) / foo /": (), r"/(?P<n>foo)/": ("foo",), r"/foo*/": (), r"/\u00e9foo/": (), r"[\s/]foo/": (),
    }
    assert {r: url_filter.literals(r) for r in cases} == cases


def test_ten_thousand_rules(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    shapes = [lambda a, b: rf"/{a}/{b}[./]", lambda a, b: rf"[.\-]{a}\.(?:com|net)/(?:x/)?{b}/", lambda a, b: rf"{a}\d/{b}", lambda a, b: rf"/(?:{a}|{b})$", lambda a, b: rf"\.{a}/.*-{b}$"]
    rules = [url_filter.Rule(f"r{i:05d}", "block", rng.choice(shapes)(rng.choice(words), rng.choice(words)), 0, i % 7) for i in range(10_000)]
    urls = []
    for i in range(300):
        parts = [rng.choice(words) for _ in range(4)]
        urls.append((i, f"http://{parts[0]}.{rng.choice(['com', 'net', 'org'])}/{parts[1]}/{parts[2]}" + rng.choice(["/", ".html", f"-{parts[3]}", "7/" + parts[3]])))
        if i % 3 == 0:  # one that a rule fits
            m = re.findall(r"w\d+", rules[i * 7].regex)
            urls.append((1000 + i, f"http://a.{m[0]}.com/x/{m[0]}/{m[1]}/y-{m[1]}"))
    compiled = [(r.length, r.name, re.compile(r.regex)) for r in rules]
    expected = {}
    for i, u in urls:
        rest = u.split("://")[1]
        expected[i] = max(((n, name) for n, name, r in compiled if r.search("." + rest)), default=(0, None))[1]
    rows = [(r.name, r.verdict, r.regex, list(url_filter.literals(r.regex)) or [""], r.rank, r.length) for r in rules]
    table = spark.createDataFrame(rows, "name string, verdict string, regex string, tokens array<string>, rank int, length int")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    for limit in (50_000, 10):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        assert {r.page_id: r.pattern for r in url_filter.judge(pages, table).collect()} == expected
    assert sum(v is not None for v in expected.values()) > 50
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
