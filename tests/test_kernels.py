"""Kernels against known answers and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions.options import DEFAULTS, CompareOptions
from palimpsest.functions.tokens import block_sig, dice, is_blank, normalize, split_words, tokenize, word_bag
from palimpsest.model import Block, Cell, Fmt, ListInfo, Obj, Row, Span, dumps, loads, merge_spans, para
from palimpsest.operators import changes, proof
from palimpsest.operators.compare import compare_blocks, compare_tables
from palimpsest.operators.inline import diff_blocks
from palimpsest.operators.merge import adopted, replaced, spliced, spliced_table
from palimpsest.operators.review import block_stream, find_text
from palimpsest.operators.sequence import DEL, EQ, INS, edit_runs, pair_up, regions


def generator(seed):
    """The linear congruential generator of the published properties."""
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) % 2**32
        yield state / 2**32


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_edit_scripts_are_valid_and_shortest():
    g = generator(42)
    draw = lambda: [1 + int(next(g) * 6) for _ in range(int(next(g) * 40))]
    for _ in range(400):
        a, b = draw(), draw()
        i = j = equal = 0
        for op, n in edit_runs(a, b):
            if op == EQ:
                assert a[i : i + n] == b[j : j + n]
                equal += n
            i, j = i + n * (op != INS), j + n * (op != DEL)
        assert (i, j, equal) == (len(a), len(b), lcs_length(a, b))


def test_one_against_one():
    assert edit_runs([1], [2]) == [(DEL, 1), (INS, 1)] and edit_runs([], [1]) == [(INS, 1)] and edit_runs([], []) == []
    assert regions(edit_runs([1, 2, 3], [1, 3])) == [(True, 0, 1, 0, 1), (False, 1, 2, 1, 1), (True, 2, 3, 1, 2)]


def test_pairing_prefers_similarity_then_place():
    always = lambda i, j: True
    assert pair_up(2, 3, lambda i, j: 0.9 if (i, j) == (1, 1) else 0.0, always) == [(0, 0), (1, 1), (None, 2)]
    assert pair_up(2, 1, lambda i, j: 0.39, always) == [(0, None), (1, None), (None, 0)]
    assert pair_up(1, 1, lambda i, j: 1.0, lambda i, j: False) == [(0, None), (None, 0)]


def test_tokens():
    assert split_words("don't stop - 3 cafés") == ["don't", " ", "stop", " ", "-", " ", "3", " ", "cafés"]
    assert split_words("漢字かな and") == ["漢", "字", "か", "な", " ", "and"]
    assert normalize("é", DEFAULTS) == "é" and normalize(" ", DEFAULTS) == " "
    assert normalize("“x…”", CompareOptions(normalize_punctuation=True)) == '"x..."'
    t = tokenize([Span("he"), Span("llo", Fmt(b=True)), Span(" x")], DEFAULTS)
    assert [x.key for x in t.all] == ["hello\0:2,b:3", " ", "x\0"] and t.all[0].pieces == [(0, 0, 2), (1, 0, 3)]
    t = tokenize([Span("  a  ")], CompareOptions(ignore_whitespace=True))
    assert t.keys == ["a\0"] and len(t.all) == 3
    note = Span("￼", Fmt(sup=True), Obj("footnote", "see here"))
    assert tokenize([note], DEFAULTS).all[0].key == "￼footnote:see here\0"


TEXT = st.text(alphabet=st.sampled_from("ab ·é ́­-'“…\n漢A"), max_size=8)


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.booleans(), st.booleans(), st.booleans())
def test_signatures_of_plain_text_are_equal_just_when_their_keys_are(a, b, case, space, punctuation):
    o = CompareOptions(ignore_case=case, ignore_whitespace=space, normalize_punctuation=punctuation)
    same = tokenize([Span(a)], o).keys == tokenize([Span(b)], o).keys
    assert (block_sig(para(a), o) == block_sig(para(b), o)) == same


def test_blank_blocks():
    assert is_blank(para(" ​")) and is_blank(Block(spans=[Span("￼", obj=Obj("pagebreak", ""))])) and not is_blank(para("a"))
    assert not is_blank(Block("table"))


def test_four_blocks():
    left = [para("Title", role="h", level=1), para("The quick brown fox"), para("Gone for good"), para("Same")]
    right = [para("Title", role="h", level=1), para("The quick red fox"), para("Same"), para("Brand new")]
    assert [r[0] for r in compare_blocks(left, right)] == ["eq", "mod", "del", "eq", "ins"]


def test_style_counts_and_alignment_may_not():
    a, b = [para("x", role="h", level=1)], [para("x", role="h", level=2)]
    assert [r[0] for r in compare_blocks(a, b)] == ["mod"]
    a, b = [para("x")], [para("x", align="center")]
    assert [r[0] for r in compare_blocks(a, b, CompareOptions(ignore_formatting=True))] == ["eq"]


def table(*rows):
    return Block("table", rows=[Row([Cell([para(c)]) for c in r]) for r in rows])


def test_tables():
    a, b = table(["id", "n"], ["1", "old value"], ["2", "x"]), table(["id", "n"], ["1", "new value"], ["2", "y z"])
    assert [k for k, _, _ in compare_tables(a.rows, b.rows)] == ["eq", "mod", "mod"]
    assert [r[0] for r in compare_blocks([a], [b])] == ["table"]
    assert spliced_table(a, b, True, {"1:1"}, DEFAULTS).rows[1] == a.rows[1]


def test_inline():
    d = diff_blocks([para("one two three four")], [para("one 2 3 four")], DEFAULTS)
    assert len(d.changes) == 1 and not d.changes[0].fmt_only
    d = diff_blocks([Block(spans=[Span("bold", Fmt(b=True)), Span(" text")])], [para("bold text")], DEFAULTS)
    assert [c.fmt_only for c in d.changes] == [True]
    d = diff_blocks([para("a long unchanged beginning here x and a long unchanged end")], [para("b long unchanged beginning here y and a long unchanged end")], DEFAULTS)
    assert len(d.changes) == 2


def shuffled_docs(seed, n):
    g = generator(seed)
    words = "alpha beta gamma delta epsilon zeta".split()
    line = lambda: " ".join(words[int(next(g) * 6)] for _ in range(int(next(g) * 6)))
    for _ in range(n):
        yield [para(line()) for _ in range(int(next(g) * 8))], [para(line()) for _ in range(int(next(g) * 8))]


def test_word_level_changes_converge():
    for left, right in shuffled_docs(7, 150):
        for kind, l, r, _, _ in compare_blocks(left, right):
            if kind == "mod":
                every = {c.change for c in diff_blocks([l], [r], DEFAULTS).changes}
                assert block_sig(spliced(l, r, True, every, DEFAULTS), DEFAULTS) == block_sig(l, DEFAULTS)
                assert block_sig(spliced(l, r, False, every, DEFAULTS), DEFAULTS) == block_sig(r, DEFAULTS)
                assert spliced(l, r, True, set(), DEFAULTS).spans == merge_spans(r.spans)


def test_markers_stay_when_words_are_taken():
    target = Block(spans=[Span("a "), Span(marker=True), Span("b c")])
    out = spliced(para("a x c"), target, True, {0}, DEFAULTS)
    assert sum(s.marker for s in out.spans) == 1 and "".join(s.text for s in out.spans) == "a x c"


def test_copied_items_join_lists():
    item = Block(spans=[Span("x")], list=ListInfo(True, 0, "k"))
    near = Block(spans=[Span("y")], list=ListInfo(True, 0, "other"))
    assert adopted(item, [None, near], "d").list.key == "other" and adopted(item, [None], "d").list.key == "d/k"


def test_replacing_words():
    b = Block(spans=[Span("teh ", Fmt(b=True)), Span("cat")])
    assert replaced(b, 0, 3, "the").spans == [Span("the ", Fmt(b=True)), Span("cat")]
    assert replaced(b, 4, 7, "").spans == [Span("teh ", Fmt(b=True))]


def test_summaries_and_excerpts():
    s = changes.Summary()
    s.row("mod", para("We meet on Monday at noon in the big hall"), para("We meet on Friday at noon in the big hall"), DEFAULTS)
    assert (s.minus, s.plus) == (1, 1)
    assert s.edits[0]["a"] == {"mark": "del", "before": "We meet on ", "text": "Monday", "after": " at noon in…"}
    assert s.kind([("mod", False)]) == "mod"
    s = changes.Summary()
    s.row("mod", para("x"), para("x", role="h", level=2), DEFAULTS)
    assert s.kind([("mod", False)]) == "fmt" and s.edits[0]["note"] == "Paragraph style: Normal text in A, Heading 2 in B"
    assert changes.clip("aaa bbb ccc", 8) == "aaa bbb…" and changes.clip("aaa bbb ccc", 5, end=False) == "…ccc"


def test_bags():
    o = DEFAULTS
    assert dice(word_bag([para("a b b")], o), word_bag([para("b b c")], o)) == pytest.approx(4 / 6)
    assert dice(word_bag([para("...")], o), word_bag([para("!")], o)) == 1


def test_streams_and_anchors():
    t = table(["a", ""], ["", "b"])
    assert block_stream(t) == "a\nb"
    text = "cat one. cat two. cat three."
    assert find_text(text, "cat", "one. ", " two", 0) == 9 and find_text(text, "cat", "", "", 20) == 18 and find_text(text, "dog", "", "", 0) is None


GRAMMAR = [
    ("the the cat", ["repeat:the the>the"]), ("He had had enough", []), ("a apple and an pear", ["article:a>an", "article:an>a"]), ("an hour, a unicorn, a one-off, an MRI", []),
    ("Done. next one", ["capital:next>Next"]), ("e.g. this etc. and so", []), ("so i went", ["pronoun:i>I"]), ("two  spaces", ["spaces:  > "]), ("wait , no", ["space-before: ,>,"]),
    ("one,two", ["space-after:,>, "]), ("what,, now", ["doubled:,,>,"]), ("could of been", ["could-of:could of>could have"]), ("better then that", ["than:better then>better than"]),
    ("Your welcome", ["your-welcome:Your welcome>You’re welcome"]), ("see www.a.com,b and x@y.co now", []), ("né né", []),
]


@pytest.mark.parametrize(("text", "expected"), GRAMMAR)
def test_grammar(text, expected):
    assert [f"{rule}:{part}>{fix[0]}" for rule, _, _, part, _, fix in proof.grammar(text)] == expected


def test_spelling_words():
    assert [w for _, w in proof.spelling_words("NASA sent A4b a McDonald to www.site.org mis-spelt it's x")] == ["sent", "to", "mis-spelt", "it's"]
    assert proof.suggestions("Teh", {"The"}.__contains__) == ["The"] and proof.suggestions("form", {"from"}.__contains__) == ["from"]
    assert proof.batches([5000, 2000, 4000, 9000]) == [0, 1, 1, 2] and proof.batches([1] * 41)[-1] == 1
    assert proof.located("a b a", [("a", "x"), ("a", "y"), ("a", "z"), ("b", "b")]) == [(0, 1, "x"), (4, 5, "y")]


def test_blocks_round_trip_as_json():
    b = Block("table", rows=[Row([Cell([Block(role="h", level=2, list=ListInfo(True, 1, "k", formats={1: "lowerRoman"}, starts={1: 3}), spans=[Span("x", Fmt(i=True, href="h")), Span("￼", obj=Obj("image", "k", "L"))])], 2, "restart", True)], True)])
    assert loads(dumps(b)) == b
    rng = random.Random(0)
    assert loads(dumps(para("".join(rng.choice('a"\\\n€') for _ in range(50))))).type == "p"


def plain_labels(items):
    """List labels by one pass over (pos, level, key, override, starts, formats, template), counters in a dict."""
    from palimpsest.sources.writers import number

    counters, seen, out = {}, set(), {}
    for pos, level, key, override, starts, formats, template in sorted(items, key=lambda i: i[0]):
        c = counters.get(key)
        if c is None or (override and override not in seen):
            seen |= {override} if override else set()
            c = counters[key] = {}
        c[level] = c[level] + 1 if level in c else starts.get(level, 1)
        for deeper in [n for n in c if n > level]:
            del c[deeper]
        shown = lambda n: number(c.get(n, starts.get(n, 1)), formats.get(n, ["decimal", "lowerLetter", "lowerRoman"][n % 3]))  # noqa: B023, E731
        label = f"{shown(level)}."
        if template and "%" in template:
            label = template
            for n in range(9):
                label = label.replace(f"%{n + 1}", shown(n))
        out[pos] = label if not template or "%" in template else template
    return out


def test_nested_list_labels(spark):
    from palimpsest.operators import layout

    rng = random.Random(6)
    docs = {d: [] for d in range(5)}
    for items in docs.values():
        for pos in range(120):
            starts = {n: rng.randint(0, 30) for n in range(4) if rng.random() < 0.3}
            formats = {n: rng.choice(["upperRoman", "decimalZero", "upperLetter", "decimal"]) for n in range(4) if rng.random() < 0.3}
            items.append((pos, rng.randrange(4), rng.choice("xy"), rng.choice([None, None, None, "o1", "o2"]), starts, formats, rng.choice([None, "", "%1.%2", "(%3)", "—", "%1.%2.%3.%4"])))
    schema = "doc_id long, pos int, level int, key string, override string, starts map<int,int>, formats map<int,string>, template string, ordered boolean"
    table = spark.createDataFrame([(d, *i, True) for d, items in docs.items() for i in items], schema)
    got = {(r.doc_id, r.pos): r.label for r in layout.list_labels(table, levels=4).collect()}
    assert got == {(d, pos): label for d, items in docs.items() for pos, label in plain_labels(items).items()}
    assert layout.list_labels(table.limit(0)).count() == 0


def test_undo_depth_and_edges(spark):
    from palimpsest.operators import layout

    events = [("s", i, "commit", f"l{i}", f"d{i}") for i in range(205)] + [("s", 1000 + i, "undo", None, None) for i in range(203)] + [("s", 2000, "redo", None, None), ("t", 1, "undo", None, None), (None, 1, "commit", "x", "y")]
    got = {(r.session, r.seq): r for r in layout.replayed(spark.createDataFrame(events, "session string, seq long, action string, label string, docs string")).collect()}
    assert got["s", 1199].now == "d4" and got["s", 1199].done == "l5" and not got["s", 1199].can_undo  # 200 steps back, then nothing
    assert got["s", 1202].now == "d4" and got["s", 1202].done is None and got["s", 2000].now == "d5"
    assert got["t", 1].now is None and not got["t", 1].can_redo and got[None, 1].now == "y"


def test_marks_on_left_out_blocks(spark):
    from palimpsest.operators import placing

    rows = spark.createDataFrame([("p", 0, "k0", 0, "b0", None), ("p", 1, "k1", -1, "b2", "c0")], "pair_id string, row_no int, key string, hunk int, l_block string, r_block string")
    blocks = spark.createDataFrame([("p", "a", 0, "b0", 0, "abc"), ("p", "a", 1, "b1", 4, ""), ("p", "a", 2, "b2", 5, "defg")], "pair_id string, side string, pos int, block_id string, start long, text string")
    marks = spark.createDataFrame([("m", "p", "a", 1, 7), ("n", "p", "a", None, None), ("e", "p", "a", 3, 5), ("o", "q", "a", 0, 3), ("z", "p", "a", 6, 7)], "mark_id string, pair_id string, side string, start long, end long")
    placed, parts = placing.place_text_marks(marks, blocks, rows)
    got = {r.mark_id: (r.found, r.hunk, r.row_key) for r in placed.collect()}
    assert got == {"m": (True, 0, "k0"), "n": (False, -1, None), "e": (False, -1, None), "o": (False, -1, None), "z": (True, -1, "k1")}
    assert sorted((r.mark_id, r.pos, r.seg_start, r.seg_end, r.row_key) for r in parts.collect()) == [("m", 0, 1, 3, "k0"), ("m", 2, 0, 2, "k1"), ("z", 2, 1, 2, "k1")]


def test_regions_of_several_lines():
    """Pairing of n to m lines keeps order and has the largest sum of similarities over the threshold, by trying all."""
    from itertools import combinations

    from palimpsest.operators.sequence import PAIR_AT

    rng = random.Random(8)
    for _ in range(300):
        n, m = rng.randrange(5), rng.randrange(5)
        sim = [[rng.choice([0.0, 0.1, 0.3, 0.4, 0.45, 0.6, 0.9]) for _ in range(m)] for _ in range(n)]
        fits = [[rng.random() < 0.9 for _ in range(m)] for _ in range(n)]
        got = list(pair_up(n, m, lambda i, j: sim[i][j], lambda i, j: fits[i][j]))  # noqa: B023
        assert [i for i, _ in got if i is not None] == list(range(n)) and [j for _, j in got if j is not None] == list(range(m))
        pairs = [(i, j) for i, j in got if i is not None and j is not None]
        assert all(fits[i][j] for i, j in pairs)
        best = max(sum(sim[i][j] for i, j in zip(a, b, strict=True)) for k in range(min(n, m) + 1) for a in combinations(range(n), k) for b in combinations(range(m), k)
                   if all(fits[i][j] and sim[i][j] >= PAIR_AT for i, j in zip(a, b, strict=True)))
        assert abs(sum(sim[i][j] for i, j in pairs if sim[i][j] >= PAIR_AT) - best) < 1e-9


def test_rules_against_a_plain_scan():
    """Findings of the rules that need no dictionary of words, by looking at every place of random text."""
    rng = random.Random(12)
    pieces = ["a", "b", "Ab", "i", "I", " ", "  ", "   ", ",", ";", ":", ".", "..", "...", "1", "é"]
    letter = lambda c: c.isalpha()
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        at = lambda k: t[k] if 0 <= k < len(t) else ""  # noqa: B023, E731
        expected = set()
        for k in range(len(t)):
            if t[k] in ",;" and letter(at(k - 1) or "1") and letter(at(k + 1) or "1"):
                expected.add(("space-after", k, k + 1))
            if t[k] == "i" and not (letter(at(k - 1) or "1") or at(k - 1) and at(k - 1) in ".'’(-") and not (letter(at(k + 1) or "1") or at(k + 1) and at(k + 1) in ".'’)-"):
                expected.add(("pronoun", k, k + 1))
            end = k
            while at(end) == " ":
                end += 1
            if end - k > 1 and k and at(k - 1) != " " and end < len(t):
                expected.add(("spaces", k, end))
            run = k
            while run < len(t) and t[run] == t[k]:
                run += 1
            if (t[k] in ",;:" and run - k > 1 and at(k - 1) != t[k]) or (t[k] == "." and run - k == 2 and at(k - 1) != "."):
                expected.add(("doubled", k, run))
        got = {(rule, s, e) for rule, s, e, *_ in proof.grammar(t) if rule in ("space-after", "pronoun", "spaces", "doubled")}
        assert got == expected, t
