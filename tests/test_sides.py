"""Side HTML, the assistant's findings, and selections of words and table rows."""

import re

from pyspark.sql import functions as F

from palimpsest.functions.options import DEFAULTS
from palimpsest.model import Block, Cell, Fmt, ListInfo, Row, Span, dumps, para
from palimpsest.operators import assistant, compare, merge, sides
from palimpsest.operators.inline import diff_blocks


def test_marked_sides():
    a, b = Block(spans=[Span("one two "), Span("three", Fmt(b=True)), Span(" <x>")]), para("one 2 three and four <x>")
    d = diff_blocks([a], [b], DEFAULTS)
    left, right = sides.changed_paragraph(a, b)
    bare = lambda s: re.sub(r"<[^>]*>", "", s)
    assert bare(left) == "one two three &lt;x&gt;" and bare(right) == "one 2 three and four &lt;x&gt;"
    assert left.count("<del") + left.count("caret") == right.count("<ins") + right.count("caret") == len(d.changes)
    only = sides.changed_paragraph(para("same words here"), Block(spans=[Span("same "), Span("words", Fmt(b=True)), Span(" here")]))
    assert 'class="chg fmt"' in only[0] and "Formatting differs" in only[1]
    styled = sides.changed_paragraph(para("x"), para("x", role="h", level=2))
    assert "Normal text" in styled[0] and "Heading 2" in styled[1]
    gone = sides.changed_paragraph(para("a b"), para("b"))
    assert "Text here only in A" in gone[1] and sides.changed_paragraph(para(""), para("x"))[0].count("caret") == 1


def table(*rows):
    return Block("table", rows=[Row([Cell([para(c)]) for c in r]) for r in rows])


def test_side_html(spark):
    left, right = [para("same"), para("old line"), table(("a", "b"), ("c", "d"), ("e", "f"))], [para("same"), para("new line"), para("added"), table(("a", "b"), ("c", "X"), ("e", "f"))]
    lists = [[(f"{s}{k}", dumps(b)) for k, b in enumerate(x)] for s, x in (("a", left), ("b", right))]
    pairs = spark.createDataFrame([("p", *lists)], "pair_id string, left array<struct<id:string,body:string>>, right array<struct<id:string,body:string>>")
    rows = compare.compare_pairs(pairs)
    got = sides.side_html(rows).orderBy("row_no").collect()
    assert [r.kind for r in got] == ["eq", "mod", "ins", "table"]
    assert got[0].a == got[0].b == "<p>same</p>" and "<del" in got[1].a and "<ins" in got[1].b and "not in A" in got[2].a
    assert got[3].a.count("trow") == got[3].b.count("trow") == 3 and "<ins" in got[3].b and "<del" in got[3].a
    assert sides.side_html(rows.limit(0)).count() == 0
    swapped = compare.compare_pairs(merge.swapped_pairs(pairs)).orderBy("row_no").collect()
    assert [r.kind for r in swapped] == ["eq", "mod", "del", "table"]


def test_selected_words_and_table_rows(spark):
    left, right = [para("one two three four five"), table(("a", "b"), ("c", "d"), ("e", "f"))], [para("one 2 three 4 five"), table(("a", "b"), ("c", "X"), ("e", "f"), ("g", "h"))]
    lists = [[(f"{s}{k}", dumps(b)) for k, b in enumerate(x)] for s, x in (("a", left), ("b", right))]
    pairs = spark.createDataFrame([("p", *lists)], "pair_id string, left array<struct<id:string,body:string>>, right array<struct<id:string,body:string>>")
    rows = compare.compare_pairs(pairs).cache()
    target = pairs.select("pair_id", F.posexplode("right").alias("pos", "b")).select("pair_id", "pos", "b.id", "b.body")
    from palimpsest.model import loads
    from palimpsest.operators.changes import block_text

    key = rows.filter("kind = 'mod'").first().key
    chosen = merge.select_inline(rows, spark.createDataFrame([("p", key, 1), ("p", "other", 0)], "pair_id string, key string, change int"))
    got = [block_text(loads(r.body)) for r in merge.apply_selection(rows, chosen, target).orderBy("pos").collect()]
    assert got == ["one 2 three four five", "a\tb\nc\tX\ne\tf\ng\th"]
    subs = compare.compare_table_rows(rows).filter("kind = 'ins'")
    got = [block_text(loads(r.body)) for r in merge.apply_selection(rows, merge.select_table_rows(rows, subs), target).orderBy("pos").collect()]
    assert got == ["one 2 three 4 five", "a\tb\nc\tX\ne\tf"]


def test_assistant(spark):
    reply = [{"p": 1, "text": "is", "fix": "was", "why": "tense"}, {"p": "1", "text": "is", "fix": "was"}, {"p": 1, "text": "is", "fix": "x"}, {"p": 2, "text": "none", "fix": "y"}, {"p": 9, "text": "a", "fix": "b"}, "junk", {"p": 2, "text": "so", "fix": "so"}]
    found = assistant.findings(["it is as it is", "so"], reply)
    assert found == [[(3, 5, "is", "tense", "was"), (12, 14, "is", "Suggested by the assistant", "was")], []]
    assert assistant.findings(["a"], {"p": 1}) == [[]] and "[2] b c" in assistant.request(["a", "b\n c"], "de") and "German" in assistant.request([], "de")
    lines = spark.createDataFrame([(1, k, f"line teh {k}") for k in range(90)] + [(2, 0, ""), (2, 1, None), (None, 0, "teh")], "doc_id long, pos int, text string")

    def sampler(request):
        numbers = [int(n) for n in re.findall(r"^\[(\d+)\]", request, re.M)]
        assert len(numbers) <= 40
        return [{"p": n, "text": "teh", "fix": "the", "why": "spelling"} for n in numbers]

    got = assistant.assistant_issues(lines, sampler)
    assert {(r.doc_id, r.pos, r.start, r.suggestion) for r in got.collect()} == {(1, k, 5, "the") for k in range(90)}
    local = got.drop("source").limit(3)
    assert {r.source for r in assistant.all_issues(local, got).collect()} == {"local", "assistant"}
    assert Block(list=ListInfo(True)).list.ordered


def merged(spark, left, right, o=DEFAULTS, to_right=True):
    from palimpsest.model import loads

    lists = [[(f"{s}{k}", dumps(b)) for k, b in enumerate(x)] for s, x in (("a", left), ("b", right))]
    pairs = spark.createDataFrame([("p", *lists)], "pair_id string, left array<struct<id:string,body:string>>, right array<struct<id:string,body:string>>")
    rows = compare.compare_pairs(pairs, o)
    target = pairs.select("pair_id", F.posexplode("right" if to_right else "left").alias("pos", "b")).select("pair_id", "pos", "b.id", "b.body")
    return [loads(r.body) for r in merge.apply_selection(rows, merge.select_all(rows), target, to_right, o).orderBy("pos").collect()]


def test_hidden_blocks_stay_where_they_are(spark):
    from palimpsest.functions.options import CompareOptions
    from palimpsest.operators.changes import block_text

    o = CompareOptions(ignore_empty=True)
    left, right = [para(t) for t in ("A", "B", "C", "D")], [para(t) for t in ("A", "", "C", "X", "D")]
    assert [block_text(b) for b in merged(spark, left, right, o)] == ["A", "", "B", "C", "D"]
    assert [block_text(b) for b in merged(spark, left, right, o, to_right=False)] == ["A", "C", "X", "D"]
    tail = [para("A"), para(""), para("")]
    assert [block_text(b) for b in merged(spark, [para("A"), para("Z")], tail, o)] == ["A", "", "", "Z"]


def test_copied_items_join_their_neighbours_list(spark):
    item = lambda t, key, ordered=True: para(t, list=ListInfo(ordered, 0, key, formats={0: "decimal"}))
    left = [item("one", "k"), item("two", "k"), item("three", "k"), para("end"), item("dot", "d", False)]
    right = [item("one", "q"), item("three", "q"), para("end")]
    got = merged(spark, left, right)
    assert [(b.spans[0].text, b.list and b.list.key) for b in got] == [("one", "q"), ("two", "q"), ("three", "q"), ("end", None), ("dot", "p/d")]
