"""Readers on small literals."""

import io
import zipfile

import pytest

from palimpsest.model import Fmt
from palimpsest.operators.changes import block_text
from palimpsest.sources import delimited, html, load, markdown, text


def shape(blocks):
    return [(b.type, b.role, b.level, block_text(b)) for b in blocks]


def test_lines():
    d = text.read("﻿a\r\nb\r\n\r\nc\n", "x.txt")
    assert shape(d.blocks) == [("p", "p", None, t) for t in ("a", "b", "", "c")] and d.eol == "\r\n" and not d.mono
    assert text.read("", "x").blocks == []
    d = text.read('{"a": [' + ", ".join(["1"] * 300) + "]}", "x.json", "json")
    assert len(d.blocks) > 300 and d.notes and d.mono


def test_delimited():
    assert delimited.parse('a,"b ""c""\nd",e"f\r\n1,,\n') == [["a", 'b "c"\nd', 'e"f'], ["1", "", ""]]
    assert delimited.parse("") == [] and delimited.parse("a\n\nb") == [["a"], [""], ["b"]] and delimited.parse("a,") == [["a", ""]]
    assert delimited.guess("a;b;c\n1;2,5;3") == ";" and delimited.guess("a,b\n1,2") == "," and delimited.guess("one") == ","
    source = 'id;"x;y"; z\r\n1;"a ""b""";2\r\n'
    d = delimited.read(source, "x.csv")
    assert d.delimiter == ";" and d.eol == "\r\n" and delimited.write(d) == 'id;"x;y";" z"\r\n1;"a ""b""";2\r\n'


def test_markdown():
    d = markdown.read("# One\n\nTwo\n===\n\nA *b* **c** `d` [e](http://f) ~~g~~ h\\*\nnext\n\n- x\n  - y\n3. z\n\n> q\n\n```\ncode *x*\n```\n\n| a | b |\n|---|---|\n| 1 \\| 2 | 3 |\n", "x.md")
    assert shape(d.blocks) == [
        ("p", "h", 1, "One"), ("p", "h", 1, "Two"), ("p", "p", None, "A b c d e g h* next"), ("p", "p", None, "x"), ("p", "p", None, "y"), ("p", "p", None, "z"),
        ("p", "quote", None, "q"), ("p", "code", None, "code *x*"), ("table", "p", None, "a\tb\n1 | 2\t3"),
    ]
    assert [(b.list.ordered, b.list.level) for b in d.blocks[3:6]] == [(False, 0), (False, 1), (True, 0)] and d.blocks[5].list.starts == {0: 3}
    spans = {s.text: s.fmt for s in d.blocks[2].spans}
    assert spans["b"] == Fmt(i=True) and spans["c"] == Fmt(b=True) and spans["d"] == Fmt(code=True) and spans["e"] == Fmt(href="http://f") and spans["g"] == Fmt(s=True)
    assert block_text(markdown.read("snake_case_name and 2*3*4", "x").blocks[0]) == "snake_case_name and 234"


def test_html():
    d = html.read(
        "<!doctype html><head><title>t</title></head><body><h1>A &amp; B</h1><p>x <b>y</b>\n z<br>w<p>second<ul><li>one<li>two<ol start=4><li>in</ol></ul>"
        "<script>no</script><div><span style='font-weight:700'>s</span></div><table><tr><td rowspan=2>a<td>b</tr><tr><td>c</table><blockquote>q</blockquote>"
        "<p style='text-align:center;display:block'>mid</p><img src=a.png alt=pic>", "x")  # fmt: skip
    assert shape(d.blocks) == [
        ("p", "h", 1, "A & B"), ("p", "p", None, "x y z\nw"), ("p", "p", None, "second"), ("p", "p", None, "one"), ("p", "p", None, "two"), ("p", "p", None, "in"),
        ("p", "p", None, "s"), ("table", "p", None, "a\tb\n\tc"), ("p", "quote", None, "q"), ("p", "p", None, "mid"), ("p", "p", None, ""),
    ]
    assert d.blocks[5].list.starts == {1: 4} and d.blocks[5].list.level == 1 and d.blocks[9].align == "center"
    assert d.blocks[7].rows[0].cells[0].vmerge == "restart" and d.blocks[7].rows[1].cells[0].vmerge == "continue"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("types", "[Content_Types].xml"), data)
    return out.getvalue()


def test_sniffing_and_decoding():
    assert load.sniff(b"%PDF-1.7")[0] == "pdf" and load.sniff(b"{\\rtf1")[0] == "rtf" and load.sniff(load.CFB + b"x")[0] == "cfb" and load.sniff(b"hi") == ("text", "")
    assert load.sniff(zipped(types="wordprocessingml"))[0] == "docx" and load.sniff(zipped(types="spreadsheetml")) == ("zip", "an Excel workbook")
    assert load.sniff(zipped(mimetype="application/vnd.oasis.opendocument.text"))[0] == "odt" and load.sniff(zipped(mimetype="application/epub+zip"))[0] == "epub"
    assert load.sniff(b"PKxx") == ("zip", "damaged") and load.sniff(b'<?xml version="1.0"?><office:document x="y">')[0] == "fodt"
    assert load.decode("ﬁ".encode()) == "ﬁ" and load.decode(b"caf\xe9") == "café" and load.decode("﻿a".encode("utf-16-le")) == "a"


def test_loading():
    assert load.read(b"<p>x</p>", "a.doc").kind == "html" and load.read(b"# x", "a.md").kind == "markdown" and load.read(b"a,b", "a.csv").kind == "csv"
    mime = b'MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>caf=C3=A9=\r\n!</p>\r\n--b--'
    assert block_text(load.read(mime, "a.mht").blocks[0]) == "café!"
    for content, name in ((b"x", "a.pages"), (b"a\0b", "a.bin"), (zipped(x="y"), "a.zip")):
        with pytest.raises(load.Unreadable):
            load.read(content, name)
    assert load.pasted('<p class="MsoNormal">x</p>', "")[1] == "word" and load.pasted("", "a\nb")[1] == "text"


def test_blocks_of_files(spark):
    files = spark.createDataFrame([(1, "a.md", b"# T\n\nx"), (2, "b.doc", load.CFB + b"x"), (3, "c.txt", None)], "doc_id long, name string, content binary")
    rows = load.blocks(files).collect()
    assert [(r.doc_id, r.pos, r.role) for r in rows] == [(1, 0, "h"), (1, 1, "p"), (2, -1, None)] and "can read" in rows[2].error


def test_columns_of_blocks(spark):
    files = spark.createDataFrame([(1, "a.md", b"# T\n\nx"), (2, "b.doc", load.CFB + b"x"), (3, "c.txt", None)], "doc_id long, name string, content binary")
    full = load.blocks(files)
    for columns in (["doc_id", "role", "level", "stream"], ["body", "doc_id", "error"], ["sig", "pos", "blank", "block_id", "type"]):
        got = load.blocks(files, columns=iter(columns))
        assert sorted(got.columns) == sorted(columns) and got.schema == full.select(got.columns).schema and got.collect() == full.select(got.columns).collect()


MIXED = "# One\n\nA *b* **c** [e](http://f).\n\n- x\n  - y\n\n1. z\n2. w\n\n> q\n\n```\ncode\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"


def same(a, b):
    from palimpsest.operators.compare import compare_blocks

    return {r[0] for r in compare_blocks(a, b)} == {"eq"}


def test_writers_round_trip():
    from palimpsest.sources import office, writers

    d = markdown.read(MIXED, "m.md")
    assert same(d.blocks, markdown.read(writers.to_markdown(d), "m.md").blocks)
    assert same(d.blocks, html.read(writers.to_html(d), "m.html").blocks)
    assert same(d.blocks, office.read_docx(writers.to_docx(d), "m.docx").blocks)
    plain = markdown.read("# H\n\nSome *text* é “q”.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "x")
    assert same(plain.blocks, load.read(writers.to_rtf(plain).encode(), "m.rtf").blocks)
    assert writers.to_text(d).splitlines()[2:6] == ["• x", "    ◦ y", "1. z", "2. w"]
    lines = text.read("a\r\n\r\nb\r\n", "x")
    assert writers.to_lines(lines) == "a\r\n\r\nb\r\n"
    assert [writers.number(n, f) for n, f in ((28, "lowerLetter"), (1994, "upperRoman"), (7, "decimalZero"), (0, "lowerRoman"))] == ["bb", "MCMXCIV", "07", "0"]
    assert writers.formats("csv")[0] == "csv"


def test_written_columns(spark):
    from palimpsest.model import dumps, para
    from palimpsest.sources import writers

    blocks = spark.createDataFrame([(1, 1, dumps(para("b"))), (1, 0, dumps(para("a")))], "doc_id long, pos int, body string")
    assert bytes(writers.written(blocks, "lines").first().content) == b"a\nb\n"


def test_word_and_epub_files():
    from palimpsest.sources import office

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr>{run("Head")}</w:p><w:p><w:ins>{run("kept")}</w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
    body += '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>3</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    files = {"types": "<Types/>", "word__document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word__styles.xml": f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'}
    d = office.read_docx(zipped(**files), "x.docx")
    assert shape(d.blocks) == [("p", "h", 2, "Head"), ("p", "p", None, "kept"), ("p", "p", None, "3")] and d.blocks[2].spans[0].obj.key == "PAGE"
    book = zipped(mimetype="application/epub+zip", **{
        "META-INF__container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o__p.opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
        "o__a.xhtml": "<html><body><p>first</p></body></html>", "o__b.xhtml": "<html><body><h1>second</h1></body></html>"})
    assert [block_text(b) for b in load.read(book, "x.epub").blocks] == ["second", "first"]
