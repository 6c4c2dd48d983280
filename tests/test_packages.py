"""Packages written and edited in place, read back by the readers."""

import io
import random
import zipfile

import pytest

from palimpsest.functions.options import DEFAULTS
from palimpsest.functions.tokens import block_sig
from palimpsest.model import Block, Cell, Doc, Fmt, ListInfo, Obj, Row, Span, dumps, loads, para
from palimpsest.operators.changes import block_text
from palimpsest.operators.compare import compare_blocks
from palimpsest.sources import html, load, markdown, office, opendocument, packages, writers

MIXED = "# One\n\nA *b* **c** [e](http://f).\n\n- x\n  - y\n\nBetween.\n\n1. z\n2. w\n\n> q\n\n```\ncode  two\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"


def sigs(blocks):
    return [block_sig(b, DEFAULTS) for b in blocks if not (b.type == "p" and not b.spans)]


def some_doc(rng, words, n=12):
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        if kind == 0:
            out.append(para(text, role="h", level=rng.randint(1, 3)))
        elif kind == 1:
            out.append(Block(spans=[Span(text + " "), Span("bold", Fmt(b=True)), Span(" and "), Span("link", Fmt(href="http://x/" + rng.choice(words)))]))
        elif kind == 2:
            out.append(para(text, list=ListInfo(rng.random() < 0.5, 0, rng.choice("kl"), formats={0: "decimal"})))
        elif kind == 3:
            out.append(Block("table", rows=[Row([Cell([para(rng.choice(words))]), Cell([para(text)])]) for _ in range(2)]))
        else:
            out.append(para(text))
    return out


def merged_pieces(a, b, chosen):
    """Pieces of b's file after the chosen rows are copied from a, and the blocks they stand for."""
    rows = compare_blocks([loads(dumps(x)) for x in a], [loads(dumps(x)) for x in b])
    left, right = iter(range(len(a))), iter(range(len(b)))
    pieces, blocks = [], []
    for n, (kind, l, r, _, _) in enumerate(rows):
        i, j = (next(left) if l is not None else None), (next(right) if r is not None else None)
        if kind != "eq" and n in chosen:
            if i is not None:
                pieces.append(packages.Piece(f"a:{i}", dumps(a[i]), "copied"))
                blocks.append(a[i])
        elif j is not None:
            pieces.append(packages.Piece(f"b:{j}", dumps(b[j]), "own"))
            blocks.append(b[j])
    return pieces, blocks


@pytest.mark.parametrize("write, read, backend", [(writers.to_docx, office.read_docx, packages.DocxBackend), (opendocument.to_odt, office.read_odt, packages.OdtBackend)])
@pytest.mark.parametrize("foreign", [False, True])
def test_merges_in_place(write, read, backend, foreign):
    """Any choice of changes, from a file of the same kind or of another, is what is read back."""
    rng = random.Random(3)
    words = ["river", "stone", "a b", "é", "x  y", "Nothing", "<&>"]
    for _ in range(25):
        base = some_doc(rng, words)
        changed = [x for x in base if rng.random() > 0.2] + some_doc(rng, words, 3)
        files = [write(Doc("x", "x", side)) for side in (base, changed)]
        a, b = (read(f, "x").blocks for f in files)
        rows = compare_blocks(a, b)
        for chosen in (set(range(len(rows))), set(), {n for n in range(len(rows)) if rng.random() < 0.5}):
            pieces, blocks = merged_pieces(a, b, chosen)
            out = backend().apply(files[1], None if foreign else files[0], pieces)
            assert sigs(read(out, "x").blocks) == sigs(blocks)


def test_odt_round_trip():
    d = markdown.read(MIXED, "m.md")
    back = office.read_odt(opendocument.to_odt(d), "m.odt")
    assert {r[0] for r in compare_blocks(d.blocks, [b for b in back.blocks if b.type != "p" or b.spans])} == {"eq"}
    spaced = [para("  two  spaces "), para("tab\tand\nline"), Block(spans=[Span("H"), Span("2", Fmt(sub=True)), Span("￼", obj=Obj("footnote", "n", note="a note"))])]
    got = office.read_odt(opendocument.to_odt(Doc("x", "odt", spaced)), "x").blocks
    assert [block_text(b) for b in got[:2]] == ["  two  spaces ", "tab\tand\nline"] and got[2].spans[1].fmt.sub and got[2].spans[2].obj.note == "a note"
    assert office.read_odt(opendocument.to_odt(Doc("x", "odt", [])), "x").blocks == []
    assert load.sniff(opendocument.to_odt(d))[0] == "odt" and writers.formats("odt")[0] == "odt"


def repacked(content, **changes):
    """A package with parts added or changed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as y:
        for n in z.namelist():
            data = z.read(n)
            y.writestr(n, changes.pop(n.replace("/", "__"))(data) if n.replace("/", "__") in changes else data)
        for n, data in changes.items():
            y.writestr(n.replace("__", "/"), data)
    return out.getvalue()


def test_a_word_package_keeps_what_is_not_touched():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    target = writers.to_docx(Doc("t", "docx", [para("one"), para("two"), para("three")]))
    mark = b'<w:bookmarkStart w:id="1" w:name="here"/><w:bookmarkEnd w:id="1"/>'
    target = repacked(target, word__document_xml=b"", custom__item_xml=b"<x/>")
    target = repacked(target, **{"word__document.xml": lambda d: d.replace(b"<w:p><w:r><w:t xml:space=\"preserve\">two", b"<w:p><w:pPr><w:sectPr><w:pgSz w:w=\"9\"/></w:sectPr></w:pPr>" + mark + b"<w:r><w:t xml:space=\"preserve\">two")})
    picture = b"\x89PNG fake bytes"
    source = writers.to_docx(Doc("s", "docx", [para("one"), para("other"), para("three")]))
    drawing = b'<w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="pic"/></w:drawing></w:r>'
    note = b'<w:r><w:footnoteReference w:id="7"/></w:r>'
    rel = b'<Relationship Id="pic" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/p.png"/></Relationships>'
    source = repacked(source, **{
        "word__document.xml": lambda d: d.replace(b"other</w:t></w:r>", b"other</w:t></w:r>" + drawing + note), "word__media__p.png": picture,
        "word___rels__document.xml.rels": lambda d: d.replace(b"</Relationships>", rel), "word__footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="7"><w:p><w:r><w:t>noted</w:t></w:r></w:p></w:footnote></w:footnotes>'.encode(),
    })
    a, b = office.read_docx(source, "s").blocks, office.read_docx(target, "t").blocks
    pieces, _ = merged_pieces(a, b, {1})
    out = packages.DocxBackend().apply(target, source, pieces)
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        document = z.read("word/document.xml")
        assert z.read("custom/item_xml") == b"<x/>" and z.read("word/media/p.png") == picture
        assert b"bookmarkStart" in document and document.count(b"sectPr") >= 2 and b"pgSz" in document
        assert b'Extension="png"' in z.read("[Content_Types].xml")
    got = [x for x in office.read_docx(out, "o").blocks if x.spans and any(s.text for s in x.spans)]
    assert [block_text(x)[:5] for x in got] == ["one", "other", "three"]
    objects = {s.obj.kind: s.obj for s in got[1].spans if s.obj}
    assert objects["image"].key == next(s.obj.key for s in a[1].spans if s.obj and s.obj.kind == "image") and objects["footnote"].note == "noted"
    again = packages.DocxBackend().apply(out, source, [packages.Piece(f"b:{k}", dumps(x), "own") for k, x in enumerate(office.read_docx(out, "o").blocks)] + [packages.Piece("a:1", dumps(a[1]), "copied")])
    with zipfile.ZipFile(io.BytesIO(again)) as z:
        assert sum(n.startswith("word/media/") for n in z.namelist()) == 1  # the same picture is there once


def test_styles_of_one_name_are_one():
    style = lambda ident: lambda d: d.replace(b"</w:styles>", f'<w:style w:type="paragraph" w:styleId="{ident}"><w:name w:val="My Style"/></w:style></w:styles>'.encode())
    use = lambda ident: lambda d: d.replace(b"<w:p><w:r>", f'<w:p><w:pPr><w:pStyle w:val="{ident}"/></w:pPr><w:r>'.encode(), 1)
    target = repacked(writers.to_docx(Doc("t", "docx", [para("t")])), **{"word__styles.xml": style("Mine")})
    source = repacked(writers.to_docx(Doc("s", "docx", [para("s")])), **{"word__styles.xml": style("Theirs"), "word__document.xml": use("Theirs")})
    out = packages.DocxBackend().apply(target, source, [packages.Piece("a:0", dumps(para("s")), "copied")])
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert b'w:val="Mine"' in z.read("word/document.xml") and z.read("word/styles.xml").count(b"My Style") == 1


def test_changed_paragraphs_keep_their_properties():
    target = writers.to_docx(Doc("t", "docx", [Block(spans=[Span("old words")], align="center", role="h", level=2)]))
    body = dumps(Block(spans=[Span("new "), Span("words", Fmt(b=True))], align="center", role="h", level=2))
    got = office.read_docx(packages.DocxBackend().apply(target, None, [packages.Piece("b:0", body, "changed")]), "x").blocks
    assert [(x.role, x.level, x.align, block_text(x)) for x in got] == [("h", 2, "center", "new words")] and got[0].spans[1].fmt.b


def test_edited_files(spark):
    a, b = [para("one"), para("kept")], [para("kept"), para("two")]
    docs = {"docx": writers.to_docx, "odt": opendocument.to_odt}
    rows = [(k, k, write(Doc("b", k, b)), write(Doc("a", k, a))) for k, write in docs.items()] + [("new", "docx", None, None), ("md", "markdown", None, None), ("none", "docx", writers.to_docx(Doc("b", "docx", b)), None)]
    files = spark.createDataFrame(rows, "pair_id string, kind string, target binary, source binary")
    merged = [(k, 0, "a:0", dumps(a[0])) for k, *_ in rows[:-1]] + [(k, 1, "b:0", dumps(b[0])) for k, *_ in rows[:-1]]
    merged = spark.createDataFrame(merged, "pair_id string, pos int, id string, body string")
    target = spark.createDataFrame([(k, f"b:{n}", dumps(x)) for k, *_ in rows for n, x in enumerate(b)], "pair_id string, id string, body string")
    found = {r.pair_id: bytes(r.content) for r in packages.edited_files(packages.pieces(merged, target), files).collect()}
    readers = {"docx": office.read_docx, "odt": office.read_odt, "new": office.read_docx}
    for k, read in readers.items():
        assert [block_text(x) for x in read(found[k], "x").blocks] == ["one", "kept"]
    assert found["md"] == b"one\n\nkept\n" and office.read_docx(found["none"], "x").blocks == []
    assert packages.backend("docx").kind == "docx" and packages.backend("fodt").kind == "odt" and packages.backend("text").kind == "text"


def test_style_sheets():
    from palimpsest.sources import css

    sheet = "/* x */ @import 'a'; p { color: red } .b, span.c1.d { font-weight: bold } @media print { .b { font-weight: normal } } em { font-style: normal } a:hover, p > q { x: y } .e{}"
    found = css.rules(sheet)
    assert [(r.tag, sorted(r.classes), r.style) for r in found] == [("p", [], "color: red"), ("", ["b"], "font-weight: bold"), ("span", ["c1", "d"], "font-weight: bold"), ("em", [], "font-style: normal")]
    blocks = html.blocks("<p class=b>x <em>y</em> <span class='d c1'>z</span><span class=c1>w</span><b style='font-weight:normal'>n</b></p>", "l", css.rules(sheet + " b { font-weight: bold }"))
    assert [(s.text, s.fmt.b, s.fmt.i) for s in blocks[0].spans] == [("x y zw", True, False), ("n", False, False)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="t/a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/t/a.xhtml", '<html><head><link rel="stylesheet" href="../s.css"/><style>.i { font-style: italic }</style></head><body><p>a <span class="big">b</span><span class="i">c</span></p></body></html>')
        z.writestr("o/s.css", ".big { font-weight: 700 }")
    spans = load.read(out.getvalue(), "x.epub").blocks[0].spans
    assert [(s.text, s.fmt.b, s.fmt.i) for s in spans] == [("a ", False, False), ("b", True, False), ("c", False, True)]


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (40).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"rest"


def test_pictures_and_notes_in_word_files():
    import base64

    src = "data:image/png;base64," + base64.b64encode(PNG).decode()
    image = Span("￼", obj=Obj("image", "k", "A <picture>", src=src))
    blocks = [Block(spans=[Span("see "), image, image]), Block(spans=[Span("noted"), Span("￼", obj=Obj("footnote", "n", note="the <note>")), Span("￼", obj=Obj("endnote", "e", note="last"))])]
    assert writers.image_size(PNG) == (40, 20) and writers.image_size(b"GIF89a\x05\0\x06\0") == (5, 6) and writers.image_size(b"x") is None
    assert writers.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x07\0\x09\x03") == (9, 7) and writers.image_data("http://x") is None
    target = writers.to_docx(Doc("t", "docx", [para("first")]))
    pieces = [packages.Piece("b:0", dumps(para("first")), "own"), *(packages.Piece("x", dumps(b), "copied") for b in blocks)]
    for out in (writers.to_docx(Doc("x", "docx", blocks)), packages.DocxBackend().apply(target, None, pieces)):
        with zipfile.ZipFile(io.BytesIO(out)) as z:
            assert [z.read(n) for n in z.namelist() if "media/" in n] == [PNG] and b'Extension="png"' in z.read("[Content_Types].xml")
            assert f'cx="{40 * 9525}"'.encode() in z.read("word/document.xml")
        objects = [s.obj for b in office.read_docx(out, "x").blocks for s in b.spans if s.obj]
        assert [(o.kind, o.note) for o in objects] == [("image", None), ("image", None), ("footnote", "the <note>"), ("endnote", "last")]
        assert objects[0].key == f"img:{html.fnv(PNG):x}:{len(PNG):x}" and objects[0].label == "A <picture>"


def test_pictures_by_their_bytes():
    import base64

    key = f"img:{html.fnv(PNG):x}:{len(PNG):x}"
    data = "data:image/png;base64," + base64.b64encode(PNG).decode()
    keys = lambda source, images=None: [s.obj.key for b in html.blocks(source, "l", None, images) for s in b.spans if s.obj]
    assert keys(f"<p><img src='{data}'>x<img src='p.png'></p>", {"p.png": PNG}.get) == [key, key]
    assert keys("<p>x<img src='p.png'><img src='data:text/plain,a%20b'></p>") == [f"img:{html.fnv(b'p.png'):x}", f"img:{html.fnv(b'a b'):x}:3"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="t/a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/t/a.xhtml", '<html><body><p>x<img src="../i/a%20b.png"/></p></body></html>')
        z.writestr("o/i/a b.png", PNG)
    assert [s.obj.key for s in load.read(out.getvalue(), "x.epub").blocks[0].spans if s.obj] == [key]
