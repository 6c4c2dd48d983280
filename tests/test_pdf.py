"""PDF files written, and read by their tags and by their layout."""

import random
import re
import zlib

import pytest

from palimpsest.model import Block, Cell, Doc, Fmt, ListInfo, Obj, Row, Span, para
from palimpsest.operators.changes import block_text
from palimpsest.sources import load, markdown, pdf, pdf_text, pdf_write, writers

LONG = "The river ran on past the stones and the old mill where nothing of note was seen by those who went there in the morning to look for it. " * 3
MIXED = f"# One\n\nA *b* **c** [e](http://f).\n\n{LONG}\n\n## Two\n\n- x\n  - y\n- z\n\nBetween é.\n\n1. z\n2. w\n\n> q\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"


def shape(blocks):
    return [(b.type, b.role, b.level, block_text(b)) for b in blocks]


def untagged(content):
    """The same file without its structure tree and marks."""
    out = content.replace(b"/StructTreeRoot", b"/NoTreeRoot____")

    def bare(m):
        data = re.sub(rb"/\w+ (<</MCID \d+>> BDC|BMC)|EMC", b"", zlib.decompress(m[2]))
        return b"<</Length %d>>\nstream\n%s\nendstream" % (len(data), data)

    return re.sub(rb"<</Length (\d+)/Filter/FlateDecode>>\nstream\n(.*?)\nendstream", bare, out, flags=re.S)


def test_round_trip_by_tags():
    d = markdown.read(MIXED, "m.md")
    got = load.read(pdf_write.to_pdf(d), "m.pdf")
    assert shape(got.blocks) == shape(d.blocks) and got.kind == "pdf"
    assert [(b.list.ordered, b.list.level) for b in got.blocks if b.type == "p" and b.list] == [(b.list.ordered, b.list.level) for b in d.blocks if b.type == "p" and b.list]
    spans = {s.text: s.fmt for s in got.blocks[1].spans}
    assert spans["b"].i and spans["c"].b and spans["e"].href == "http://f" and got.blocks[-1].rows[0].header


def test_round_trip_by_layout():
    d = markdown.read(MIXED, "m.md")
    got = load.read(untagged(pdf_write.to_pdf(d)), "m.pdf")
    assert pdf.UNTAGGED in got.notes
    found = shape(got.blocks)
    assert found[0] == ("p", "title", None, "One") and found[3] == ("p", "h", 1, "Two")  # the largest text, once
    assert [x[3] for x in found] == [x[3] for x in shape(d.blocks)] and found[-1][0] == "table"
    assert [(b.list.ordered, b.list.level) for b in got.blocks if b.type == "p" and b.list] == [(False, 0), (False, 1), (False, 0), (True, 0), (True, 0)]


def test_notes_contents_and_many_pages():
    toc = Block("opaque", label="Table of contents", blocks=[para("First\t9", role="toc", level=1), para("Last\t9", role="toc", level=1)])
    noted = Block(spans=[Span("A claim"), Span("￼", obj=Obj("footnote", "k", note="the source of it")), Span(" stands.")])
    blocks = [para("First", role="h", level=1), noted, *(para(f"Passage {k} {LONG}") for k in range(40)), para("Last", role="h", level=1), para("end")]
    content = pdf_write.to_pdf(Doc("x", "docx", [toc, *blocks]))
    pages, tree = pdf_text.pages(content)
    assert len(pages) > 4 and tree is not None
    for data in (content, untagged(content)):
        got = load.read(data, "x.pdf").blocks
        entries = [re.sub(r" \.+", "", block_text(b)) for b in got[0].blocks]
        assert got[0].type == "opaque" and entries == ["First\t1", f"Last\t{len(pages)}"]
        texts = [block_text(b).strip() for b in got[1:]]
        assert texts[0] == "First" and texts[2].startswith("Passage 0 The river") and texts[-2:] == ["Last", "end"]
        assert [s.obj.note for b in got for s in b.spans if s.obj] == ["the source of it"] and "Notes" not in texts
        assert sum(t.endswith("look for it.") for t in texts) == 40  # page breaks join again


def test_edges():
    assert load.read(pdf_write.to_pdf(Doc("x", "text", [])), "x.pdf").blocks == [] and pdf.NO_TEXT in load.read(pdf_write.to_pdf(Doc("x", "text", [])), "x.pdf").notes
    assert load.read(b"%PDF-1.4 nothing", "x.pdf").blocks == []
    locked = pdf_write.to_pdf(Doc("x", "text", [para("a")])).replace(b"/Size", b"/Encrypt 1 0 R/Size")
    with pytest.raises(load.Unreadable, match="password"):
        load.read(locked, "x.pdf")
    wide = load.read(pdf_write.to_pdf(Doc("x", "text", [para("w" * 400), para("a (b) \\c"), para("中")])), "x.pdf").blocks
    assert block_text(wide[0]).replace(" ", "") == "w" * 400 and block_text(wide[1]) == "a (b) \\c" and block_text(wide[2]) == "?"
    sides = [Block(spans=[Span("mid")], align="center"), Block(spans=[Span("far")], align="right"), para(LONG), Block("table", rows=[Row([Cell([para(LONG)]), Cell([para("x")])])])]
    got = load.read(pdf_write.to_pdf(Doc("x", "docx", sides)), "x.pdf").blocks
    assert [b.align for b in got[:2]] == ["center", "right"] and block_text(got[3]).split() == (LONG + "x").split()
    raised = Block(spans=[Span("x"), Span("2", Fmt(sup=True)), Span(" and H"), Span("3", Fmt(sub=True)), Span("O")])
    spans = load.read(pdf_write.to_pdf(Doc("x", "docx", [raised, para(LONG)])), "x.pdf").blocks[0].spans
    assert [(s.text, s.fmt.sup, s.fmt.sub) for s in spans] == [("x", False, False), ("2", True, False), (" and H", False, False), ("3", False, True), ("O", False, False)]
    assert "pdf" in writers.formats("docx") and writers.formats("pdf")[0] == "pdf"


def test_label_info():
    cases = {"•": (False, "bullet", None, "•"), "1.": (True, "decimal", 1, "%1."), "(iv)": (True, "lowerRoman", None, "(%1)"), "b)": (True, "lowerLetter", 2, "%1)"), "C.": (True, "upperLetter", 3, "%1."), "IX.": (True, "upperRoman", None, "%1."), "i.": (True, "lowerRoman", None, "%1.")}
    assert {k: pdf.label_info(k) for k in cases} == cases


def test_objects_streams_and_maps():
    """Compressed objects with a predictor, a two-byte font with a character map, and strings of both kinds."""
    flat = lambda d: zlib.compress(d)
    cmap = b"1 begincodespacerange <0000><FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 300 400]>>", b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]/Resources<</Font<</T 4 0 R>>>>>>", b"<</Type/Font/Subtype/Type0/BaseFont/ABCDEF+Some-BoldItalic/DescendantFonts[<</W[1[500 600]16 18 400]/DW 900>>]/ToUnicode 6 0 R>>"]
    heads, at = [], 0
    for k, x in enumerate(inner):
        heads.append(b"%d %d" % (k + 1, at))
        at += len(x) + 1
    first = b" ".join(heads) + b" "
    packed = first + b"\n".join(inner)
    rows = b"".join(b"\x02" + bytes((packed[i + j] - (packed[i + j - 8] if i else 0)) & 255 if i + j < len(packed) else (0 - (packed[i + j - 8] if i + j - 8 < len(packed) else 0)) & 255 for j in range(8)) for i in range(0, len(packed), 8))
    body = b"BT /T 10 Tf 50 300 Td <00010002> Tj 0 -12 Td [<0010> -250 <0011>] TJ ET"
    parts = {5: (b"", body), 6: (b"/Filter/FlateDecode", flat(cmap)), 7: (b"/Type/ObjStm/N 4/First %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 8>>" % len(first), flat(rows))}
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n<<%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (n, h, len(s), s) for n, (h, s) in parts.items())
    pages, _ = pdf_text.pages(data)
    runs = [(r.text, r.x, r.y, round(r.w, 2), r.size, r.weight, r.italic) for r in pages[0].runs]
    assert runs == [("Hfi", 50.0, 300.0, 11.0, 10.0, 700, True), ("a b", 50.0, 288.0, 10.5, 10.0, 700, True)]


def test_random_documents_by_tags():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    for _ in range(15):
        blocks = []
        for _ in range(rng.randint(1, 40)):
            kind = rng.randrange(5)
            if kind == 0:
                blocks.append(para(text(3), role="h", level=rng.randint(1, 3)))
            elif kind == 1:
                blocks.append(para(text(rng.randint(1, 30)), list=ListInfo(rng.random() < 0.5, rng.randrange(2), "k")))
            elif kind == 2:
                blocks.append(Block("table", rows=[Row([Cell([para(text(2))]), Cell([para(text(5))])]) for _ in range(3)]))
            else:
                blocks.append(para(text(rng.randint(1, 120))))
        got = load.read(pdf_write.to_pdf(Doc("x", "docx", blocks)), "x.pdf").blocks
        assert [block_text(b) for b in got] == [block_text(b) for b in blocks]
        assert [(b.type, b.role, b.level) for b in got] == [(b.type, b.role, b.level) for b in blocks]
