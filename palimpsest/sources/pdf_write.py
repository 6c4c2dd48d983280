"""New PDF files: blocks set on pages in the standard faces, with tags for what they are.

Lines are broken by the widths of the face; headings, list labels, tables, notes and page numbers are set as readers expect
them. Entries of a table of contents get the page of the heading they name: pages are planned once with any number, and
then written with the right ones.

Defined results: characters outside Windows-1252 are written as "?"; pictures become their labels; notes are numbered in
order and follow at the end under "Notes"; a document without blocks is one empty page.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..model import Block, Doc, Fmt, Span
from ..operators.changes import block_text, object_text
from .pdf_text import SANS, SANS_BOLD

WIDTH, HEIGHT, MARGIN, BASE = 595.0, 842.0, 72.0, 11.0
LEADING = 1.3
SIZES = {("h", 1): 20.0, ("h", 2): 16.0, ("h", 3): 13.5, ("title", None): 26.0, ("subtitle", None): 15.0}
FACES = ["Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"]
TAGS = {"title": "Title", "subtitle": "Subtitle", "quote": "BlockQuote", "code": "Code", "caption": "Caption", "toc": "TOCI"}


def face(f: Fmt) -> int:
    return (4 if f.code else 0) + (2 if f.i else 0) + (1 if f.b else 0)


def encoded(text: str) -> bytes:
    return text.encode("cp1252", "replace")


def width(text: str, k: int, size: float) -> float:
    table = SANS_BOLD if k & 1 else SANS
    return sum(600 if k >= 4 else table[c - 32] if 32 <= c < 127 else 556 for c in encoded(text)) * size / 1000


@dataclass
class Word:
    """A piece that lines are made of: text in one face; ``space``: it is white space; ``end``: a line ends here."""

    text: str
    face: int
    size: float
    rise: float = 0.0
    href: str = ""
    space: bool = False
    end: bool = False

    @property
    def w(self) -> float:
        return width(self.text, self.face, self.size)


@dataclass
class Piece:
    """A tagged stretch of text: its role, words, and where it is set."""

    role: tuple[str, ...]  # from the outermost
    words: list[Word]
    left: float = 0.0
    right: float = 0.0
    above: float = 0.0
    label: str = ""
    align: str | None = None
    group: int = 0  # pieces of one group share their outer elements
    key: str = ""  # a heading's text, or the heading an entry names
    row: list | None = None  # cells: pieces side by side


@dataclass
class Sheet:
    code: list[bytes] = field(default_factory=list)
    marks: int = 0
    links: list[tuple[str, float, float, float, float]] = field(default_factory=list)


def text_key(text: str) -> str:
    """A heading's text as entries give it: letter case, white space and a number at the end apart."""
    return re.sub(r"\s+", " ", re.sub(r"[\s.·…]*(\d+|[ivxlc]+)?$", "", text.lower())).strip()


class _Maker:
    """Blocks as pieces."""

    def __init__(self, doc: Doc):
        from .writers import labels

        self.labels = labels(doc.blocks)
        self.notes: list[str] = []
        self.group = 0

    def words(self, spans: list[Span], size: float, bold: bool = False) -> Iterator[Word]:
        for s in spans:
            if s.marker:
                continue
            f = s.fmt
            if s.obj and s.obj.kind in ("footnote", "endnote"):
                self.notes.append(s.obj.note or "")
                yield Word(str(len(self.notes)), 0, size * 0.6, size * 0.35)
                continue
            small = f.sup or f.sub
            own, rise = (size * 0.65, size * (0.35 if f.sup else -0.15)) if small else (size, 0.0)
            k = face(f) | (1 if bold else 0)
            for part in re.findall(r"\n|[^\S\n]+|\S+", object_text(s.obj) if s.obj else s.text):
                yield Word("" if part == "\n" else " " if part.isspace() else part, k, own, rise, f.href, part.isspace() and part != "\n", part == "\n")

    def block(self, b: Block, roles: tuple[str, ...] = (), left: float = 0.0, right: float = 0.0) -> Iterator[Piece]:
        if b.type == "opaque":
            self.group += 1
            own = self.group
            for x in b.blocks:
                for p in self.block(x, roles, left, right):
                    yield Piece(**(vars(p) | {"role": ("TOC", "TOCI"), "group": own, "key": text_key(block_text(x))})) if x.role == "toc" else p
        elif b.type == "table":
            yield from self.table(b, left, right)
        elif b.type == "p":
            yield self.paragraph(b, left, right)

    def paragraph(self, b: Block, left: float, right: float) -> Piece:
        level = b.level or 1
        size = SIZES.get((b.role, level if b.role == "h" else None), 12.0 if b.role == "h" else BASE)
        heavy = b.role in ("h", "title")
        words = list(self.words(b.spans, size, heavy))
        if b.list:
            depth = b.list.level
            self.group += 0 if self._listed else 1
            self._listed = True
            return Piece(("L",) * (depth + 1) + ("LI",), words, left + 18.0 * (depth + 1), right, 2.0, self.labels.get(id(b), "•"), group=self.group)
        self._listed = False
        role = (f"H{min(6, level)}" if b.role == "h" else TAGS.get(b.role, "P"),)
        indent = 24.0 if b.role == "quote" else 12.0 * (level - 1) if b.role == "toc" else 0.0
        return Piece(role, words, left + indent, right, size * 0.9 if heavy else 6.0, align=b.align, key=text_key(block_text(b)) if b.role == "h" else "")

    _listed = False

    def table(self, b: Block, left: float, right: float) -> Iterator[Piece]:
        self._listed = False
        columns = max((sum(c.colspan for c in r.cells) for r in b.rows), default=1)
        each = (WIDTH - 2 * MARGIN - left - right) / columns
        self.group += 1
        own = self.group
        for n, r in enumerate(b.rows):
            cells, at = [], 0
            for c in r.cells:
                x = left + each * at
                at += c.colspan
                gap = WIDTH - 2 * MARGIN - left - each * at + 6
                inner = [p for x_ in c.blocks for p in self.block(x_, (), x, gap)] if c.vmerge != "continue" else []
                cells.append(("TH" if r.header or c.header else "TD", [Piece(**(vars(p) | {"left": p.left, "right": gap})) for p in inner if p.row is None]))
            yield Piece(("Table", "TR"), [], left, right, 8.0 if not n else 3.0, group=own, row=cells)
        self._listed = False

    def pieces(self, doc: Doc) -> list[Piece]:
        out = [p for b in doc.blocks for p in self.block(b)]
        if self.notes:
            out.append(Piece(("P",), [Word("Notes", 1, BASE)], above=18.0))
            self.group += 1
            for k, text in enumerate(self.notes):
                words = [Word(w, 0, BASE, space=w.isspace()) for w in re.findall(r"\s+|\S+", text)]
                out.append(Piece(("Note",), words, 18.0, 0.0, 2.0, f"{k + 1}.", group=self.group))
        return out


def lines(words: list[Word], room: float) -> Iterator[list[Word]]:
    """Words broken into lines; one that is wider than a line is cut."""
    line: list[Word] = []
    at = 0.0
    queue = list(words)
    while queue:
        w = queue.pop(0)
        if w.end:
            yield line
            line, at = [], 0.0
            continue
        if at + w.w > room and not w.space:
            if line and any(not x.space for x in line):
                while line and line[-1].space:
                    line.pop()
                yield line
                line, at = [], 0.0
                queue.insert(0, w)
                continue
            if w.w > room and len(w.text) > 1:
                n = max(1, next((k for k in range(1, len(w.text)) if width(w.text[: k + 1], w.face, w.size) > room), len(w.text)))
                queue.insert(0, Word(**(vars(w) | {"text": w.text[n:]})))
                w = Word(**(vars(w) | {"text": w.text[:n]}))
        if line or not w.space:
            line.append(w)
            at += w.w
    if line:
        yield line


class _Setter:
    """Sets pieces on pages, and keeps which marks belong to which piece."""

    def __init__(self, entries: dict[tuple[str, int], int]):
        self.entries = entries
        self.sheets: list[Sheet] = [Sheet()]
        self.y = HEIGHT - MARGIN
        self.tree: list[tuple[tuple[str, ...], int, list]] = []  # role, group, kids
        self.headings: dict[tuple[str, int], int] = {}
        self.seen: dict[str, int] = {}
        self.asked: dict[str, int] = {}

    def room(self, need: float) -> None:
        if self.y - need < MARGIN and self.y < HEIGHT - MARGIN:
            self.sheets.append(Sheet())
            self.y = HEIGHT - MARGIN

    def line(self, words: list[Word], x: float, y: float, tag: str) -> tuple[int, int]:
        """Writes a line as marked content; its page and number."""
        sheet = self.sheets[-1]
        mark, sheet.marks = sheet.marks, sheet.marks + 1
        out = [b"/%s <</MCID %d>> BDC BT" % (tag.encode(), mark)]
        for w in words:
            literal = re.sub(rb"([\\()])", rb"\\\1", encoded(w.text))
            out.append(b"/F%d %.2f Tf %.2f Ts 1 0 0 1 %.2f %.2f Tm (%s) Tj" % (w.face, w.size, w.rise, x, y, literal))
            if w.href and not w.space:
                sheet.links.append((w.href, x, y - w.size * 0.2, x + w.w, y + w.size * 0.8))
            x += w.w
        sheet.code.append(b"\n".join([*out, b"ET EMC"]))
        return len(self.sheets), mark

    def set(self, p: Piece) -> list:
        """Marks of a piece's lines, set from the place on."""
        kids: list = []
        full = WIDTH - 2 * MARGIN - p.left - p.right
        words = p.words
        if p.role == ("TOC", "TOCI"):
            n = self.asked[p.key] = self.asked.get(p.key, 0) + 1
            number = self.entries.get((p.key, n))
            if number is not None:
                bare = re.sub(r"[\s.·…]*(\d+|[ivxlc]+)?$", "", "".join(w.text or " " for w in words))
                end = Word(str(number), 0, BASE)
                head = Word(bare, 0, BASE)
                dots = max(4, int((full - head.w - end.w) / width(".", 0, BASE)) - 2)
                words = [head, Word(" " + "." * dots + " ", 0, BASE), end]
        found = list(lines(words, full)) or [[]]
        for k, line in enumerate(found):
            size = max((w.size for w in line if not w.rise), default=BASE)
            self.room(size * LEADING)
            self.y -= size * LEADING
            wide = sum(w.w for w in line)
            x = MARGIN + p.left + {"center": (full - wide) / 2, "right": full - wide}.get(p.align or "", 0.0)
            if p.label and not k:
                label = p.label if "?" not in encoded(p.label).decode("cp1252") else "•"
                mark = self.line([Word(label, 0, BASE)], MARGIN + p.left - 16, self.y, "Lbl")
                kids.append(("Lbl", [mark]))
            if line:
                kids.append(self.line(line, x, self.y, "Span"))
        if p.key and p.role[0][0] == "H":
            n = self.seen[p.key] = self.seen.get(p.key, 0) + 1
            self.headings[p.key, n] = len(self.sheets)
        return kids

    def add(self, p: Piece) -> None:
        self.y -= p.above if self.y < HEIGHT - MARGIN else 0
        if p.row is None:
            kids = self.set(p)
            if p.role[-1] == "LI":
                marks = [k for k in kids if k[0] != "Lbl"]
                kids = [k for k in kids if k[0] == "Lbl"] + [("LBody", marks)]
            self.tree.append((p.role, p.group, kids))
            return
        height = max([sum(len(list(lines(x.words, WIDTH - 2 * MARGIN - x.left - x.right))) * BASE * LEADING + x.above for x in inner) for _, inner in p.row] or [0])
        self.room(min(height, HEIGHT - 2 * MARGIN - 20))
        top, low, page, cells = self.y, self.y, len(self.sheets), []
        for tag, inner in p.row:
            self.y = top if len(self.sheets) == page else self.y
            own = []
            for x in inner:
                own.append(("P", self.set(x)))
            cells.append((tag, own))
            low = min(low, self.y) if len(self.sheets) == page else self.y
        self.y = low
        self.tree.append((p.role, p.group, cells))


def to_pdf(doc: Doc) -> bytes:
    pieces = _Maker(doc).pieces(doc)
    plan = _Setter({})
    for p in pieces:
        plan.add(p)
    done = _Setter(plan.headings) if any(p.role == ("TOC", "TOCI") for p in pieces) else plan
    if done is not plan:
        for p in pieces:
            done.add(p)
    return _file(done)


def _nested(tree: list[tuple[tuple[str, ...], int, list]]) -> list:
    """Elements (tag, kids): neighbours of one group share their outer elements."""
    out: list = []
    open_: list[tuple[str, int, list]] = []
    for role, group, kids in tree:
        while open_ and (len(open_) >= len(role) or any(o[:2] != (r, group) for o, r in zip(open_, role, strict=False)) or (role[-1] == "LI" and len(open_) > len(role) - 1)):
            open_.pop()
        for tag in role[len(open_) : -1]:
            element = (tag, [])
            (open_[-1][2] if open_ else out).append(element)
            open_.append((tag, group, element[1]))
        (open_[-1][2] if open_ else out).append((role[-1], kids))
    return out


def _file(s: _Setter) -> bytes:
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    catalog, pages_, root = add(b""), add(b""), add(b"")
    fonts = [add(b"<</Type/Font/Subtype/Type1/BaseFont/%s/Encoding/WinAnsiEncoding>>" % f.encode()) for f in FACES]
    named = b" ".join(b"/F%d %d 0 R" % (k, n) for k, n in enumerate(fonts))
    sheets, parents = [], []
    for k, sheet in enumerate(s.sheets):
        foot = b"/Artifact BMC BT /F0 9 Tf 1 0 0 1 %.2f 40 Tm (%d) Tj ET EMC" % (WIDTH / 2 - 4, k + 1)
        data = zlib.compress(b"\n".join([*sheet.code, foot]))
        content = add(b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(data), data))
        notes = []
        for href, *box in sheet.links:
            uri = re.sub(rb"([\\()])", rb"\\\1", href.encode("latin-1", "replace"))
            notes.append(add(b"<</Type/Annot/Subtype/Link/Border[0 0 0]/Rect[%.2f %.2f %.2f %.2f]/A<</S/URI/URI(%s)>>>>" % (*box, uri)))
        annots = b"/Annots[%s]" % b" ".join(b"%d 0 R" % n for n in notes) if notes else b""
        sheets.append(add(b"<</Type/Page/Parent %d 0 R/MediaBox[0 0 %g %g]/Resources<</Font<<%s>>>>/Contents %d 0 R/StructParents %d%s>>" % (pages_, WIDTH, HEIGHT, named, content, k, annots)))
        parents.append([0] * sheet.marks)

    def element(tag: str, kids: list, above: int) -> int:
        own = add(b"")
        inner = []
        for k in kids:
            if isinstance(k[0], str):
                inner.append(b"%d 0 R" % element(k[0], k[1], own))
            else:
                parents[k[0] - 1][k[1]] = own
                inner.append(b"<</Type/MCR/Pg %d 0 R/MCID %d>>" % (sheets[k[0] - 1], k[1]))
        objects[own - 1] = b"<</Type/StructElem/S/%s/P %d 0 R/K[%s]>>" % (tag.encode(), above, b" ".join(inner))
        return own

    tops = [element(tag, kids, root) for tag, kids in _nested(s.tree)]
    numbers = b" ".join(b"%d [%s]" % (k, b" ".join(b"%d 0 R" % n if n else b"null" for n in own)) for k, own in enumerate(parents))
    objects[root - 1] = b"<</Type/StructTreeRoot/K[%s]/ParentTree<</Nums[%s]>>>>" % (b" ".join(b"%d 0 R" % n for n in tops), numbers)
    objects[pages_ - 1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(sheets), b" ".join(b"%d 0 R" % n for n in sheets))
    objects[catalog - 1] = b"<</Type/Catalog/Pages %d 0 R/MarkInfo<</Marked true>>/StructTreeRoot %d 0 R/Lang(en)>>" % (pages_, root)
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<</Size %d/Root %d 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, start)
    return bytes(out)
