"""Office formats as blocks: Word (.docx), OpenDocument (.odt, flat .fodt), Rich Text and EPUB.

Word and OpenDocument are XML and share one way of reading: styles become roles, runs become spans, lists are numbered by
their own definitions. Tracked changes are read as accepted; comments are left out.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from ..model import OBJECT, Block, Cell, Doc, Fmt, ListInfo, Obj, Row, Span, merge_spans
from . import css, html

_HEAD = re.compile(r"heading\s*(\d)$")
_TOC = re.compile(r"(?:toc|contents)\s*(\d)$")
# Style names that say what a paragraph is, and fields that change by themselves.
NAMED = {"title": "title", "subtitle": "subtitle", "caption": "caption"} | dict.fromkeys(("quote", "quotations", "intense quote", "block text"), "quote") | dict.fromkeys(("html preformatted", "plain text", "code", "source code", "preformatted text"), "code")
VOLATILE = {"PAGE", "NUMPAGES", "SECTIONPAGES", "SECTION", "DATE", "TIME", "PRINTDATE", "SAVEDATE", "EDITTIME", "NUMWORDS", "NUMCHARS", "FILESIZE"}
ODF_FIELDS = {"page-number": "PAGE", "page-count": "NUMPAGES", "date": "DATE", "time": "TIME", "title": "TITLE", "author-name": "AUTHOR", "file-name": "FILENAME"}


def role_of(name: str) -> tuple[str, int | None] | None:
    """Role and level that a style's name says; None if nothing."""
    n = name.strip().lower()
    for pattern, role in ((_HEAD, "h"), (_TOC, "toc")):
        if m := pattern.match(n):
            return role, int(m[1])
    return (NAMED[n], None) if n in NAMED else None


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element | None, name: str) -> str | None:
    """An attribute by its local name."""
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def field_key(code: str, text: str) -> str:
    return code if code in VOLATILE else f"{code}|{text}"


def atom(kind: str, key: str, fmt: Fmt, **more) -> Span:
    return Span(OBJECT, fmt, Obj(kind, key, **more))


# ------------------------------------------------------------------ Word


class _Word:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        types = ET.fromstring(self.zip.read("[Content_Types].xml"))
        main = next((attr(t, "PartName") for t in types if "main+xml" in (attr(t, "ContentType") or "")), "/word/document.xml")
        self.main = main.lstrip("/")
        self.base = posixpath.dirname(self.main)
        self.rels = {attr(r, "Id"): attr(r, "Target") for r in self._xml(f"{self.base}/_rels/{posixpath.basename(self.main)}.rels")}
        self.styles = {attr(s, "styleId"): s for s in self._xml(f"{self.base}/styles.xml") if local(s) == "style"}
        self.notes = {kind: {attr(n, "id"): "".join(t.text or "" for t in n.iter() if local(t) == "t") for n in self._xml(f"{self.base}/{kind}s.xml")} for kind in ("footnote", "endnote")}
        self._numbering()

    def _xml(self, name: str):
        return ET.fromstring(self.zip.read(name)) if name in self.names else []

    def _numbering(self) -> None:
        levels, self.lists = {}, {}
        root = self._xml(f"{self.base}/numbering.xml")
        for a in root:
            if local(a) == "abstractNum":
                levels[attr(a, "abstractNumId")] = {int(attr(v, "ilvl") or 0): v for v in a if local(v) == "lvl"}
        for n in root:
            if local(n) == "num":
                abstract = attr(child(n, "abstractNumId"), "val")
                over = {int(attr(o, "ilvl") or 0): int(s) for o in n if local(o) == "lvlOverride" and (s := attr(child(o, "startOverride"), "val"))}
                self.lists[attr(n, "numId")] = (abstract, levels.get(abstract, {}), over)

    def chain(self, style: str | None) -> list[ET.Element]:
        out = []
        while style in self.styles and len(out) < 32:
            out.append(self.styles[style])
            style = attr(child(self.styles[style], "basedOn"), "val")
        return out

    def blocks(self, parent: ET.Element) -> list[Block]:
        out: list[Block] = []
        for e in parent:
            kind = local(e)
            if kind == "p":
                out.append(self.paragraph(e))
            elif kind == "tbl":
                out.append(self.table(e))
            elif kind == "sdt":
                gallery = attr(child(e, "sdtPr", "docPartObj", "docPartGallery"), "val") or ""
                inner = self.blocks(child(e, "sdtContent") if child(e, "sdtContent") is not None else [])
                out += [Block("opaque", label=gallery, blocks=inner)] if gallery in ("Table of Contents", "Bibliographies") else inner
            elif kind in ("ins", "smartTag", "customXml", "moveTo"):
                out += self.blocks(e)
        return out

    def paragraph(self, p: ET.Element) -> Block:
        props = child(p, "pPr")
        chain = self.chain(attr(child(props, "pStyle"), "val"))
        named = next((r for s in chain if (r := role_of(attr(child(s, "name"), "val") or ""))), None)
        sources = [props, *(child(s, "pPr") for s in chain)]
        first = lambda *path: next((v for s in sources if (v := attr(child(s, *path), "val")) is not None), None)
        outline = first("outlineLvl")
        if named is None and outline is not None and int(outline) < 9:
            named = ("h", int(outline) + 1)
        role, level = named or ("p", None)
        align = {"center": "center", "right": "right", "end": "right", "both": "justify"}.get(first("jc") or "")
        block = Block(role=role, level=level, align=align, spans=merge_spans(self.inline(p, Fmt())))
        number, depth = first("numPr", "numId"), int(first("numPr", "ilvl") or 0)
        if number in self.lists:
            abstract, levels, over = self.lists[number]
            value = lambda k, name: attr(child(levels.get(k), name), "val")
            block.list = ListInfo(
                (value(depth, "numFmt") or "decimal") != "bullet", depth, abstract, number if over else None, {k: value(k, "numFmt") or "decimal" for k in levels},
                {k: over.get(k, int(value(k, "start") or 1)) for k in levels}, value(depth, "lvlText"),
            )
        return block

    def inline(self, parent: ET.Element, base: Fmt) -> list[Span]:
        out: list[Span] = []
        field: list | None = None  # code, code ended, spans
        for e in parent:
            kind = local(e)
            if kind == "r":
                for s in self.run(e, base):
                    if isinstance(s, str):  # fldChar or instrText
                        if s == "begin":
                            field = ["", False, []]
                        elif field and s == "separate":
                            field[1] = True
                        elif field and s == "end":
                            out += self.field(field[0], field[2])
                            field = None
                        elif field and not field[1]:
                            field[0] += s.removeprefix("code:")
                    elif field and field[1]:
                        field[2].append(s)
                    elif not field:
                        out.append(s)
            elif kind == "hyperlink":
                anchor = attr(e, "anchor")
                target = (self.rels.get(attr(e, "id")) or "") + (f"#{anchor}" if anchor else "")
                out += self.inline(e, base.but(href=target) if target else base)
            elif kind == "fldSimple":
                out += self.field(attr(e, "instr") or "", self.inline(e, base))
            elif kind in ("ins", "smartTag", "moveTo", "customXml"):
                out += self.inline(e, base)
            elif kind == "sdt" and child(e, "sdtContent") is not None:
                out += self.inline(child(e, "sdtContent"), base)
            elif kind in ("oMath", "oMathPara"):
                text = "".join(t.text or "" for t in e.iter() if local(t) == "t")
                out.append(atom("math", text, base, text=text))
            elif kind in ("bookmarkStart", "commentRangeStart", "commentRangeEnd"):
                out.append(Span(marker=True))
        return out

    def field(self, code: str, spans: list[Span]) -> list[Span]:
        name = (code.split() or [""])[0].upper()
        if name == "HYPERLINK":
            target = re.search(r'"([^"]*)"', code)
            return [Span(s.text, s.fmt.but(href=target[1]), s.obj) for s in spans] if target else spans
        text = "".join(s.text for s in spans)
        return [atom("field", field_key(name, text), spans[0].fmt if spans else Fmt(), text=text, label=name)]

    def run(self, r: ET.Element, base: Fmt):
        props = child(r, "rPr")
        if any(local(c) == "vanish" for c in (props if props is not None else [])):
            return
        fmt = self.fmt(props, base)
        for e in r:
            kind = local(e)
            if kind == "t":
                yield Span(e.text or "", fmt)
            elif kind in ("tab", "ptab"):
                yield Span("\t", fmt)
            elif kind in ("br", "cr"):
                yield atom("pagebreak", "page", fmt) if attr(e, "type") == "page" else Span("\n", fmt)
            elif kind in ("noBreakHyphen", "softHyphen"):
                yield Span("‑" if kind[0] == "n" else "­", fmt)
            elif kind == "fldChar":
                yield attr(e, "fldCharType") or ""
            elif kind == "instrText":
                yield "code:" + (e.text or "")
            elif kind in ("footnoteReference", "endnoteReference"):
                note = kind.removesuffix("Reference")
                text = self.notes[note].get(attr(e, "id"), "")
                yield atom(note, text, fmt, note=text)
            elif kind == "sym":
                yield atom("symbol", attr(e, "char") or "", fmt, text=chr(int(attr(e, "char") or "20", 16)))
            elif kind in ("drawing", "pict", "object"):
                yield self.drawing(e, fmt)

    def drawing(self, e: ET.Element, fmt: Fmt) -> Span:
        box = next((x for x in e.iter() if local(x) == "txbxContent"), None)
        if box is not None:
            text = "\n".join("".join(s.text for s in b.spans) for b in self.blocks(box))
            return atom("textbox", text, fmt, text=text)
        image = next((v for x in e.iter() if local(x) in ("blip", "imagedata") and (v := attr(x, "embed") or attr(x, "id"))), None)
        label = next((attr(x, "descr") or attr(x, "name") for x in e.iter() if local(x) == "docPr"), None) or "Image"
        part = posixpath.normpath(posixpath.join(self.base, self.rels.get(image) or ""))
        if part in self.names:
            data = self.zip.read(part)
            return atom("image", f"img:{html.fnv(data):x}:{len(data):x}", fmt, label=label, src=part)
        return atom("object", label, fmt, label=label)

    def fmt(self, props: ET.Element | None, base: Fmt) -> Fmt:
        if props is None:
            return base
        sources = [props, *(child(s, "rPr") for s in self.chain(attr(child(props, "rStyle"), "val")))]
        new: dict = {}
        for source in reversed([s for s in sources if s is not None]):
            for e in source:
                on = attr(e, "val") not in ("0", "false", "none", "off")
                kind = local(e)
                if kind in ("b", "i"):
                    new[kind] = on
                elif kind == "u":
                    new["u"] = on
                elif kind in ("strike", "dstrike"):
                    new["s"] = on
                elif kind == "vertAlign":
                    new |= {"sup": attr(e, "val") == "superscript", "sub": attr(e, "val") == "subscript"}
                elif kind == "highlight" and on:
                    new["hl"] = attr(e, "val")
        return base.but(**new)

    def table(self, t: ET.Element) -> Block:
        rows = []
        for r in (x for x in t if local(x) == "tr"):
            cells = []
            for c in (x for x in r if local(x) == "tc"):
                props = child(c, "tcPr")
                merge = child(props, "vMerge")
                state = None if merge is None else "restart" if attr(merge, "val") == "restart" else "continue"
                cells.append(Cell(self.blocks(c), int(attr(child(props, "gridSpan"), "val") or 1), state))
            rows.append(Row(cells, child(r, "trPr", "tblHeader") is not None))
        return Block("table", rows=rows)


def read_docx(content: bytes, name: str) -> Doc:
    word = _Word(content)
    body = child(ET.fromstring(word.zip.read(word.main)), "body")
    return Doc(name, "docx", word.blocks(body), "docx", "Word")


# ------------------------------------------------------------------ OpenDocument


class _Odf:
    def __init__(self, roots: list[ET.Element]):
        self.styles, self.lists, self.n_lists = {}, {}, 0
        for root in roots:
            for e in root.iter():
                if local(e) == "style" and attr(e, "family") in ("text", "paragraph"):
                    self.styles[attr(e, "name")] = e
                elif local(e) == "list-style":
                    self.lists[attr(e, "name")] = {int(attr(v, "level") or 1) - 1: v for v in e}

    def chain(self, name: str | None) -> list[ET.Element]:
        out = []
        while name in self.styles and len(out) < 32:
            out.append(self.styles[name])
            name = attr(self.styles[name], "parent-style-name")
        return out

    def fmt(self, style: str | None, base: Fmt) -> Fmt:
        new: dict = {}
        for s in reversed(self.chain(style)):
            props = child(s, "text-properties")
            if v := attr(props, "font-weight"):
                new["b"] = v == "bold" or (v.isdigit() and int(v) >= 600)
            if v := attr(props, "font-style"):
                new["i"] = v in ("italic", "oblique")
            for key, name in (("u", "text-underline-style"), ("s", "text-line-through-style")):
                if v := attr(props, name):
                    new[key] = v != "none"
            if v := attr(props, "text-position"):
                new |= {"sup": v.startswith("super") or v[:1].isdigit() and not v.startswith("0"), "sub": v.startswith(("sub", "-"))}
        return base.but(**new)

    def blocks(self, parent: ET.Element, lists: tuple = ()) -> list[Block]:
        out: list[Block] = []
        for e in parent:
            kind = local(e)
            if kind in ("p", "h"):
                out.append(self.paragraph(e))
            elif kind == "list":
                out += self.list(e, lists)
            elif kind == "table":
                out.append(self.table(e))
            elif kind == "section":
                out += self.blocks(e, lists)
            elif kind in ("table-of-content", "alphabetical-index", "bibliography", "illustration-index"):
                body = child(e, "index-body")
                out.append(Block("opaque", label=kind, blocks=self.blocks(body) if body is not None else []))
            elif kind == "index-title":
                out += self.blocks(e)
        return out

    def list(self, e: ET.Element, lists: tuple) -> list[Block]:
        style = attr(e, "style-name") or (lists[-1][0] if lists else None)
        self.n_lists += not lists
        key, depth = lists[0][1] if lists else attr(e, "id") or style or f"l{self.n_lists}", len(lists)
        level = self.lists.get(style, {}).get(depth)
        ordered = level is not None and local(level) == "list-level-style-number"
        forms = {"a": "lowerLetter", "A": "upperLetter", "i": "lowerRoman", "I": "upperRoman"}
        out: list[Block] = []
        for item in (x for x in e if local(x) in ("list-item", "list-header")):
            found = self.blocks(item, (*lists, (style, key)))
            if found and found[0].type == "p" and found[0].list is None and local(item) == "list-item":
                start = attr(item, "start-value") or attr(level, "start-value")
                form = forms.get(attr(level, "num-format") or "", "decimal") if ordered else "bullet"
                found[0].list = ListInfo(ordered, depth, key, formats={depth: form}, starts={depth: int(start)} if start else {})
            out += found
        return out

    def paragraph(self, e: ET.Element) -> Block:
        style = attr(e, "style-name")
        chain = self.chain(style)
        plain = lambda n: re.sub(r"_([0-9a-f]{2})_", lambda m: chr(int(m[1], 16)), n or "")
        named = next((r for n in [style, *(attr(s, "parent-style-name") for s in chain)] if (r := role_of(plain(n)))), None)
        if local(e) == "h":
            named = ("h", int(attr(e, "outline-level") or 1))
        role, level = named or ("p", None)
        align = next((v for s in chain if (v := attr(child(s, "paragraph-properties"), "text-align"))), None)
        direct = self.fmt(style, Fmt()) if role == "p" else Fmt()
        return Block(role=role, level=level, align={"center": "center", "end": "right", "right": "right", "justify": "justify"}.get(align), spans=merge_spans(self.inline(e, direct)))

    def inline(self, e: ET.Element, fmt: Fmt) -> list[Span]:
        space = lambda t: re.sub(r"[ \t\r\n]+", " ", t or "")
        out = [Span(space(e.text), fmt)]
        for c in e:
            kind = local(c)
            if kind == "span":
                out += self.inline(c, self.fmt(attr(c, "style-name"), fmt))
            elif kind == "a":
                out += self.inline(c, fmt.but(href=attr(c, "href") or ""))
            elif kind == "s":
                out.append(Span(" " * int(attr(c, "c") or 1), fmt))
            elif kind in ("tab", "line-break"):
                out.append(Span("\t" if kind == "tab" else "\n", fmt))
            elif kind == "note":
                text = "\n".join("".join(p.itertext()) for p in (child(c, "note-body") if child(c, "note-body") is not None else []))
                out.append(atom(attr(c, "note-class") or "footnote", text, fmt, note=text))
            elif kind in ODF_FIELDS:
                text = "".join(c.itertext())
                out.append(atom("field", field_key(ODF_FIELDS[kind], text), fmt, text=text, label=ODF_FIELDS[kind]))
            elif kind == "frame":
                image, box = child(c, "image"), child(c, "text-box")
                text = "\n".join("".join(s.text for s in b.spans) for b in self.blocks(box)) if box is not None else ""
                out.append(atom("textbox", text, fmt, text=text) if box is not None else atom("image", "img:" + (attr(image, "href") or ""), fmt, label=attr(c, "name") or "Image"))
            elif kind in ("bookmark", "bookmark-start", "bookmark-end"):
                out.append(Span(marker=True))
            elif kind not in ("annotation", "annotation-end", "tracked-changes", "change", "soft-page-break"):
                out += self.inline(c, fmt)
            out.append(Span(space(c.tail), fmt))
        return out

    def table(self, e: ET.Element) -> Block:
        rows: list[Row] = []
        for r in e.iter():
            if local(r) != "table-row":
                continue
            cells = []
            for c in r:
                if local(c) in ("table-cell", "covered-table-cell"):
                    tall = int(attr(c, "number-rows-spanned") or 1) > 1
                    state = "continue" if local(c)[0] == "c" else "restart" if tall else None
                    cells += [Cell(self.blocks(c), int(attr(c, "number-columns-spanned") or 1), state) for _ in range(min(64, int(attr(c, "number-columns-repeated") or 1)))]
            rows += [Row(cells) for _ in range(min(50, int(attr(r, "number-rows-repeated") or 1)))]
        return Block("table", rows=rows)


def read_odt(content: bytes, name: str) -> Doc:
    if content.startswith(b"PK"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            roots = [ET.fromstring(z.read(n)) for n in ("styles.xml", "content.xml") if n in z.namelist()]
    else:
        roots = [ET.fromstring(content)]
    return Doc(name, "odt", _Odf(roots).blocks(child(roots[-1], "body", "text")), "odt", "OpenDocument")


# ------------------------------------------------------------------ Rich Text

_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIPPED = set("fonttbl colortbl stylesheet info generator listtable listoverridetable header footer headerl headerr footerl footerr pict themedata colorschememapping latentstyles datastore xmlnstbl rsidtbl atnid atnauthor annotation pntext listtext bkmkstart bkmkend fldinst object filetbl revtbl".split())
_RTF_TEXT = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": " ", "_": "‑", "-": "­", "{": "{", "}": "}", "\\": "\\"}
_RTF_FLAGS = {"b": "b", "i": "i", "strike": "s"}


def _rtf_styles(source: bytes) -> dict[int, str]:
    found = re.findall(rb"\{(?:\\\*)?\\s(\d+)[^{}]*?([^\\{};]+);\}", source)
    return {int(n): re.sub(rb"^[a-z]+-?\d* ", b"", name).decode("cp1252", "replace").strip() for n, name in found}


def _rtf_lists(source: bytes) -> dict[int, list[bool]]:
    """Whether each level of each list (by its override number) is numbered."""
    table = {}
    for part in re.split(rb"\\list(?=\\|\{|\s)", source)[1:]:
        if m := re.search(rb"\\listid(-?\d+)", part):
            table.setdefault(int(m[1]), [int(n) != 23 for n in re.findall(rb"\\levelnfc(\d+)", part[: m.start()])])
    overrides = re.findall(rb"\\listoverride\\listid(-?\d+)[^{}]*?\\ls(\d+)", source)
    return {int(ls): table.get(int(ident), []) for ident, ls in overrides}


class _Rtf:
    def __init__(self, content: bytes):
        self.styles, self.lists = _rtf_styles(content), _rtf_lists(content)
        self.codes = iter([c.decode("cp1252", "replace").strip() for c in re.findall(rb"\\fldinst\s*\{?[^{}]*?(?<![a-z\\])([A-Z]+[^{}]*)\}", content)])
        self.out: list[Block] = []
        self.spans: list[Span] = []
        self.props: dict = {}
        self.rows: list[Row] = []
        self.cells: list[Cell] = []
        self.cell: list[Block] = []
        self.in_table = False
        self.note: list[str] | None = None
        page = re.search(rb"\\ansicpg(\d+)", content)
        self.codec = f"cp{page[1].decode()}" if page else "cp1252"
        self.run(content)

    def run(self, content: bytes) -> None:
        stack: list[tuple] = []
        fmt, skip, fallback, note_depth = Fmt(), False, 1, None
        drop, first, hexes, fields, code_of = 0, False, b"", [], ""
        for m in _RTF.finditer(content):
            word, number, code, symbol, brace, text = m.groups()
            if code and not drop:
                hexes += bytes.fromhex(code.decode())
                continue
            if hexes:
                self.text(hexes.decode(self.codec, "replace"), fmt, skip)
                hexes = b""
            if brace == b"{":
                stack.append((fmt, skip, fallback))
                first, drop = True, 0
                continue
            if brace == b"}":
                if fields and fields[-1][0] == len(stack):
                    _, start, name = fields.pop()
                    if start <= len(self.spans):
                        shown = "".join(s.text for s in self.spans[start:])
                        self.spans[start:] = [atom("field", field_key(name, shown), Fmt(), text=shown, label=name)]
                if note_depth is not None and len(stack) == note_depth:
                    text_of = "".join(self.note or []).strip()
                    self.note, note_depth = None, None
                    self.spans.append(atom("footnote", text_of, Fmt(), note=text_of))
                fmt, skip, fallback = stack.pop() if stack else (fmt, skip, fallback)
                continue
            if code:
                drop -= 1
            elif symbol:
                if symbol == b"*" and first:
                    skip = True
                else:
                    self.text(_RTF_TEXT.get(symbol.decode("latin-1"), ""), fmt, skip)
            elif text:
                cut = text[drop:] if drop else text
                drop = max(0, drop - len(text))
                self.text(cut.decode(self.codec, "replace"), fmt, skip)
            elif word:
                w, n = word.decode(), int(number) if number else None
                if w == "fldinst":
                    code_of = next(self.codes, "")
                if w == "fldrslt" and not skip:
                    name = (code_of.split() or [""])[0].upper()
                    target = re.search(r'"([^"]*)"', code_of)
                    if name == "HYPERLINK" and target:
                        fmt = fmt.but(href=target[1])
                    elif name and name not in ("HYPERLINK", "TOC"):
                        fields.append((len(stack), len(self.spans), name))
                elif w in _RTF_SKIPPED:
                    skip = True
                elif w == "footnote":
                    self.note, note_depth, skip = [], len(stack), False
                elif w == "uc":
                    fallback = n or 0
                elif w == "u":
                    self.text(chr(n % 65536), fmt, skip)
                    drop = fallback
                elif not skip:
                    fmt = self.word(w, n, fmt)
            first = False
        if self.spans:
            self.end_paragraph()
        self.end_table()

    def text(self, text: str, fmt: Fmt, skip: bool) -> None:
        if not skip and text:
            if self.note is not None:
                self.note.append(text)
            else:
                self.spans.append(Span(text, fmt))

    def word(self, w: str, n: int | None, fmt: Fmt) -> Fmt:
        on = n != 0
        if w in _RTF_FLAGS:
            return fmt.but(**{_RTF_FLAGS[w]: on})
        if w in ("ul", "ulnone"):
            return fmt.but(u=w == "ul" and on)
        if w in ("super", "sub", "nosupersub"):
            return fmt.but(sup=w == "super" and on, sub=w == "sub" and on)
        if w == "plain":
            return Fmt(href=fmt.href)
        if w in _RTF_TEXT:
            self.text(_RTF_TEXT[w], fmt, False)
        elif w == "par" and self.note is None:
            self.end_paragraph()
        elif w == "pard":
            self.props, self.in_table = {}, False
        elif w == "intbl":
            self.in_table = True
        elif w == "cell":
            self.end_paragraph(force=True)
            self.cells.append(Cell(self.cell))
            self.cell = []
        elif w == "row":
            self.rows.append(Row(self.cells))
            self.cells = []
        elif w in ("qc", "qr", "qj", "ql"):
            self.props["align"] = {"qc": "center", "qr": "right", "qj": "justify"}.get(w)
        elif w == "s" and n in self.styles and (role := role_of(self.styles[n])):
            self.props["role"], self.props["level"] = role
        elif w == "outlinelevel" and n is not None and n < 9:
            self.props |= {"role": "h", "level": n + 1}
        elif w == "ls" and n:
            self.props["list"] = ListInfo((self.lists.get(n) or [True])[0], self.props.pop("depth", 0), f"ls{n}")
        elif w == "ilvl":
            own = self.props.get("list")
            if own:
                levels = self.lists.get(int(own.key[2:])) or []
                self.props["list"] = ListInfo(levels[n] if n and n < len(levels) else own.ordered, n or 0, own.key)
            else:
                self.props["depth"] = n or 0
        elif w == "page":
            self.spans.append(atom("pagebreak", "page", fmt))
        return fmt

    def end_paragraph(self, force: bool = False) -> None:
        inside = self.in_table or force
        if not inside:
            self.end_table()
        plain = self.props.get("role") in ("h", "title")
        spans = [Span(s.text, Fmt(href=s.fmt.href), s.obj) for s in self.spans] if plain else self.spans
        block = Block(**{k: v for k, v in self.props.items() if k != "depth"}, spans=merge_spans(spans))
        (self.cell if inside else self.out).append(block)
        self.spans = []

    def end_table(self) -> None:
        if self.rows:
            self.out.append(Block("table", rows=self.rows))
            self.rows = []


def read_rtf(content: bytes, name: str) -> Doc:
    return Doc(name, "rtf", _Rtf(content).out, "rtf", "Rich Text")


# ------------------------------------------------------------------ EPUB


def stylesheets(source: str) -> list[str]:
    """Addresses of the style sheets that a page links to."""
    links = re.findall(r"<link\b[^>]*>", source, re.I)
    return [m[2] for x in links if re.search(r"stylesheet|text/css", x, re.I) and (m := re.search(r"""href\s*=\s*(["'])(.*?)\1""", x, re.I))]


def _pictures(z: zipfile.ZipFile, page: str) -> html.Images:
    """Pictures of a book by the addresses that one of its pages gives them."""

    def image(src: str) -> bytes | None:
        part = posixpath.normpath(posixpath.join(posixpath.dirname(page), unquote(src.partition("#")[0])))
        return z.read(part) if part in z.namelist() else None

    return image


def read_epub(content: bytes, name: str) -> Doc:
    """The chapters of the spine, in order, as HTML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "META-INF/encryption.xml" in z.namelist() and b"EncryptedData" in z.read("META-INF/encryption.xml") and "META-INF/rights.xml" in z.namelist():
            raise ValueError(f'"{name}" is protected against copying.')
        container = ET.fromstring(z.read("META-INF/container.xml"))
        package = next(attr(e, "full-path") for e in container.iter() if local(e) == "rootfile")
        root, base = ET.fromstring(z.read(package)), posixpath.dirname(package)
        items = {attr(e, "id"): attr(e, "href") for e in root.iter() if local(e) == "item"}
        out: list[Block] = []
        for k, ref in enumerate(e for e in root.iter() if local(e) == "itemref"):
            part = posixpath.normpath(posixpath.join(base, unquote(items.get(attr(ref, "idref")) or "")))
            if attr(ref, "linear") != "no" and part in z.namelist():
                source = z.read(part).decode("utf-8", "replace")
                sheets = [z.read(p).decode("utf-8", "replace") for h in stylesheets(source) if (p := posixpath.normpath(posixpath.join(posixpath.dirname(part), unquote(h)))) in z.namelist()]
                out += html.blocks(source, f"c{k}l", css.rules("\n".join([*sheets, *re.findall(r"<style[^>]*>(.*?)</style>", source, re.S | re.I)])), _pictures(z, part))
    return Doc(name, "epub", out, "epub", "EPUB")


READERS: dict[str, Callable[[bytes, str], Doc]] = {"docx": read_docx, "odt": read_odt, "fodt": read_odt, "rtf": read_rtf, "epub": read_epub}
