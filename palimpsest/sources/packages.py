"""Merged results written into the files they came from: .docx and .odt packages edited in place.

A merge says which blocks the result has, in order: blocks of the target, of the source, and changed ones
(``operators.merge``). A backend keeps the target's own XML for its blocks and every part of the package it does not
touch; blocks of a source of the same kind come with their XML, the styles, lists, links, pictures and notes it uses;
others are written from the model. There is a backend for each kind of package, and one for documents without one.

Defined results: a null target is written as a new file; blocks are known by their place in the file (an id that ends in
":place"), and an id that neither file has is written from its body; a removed paragraph that ends a section leaves an
empty one with the section; bookmarks and comment anchors of a replaced paragraph go to what takes its place.
"""

from __future__ import annotations

import copy
import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Block, Doc, dumps, loads
from ..storage import tune
from . import opendocument, writers
from .office import _Word, attr, child, local

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Anchors that stay with a place, and things that name a place of the other file.
ANCHORS = {"bookmarkStart", "bookmarkEnd", "commentRangeStart", "commentRangeEnd"}
STRIPPED = ANCHORS | {"proofErr", "permStart", "permEnd", "sectPr", "lastRenderedPageBreak"}


@dataclass
class Piece:
    """A block of a merged result: its id, its body, and where it is from (own: the target as it was; copied: the source)."""

    id: str
    body: str
    origin: str


class Backend(Protocol):
    def apply(self, target: bytes | None, source: bytes | None, pieces: list[Piece]) -> bytes:
        """The target's file with the pieces as its blocks."""


def _register(xml: bytes) -> None:
    """Keep the prefixes that a file declares."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(xml), events=("start-ns",)):
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)


class Parts:
    """The parts of a package: XML parts are parsed where they are asked for, and written back if they were; the others
    are copied as bytes."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.files = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
            self.stored = {i.filename for i in z.infolist() if i.compress_type == zipfile.ZIP_STORED}
        self.parsed: dict[str, ET.Element] = {}

    def xml(self, name: str, empty: str | None = None) -> ET.Element | None:
        if name not in self.parsed:
            if name not in self.files and empty is None:
                return None
            raw = self.files.get(name) or empty.encode()
            _register(raw)
            self.parsed[name] = ET.fromstring(raw)
        return self.parsed[name]

    def add(self, name: str, data: bytes) -> str:
        """A part with these bytes: one that is there already, or a new one under a free name."""
        same = next((n for n, d in self.files.items() if posixpath.dirname(n) == posixpath.dirname(name) and d == data), None)
        if same:
            return same
        stem, dot, ext = name.rpartition(".")
        free, k = name, 1
        while free in self.files:
            free, k = f"{stem}-{k}{dot}{ext}", k + 1
        self.files[free] = data
        return free

    def save(self) -> bytes:
        for name, root in self.parsed.items():
            self.files[name] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(self.files, key=lambda n: (n != "mimetype", n != "[Content_Types].xml")):
                z.writestr(zipfile.ZipInfo(name), self.files[name], zipfile.ZIP_STORED if name in self.stored else zipfile.ZIP_DEFLATED)
        return out.getvalue()


def _parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {c: p for p in root.iter() for c in p}


def _place(piece_id: str) -> int | None:
    tail = piece_id.rpartition(":")[2]
    return int(tail) if tail.isdigit() else None


def _edit(root: ET.Element, own: list[ET.Element], pieces: list[Piece], made: Callable[[Piece, ET.Element | None], list[ET.Element]], leave: Callable[[ET.Element, list[ET.Element]], ET.Element | None]) -> None:
    """Makes ``own``, the elements of a target's blocks, into the pieces.

    Own pieces stay where they are. New ones go behind the piece before them, in its container, and what is left out goes,
    unless ``leave`` (given the elements that take its place) has something to leave behind.
    """
    parents = _parents(root)
    kept = {_place(p.id) for p in pieces if p.origin == "own"}
    after: ET.Element | None = None
    fresh: dict[int, list[ET.Element]] = {}  # by the place in ``own`` that they stand before
    at = 0
    for p in pieces:
        place = _place(p.id)
        if p.origin == "own" and place is not None and place < len(own):
            after, at = own[place], place + 1
            continue
        for e in made(p, after):
            if after is None:
                first = own[0] if own else None
                holder = parents.get(first, root) if first is not None else root
                holder.insert(list(holder).index(first) if first is not None else 0, e)
            else:
                holder = parents[after]
                holder.insert(list(holder).index(after) + 1, e)
            parents[e] = holder
            after = e
            fresh.setdefault(at, []).append(e)
    for k, e in enumerate(own):
        if k in kept:
            continue
        holder = parents[e]
        left = leave(e, fresh.get(k, []) or fresh.get(k + 1, []))
        if left is not None:
            holder.insert(list(holder).index(e), left)
        holder.remove(e)


# ------------------------------------------------------------------ Word


def _w(name: str) -> str:
    return f"{{{W}}}{name}"


class _Imports:
    """Copies XML of one Word file into another, with what it refers to."""

    def __init__(self, target: Parts, base: str, main: str, source: Parts | None, source_base: str, source_main: str):
        self.target, self.base, self.main = target, base, main
        self.source, self.source_base, self.source_main = source, source_base, source_main
        self.styles: dict[str, str] = {}
        self.nums: dict[str, str] = {}
        self.rels: dict[str, str] = {}

    def part(self, name: str, root: str) -> ET.Element:
        return self.target.xml(f"{self.base}/{name}.xml", f'<w:{root} xmlns:w="{W}"/>')

    def fix(self, e: ET.Element) -> ET.Element:
        out = copy.deepcopy(e)
        parents = _parents(out)
        for x in list(out.iter()):
            kind = local(x)
            if kind in STRIPPED and x in parents:
                parents[x].remove(x)
            elif kind in ("pStyle", "rStyle", "tblStyle"):
                self._set(x, _w("val"), self.style(attr(x, "val") or ""))
            elif kind == "numId":
                self._set(x, _w("val"), self.num(attr(x, "val") or ""))
            elif kind in ("footnoteReference", "endnoteReference"):
                self._set(x, _w("id"), self.note(kind.removesuffix("Reference"), attr(x, "id") or ""))
            for key in [k for k in x.attrib if k.startswith(f"{{{R}}}")]:
                x.attrib[key] = self.rel(x.attrib[key])
            for key in [k for k in x.attrib if k.rpartition("}")[2].startswith("rsid")]:
                del x.attrib[key]
        return out

    @staticmethod
    def _set(x: ET.Element, key: str, value: str) -> None:
        x.attrib[next((k for k in x.attrib if k.rpartition("}")[2] == key.rpartition("}")[2]), key)] = value

    def style(self, ident: str) -> str:
        """The style of the same type and name, or a copy under a free id, with what it builds on."""
        if ident in self.styles or self.source is None:
            return self.styles.get(ident, ident)
        there, here = self.source.xml(f"{self.source_base}/styles.xml"), self.part("styles", "styles")
        own = next((s for s in (there if there is not None else ()) if local(s) == "style" and attr(s, "styleId") == ident), None)
        if own is None:
            return ident
        name = (attr(child(own, "name"), "val") or "").lower()
        taken = [s for s in here if local(s) == "style"]
        same = next((s for s in taken if attr(s, "type") == attr(own, "type") and (attr(child(s, "name"), "val") or "").lower() == name), None)
        if same is not None:
            self.styles[ident] = attr(same, "styleId") or ident
            return self.styles[ident]
        ids, free, k = {attr(s, "styleId") for s in taken}, ident, 1
        while free in ids:
            free, k = f"{ident}{k}", k + 1
        self.styles[ident] = free
        new = copy.deepcopy(own)
        self._set(new, _w("styleId"), free)
        here.append(new)
        for x in new.iter():
            if local(x) in ("basedOn", "next", "link"):
                self._set(x, _w("val"), self.style(attr(x, "val") or ""))
            elif local(x) == "numId":
                self._set(x, _w("val"), self.num(attr(x, "val") or ""))
        return free

    def num(self, ident: str) -> str:
        """A copy of a list: a new abstract one, before the first number, and a new number."""
        if ident in ("", "0") or self.source is None or ident in self.nums:
            return self.nums.get(ident, ident)
        there, here = self.source.xml(f"{self.source_base}/numbering.xml"), self.part("numbering", "numbering")
        number = next((n for n in (there if there is not None else ()) if local(n) == "num" and attr(n, "numId") == ident), None)
        if number is None:
            return ident
        of = attr(child(number, "abstractNumId"), "val")
        abstract = next((a for a in there if local(a) == "abstractNum" and attr(a, "abstractNumId") == of), None)
        free = lambda kind, key: str(1 + max((int(attr(x, key) or 0) for x in here if local(x) == kind), default=0))
        new_abstract, new_num = free("abstractNum", "abstractNumId"), free("num", "numId")
        self.nums[ident] = new_num
        if abstract is not None:
            a = copy.deepcopy(abstract)
            self._set(a, _w("abstractNumId"), new_abstract)
            for x in [x for x in a if local(x) in ("nsid", "tmpl")]:
                a.remove(x)
            first = next((k for k, x in enumerate(here) if local(x) == "num"), len(here))
            here.insert(first, a)
        n = copy.deepcopy(number)
        self._set(n, _w("numId"), new_num)
        self._set(child(n, "abstractNumId"), _w("val"), new_abstract)
        here.append(n)
        self.related("numbering")
        return new_num

    def note(self, kind: str, ident: str) -> str:
        """A copy of a note under the next free id."""
        there = self.source.xml(f"{self.source_base}/{kind}s.xml") if self.source else None
        own = next((n for n in (there if there is not None else ()) if attr(n, "id") == ident), None)
        if own is None:
            return ident
        here = self.part(f"{kind}s", f"{kind}s")
        new = self.fix(own)
        free = str(1 + max([0, *(int(attr(n, "id") or 0) for n in here)]))
        self._set(new, _w("id"), free)
        here.append(new)
        self.related(f"{kind}s")
        return free

    def new_note(self, kind: str, text: str) -> str:
        """A note of plain text under the next free id."""
        here = self.part(f"{kind}s", f"{kind}s")
        free = str(1 + max([0, *(int(attr(n, "id") or 0) for n in here)]))
        note = ET.SubElement(here, _w(kind), {_w("id"): free})
        ET.SubElement(ET.SubElement(ET.SubElement(note, _w("p")), _w("r")), _w("t")).text = text
        self.related(f"{kind}s")
        return free

    def new_picture(self, data: bytes, ext: str) -> str:
        name = self.target.add(f"{self.base}/media/image1.{ext}", data)
        types = self.target.xml("[Content_Types].xml")
        if not any((attr(t, "Extension") or "").lower() == ext for t in types):
            types.insert(0, ET.Element(f"{{{PACKAGE}/content-types}}Default", {"Extension": ext, "ContentType": f"image/{ext}"}))
        return self.relate("image", posixpath.relpath(name, self.base))

    def _rels(self, parts: Parts, base: str, main: str) -> ET.Element:
        return parts.xml(f"{base}/_rels/{posixpath.basename(main)}.rels", f'<Relationships xmlns="{PACKAGE}/relationships"/>')

    def relate(self, kind: str, target: str, external: bool = False) -> str:
        """The id of a relationship of the target; a new one where it has none like it."""
        rels = self._rels(self.target, self.base, self.main)
        full = kind if "://" in kind else f"{R}/{kind}"
        same = next((r for r in rels if attr(r, "Type") == full and attr(r, "Target") == target), None)
        if same is not None:
            return attr(same, "Id")
        ids, k = {attr(r, "Id") for r in rels}, 1
        while f"rId{k}" in ids:
            k += 1
        r = ET.SubElement(rels, f"{{{PACKAGE}/relationships}}Relationship", {"Id": f"rId{k}", "Type": full, "Target": target})
        if external:
            r.set("TargetMode", "External")
        return f"rId{k}"

    def related(self, name: str) -> None:
        """Makes sure that a part is declared and related."""
        self.relate(name, f"{name}.xml")
        types = self.target.xml("[Content_Types].xml")
        part = f"/{self.base}/{name}.xml"
        if not any(attr(t, "PartName") == part for t in types):
            ET.SubElement(types, f"{{{PACKAGE}/content-types}}Override", {"PartName": part, "ContentType": f"application/vnd.openxmlformats-officedocument.wordprocessingml.{name}+xml"})

    def rel(self, ident: str) -> str:
        """A copy of a relationship: links by address, pictures by their bytes."""
        if ident in self.rels or self.source is None:
            return self.rels.get(ident, ident)
        own = next((r for r in self._rels(self.source, self.source_base, self.source_main) if attr(r, "Id") == ident), None)
        if own is None:
            return ident
        target, external = attr(own, "Target") or "", attr(own, "TargetMode") == "External"
        part = posixpath.normpath(posixpath.join(self.source_base, target))
        if not external and part in self.source.files:
            copied = self.target.add(f"{self.base}/{posixpath.relpath(part, self.source_base)}", self.source.files[part])
            target = posixpath.relpath(copied, self.base)
            self.content_type(part, copied)
        self.rels[ident] = self.relate(attr(own, "Type") or "", target, external)
        return self.rels[ident]

    def content_type(self, part: str, copied: str) -> None:
        there, here = self.source.xml("[Content_Types].xml"), self.target.xml("[Content_Types].xml")
        ext = copied.rpartition(".")[2]
        if not any((attr(t, "Extension") or "").lower() == ext.lower() or attr(t, "PartName") == f"/{copied}" for t in here):
            kind = next((attr(t, "ContentType") for t in there if attr(t, "PartName") == f"/{part}" or (attr(t, "Extension") or "").lower() == ext.lower()), "application/octet-stream")
            here.insert(0, ET.Element(f"{{{PACKAGE}/content-types}}Default", {"Extension": ext, "ContentType": kind}))


class _WordWriter(writers._WordFile):
    """Blocks of any document as XML for an existing Word file."""

    def __init__(self, imports: _Imports):
        self.imports, self.links, self.lists, self.kinds = imports, {}, {}, {}

    def note(self, kind: str, text: str) -> str:
        return self.imports.new_note(kind, text)

    def picture(self, data: bytes, ext: str) -> str:
        return self.imports.new_picture(data, ext)

    def element(self, b: Block, near: ET.Element | None) -> list[ET.Element]:
        self.links, self.lists, self.kinds = {}, {}, {}
        xml = self.block(b)
        root = ET.fromstring(f'<w:x xmlns:w="{W}" xmlns:r="{R}">{xml}</w:x>')
        ids = {v: self.imports.relate("hyperlink", k, True) for k, v in self.links.items()}
        nums = {str(n): self._joined(b, near) or self._new(levels) for n, levels in self.kinds.items()}
        for x in root.iter():
            if local(x) == "hyperlink":
                x.attrib[f"{{{R}}}id"] = ids[x.attrib[f"{{{R}}}id"]]
            elif local(x) == "numId":
                x.attrib[_w("val")] = nums[x.attrib[_w("val")]]
            elif local(x) == "pStyle":
                x.attrib[_w("val")] = self._style(x.attrib[_w("val")])
        return list(root)

    def _joined(self, b: Block, near: ET.Element | None) -> str | None:
        """The list of the paragraph before, if it is one of the same kind."""
        ident = attr(child(near, "pPr", "numPr", "numId"), "val")
        numbering = self.imports.target.xml(f"{self.imports.base}/numbering.xml")
        if ident is None or numbering is None or b.list is None:
            return None
        of = next((attr(child(n, "abstractNumId"), "val") for n in numbering if local(n) == "num" and attr(n, "numId") == ident), None)
        forms = [attr(child(v, "numFmt"), "val") for a in numbering if local(a) == "abstractNum" and attr(a, "abstractNumId") == of for v in a if local(v) == "lvl"]
        return ident if forms and (forms[0] != "bullet") == b.list.ordered else None

    def _new(self, levels: dict) -> str:
        here = self.imports.part("numbering", "numbering")
        free = lambda kind, key: 1 + max((int(attr(x, key) or 0) for x in here if local(x) == kind), default=0)
        self.kinds = {free("num", "numId"): levels}
        fresh, abstract = ET.fromstring(self.numbering()), str(free("abstractNum", "abstractNumId"))
        for x in list(fresh):
            if local(x) == "abstractNum":
                x.attrib[_w("abstractNumId")] = abstract
                here.insert(next((k for k, y in enumerate(here) if local(y) == "num"), len(here)), x)
            else:
                child(x, "abstractNumId").attrib[_w("val")] = abstract
                here.append(x)
        self.imports.related("numbering")
        return str(next(iter(self.kinds)))

    def _style(self, ident: str) -> str:
        """The target's style of the same built-in name; a new one where it has none."""
        name = re.sub(r"^(heading|toc)(\d)$", r"\1 \2", ident.lower()) if ident != "HTMLPreformatted" else "html preformatted"
        here = self.imports.part("styles", "styles")
        same = next((s for s in here if local(s) == "style" and (attr(child(s, "name"), "val") or "").lower() == name), None)
        if same is None:
            same = ET.SubElement(here, _w("style"), {_w("type"): "paragraph", _w("styleId"): ident})
            ET.SubElement(same, _w("name"), {_w("val"): name})
            self.imports.related("styles")
        return attr(same, "styleId") or ident


def _word_elements(word: _Word, parent: ET.Element) -> list[ET.Element]:
    """The elements of a body's blocks, in the order in which they are read."""
    out = []
    for e in parent:
        kind = local(e)
        if kind in ("p", "tbl"):
            out.append(e)
        elif kind == "sdt":
            gallery = attr(child(e, "sdtPr", "docPartObj", "docPartGallery"), "val") or ""
            inner = child(e, "sdtContent")
            out += [e] if gallery in ("Table of Contents", "Bibliographies") else _word_elements(word, inner) if inner is not None else []
        elif kind in ("ins", "smartTag", "customXml", "moveTo"):
            out += _word_elements(word, e)
    return out


class DocxBackend:
    """Edits the document part of a Word package."""

    kind = "docx"

    def apply(self, target: bytes | None, source: bytes | None, pieces: list[Piece]) -> bytes:
        if target is None:
            return writers.to_docx(Doc("merged", "docx", [loads(p.body) for p in pieces]))
        word, parts = _Word(target), Parts(target)
        body = child(parts.xml(word.main), "body")
        own = _word_elements(word, body)
        theirs, source_parts, other = [], None, None
        if source is not None and source.startswith(b"PK") and "[Content_Types].xml" in zipfile.ZipFile(io.BytesIO(source)).namelist():
            other, source_parts = _Word(source), Parts(source)
            theirs = _word_elements(other, child(source_parts.xml(other.main), "body"))
        imports = _Imports(parts, word.base, word.main, source_parts, other.base if other else "", other.main if other else "")
        writer = _WordWriter(imports)

        def made(p: Piece, near: ET.Element | None) -> list[ET.Element]:
            place = _place(p.id)
            if p.origin == "copied" and place is not None and place < len(theirs):
                return [imports.fix(theirs[place])]
            new = writer.element(loads(p.body), near)
            if p.origin == "changed" and place is not None and place < len(own) and local(own[place]) == "p" and local(new[0]) == "p":
                props = child(own[place], "pPr")  # a changed paragraph keeps its own properties
                mine = child(new[0], "pPr")
                if mine is not None:
                    new[0].remove(mine)
                if props is not None:
                    new[0].insert(0, copy.deepcopy(props))
            return new

        _edit(body, own, pieces, made, self._leave)
        return parts.save()

    @staticmethod
    def _leave(gone: ET.Element, instead: list[ET.Element]) -> ET.Element | None:
        """Anchors go to what takes the place; a section's end stays in an empty paragraph, unless it is there already."""
        heir = next((e for e in instead if local(e) == "p"), None)
        anchors = [copy.deepcopy(x) for x in gone.iter() if local(x) in ANCHORS]
        if heir is not None:
            start = 1 if child(heir, "pPr") is not None else 0
            for x in reversed(anchors):
                heir.insert(start, x)
        section = child(gone, "pPr", "sectPr")
        if section is None or (heir is not None and child(heir, "pPr", "sectPr") is not None):
            return None
        left = ET.Element(_w("p"))
        ET.SubElement(left, _w("pPr")).append(section)
        return left


# ------------------------------------------------------------------ OpenDocument

_O = {k: f"{{{v}}}" for k, v in opendocument.SPACES.items()}


def _odt_elements(parent: ET.Element) -> list[ET.Element]:
    out = []
    for e in parent:
        kind = local(e)
        if kind in ("p", "h", "table", "table-of-content", "alphabetical-index", "bibliography", "illustration-index"):
            out.append(e)
        elif kind in ("list", "list-item", "list-header", "section", "index-title"):
            out += _odt_elements(e)
    return out


class OdtBackend:
    """Edits the content part of an OpenDocument package, or a flat file."""

    kind = "odt"

    def apply(self, target: bytes | None, source: bytes | None, pieces: list[Piece]) -> bytes:
        if target is None:
            return opendocument.to_odt(Doc("merged", "odt", [loads(p.body) for p in pieces]))
        flat = not target.startswith(b"PK")
        parts = None if flat else Parts(target)
        if flat:
            _register(target)
        root = ET.fromstring(target) if flat else parts.xml("content.xml")
        body = child(root, "body", "text")
        own, theirs, other, other_parts = _odt_elements(body), [], None, None
        if source is not None and (not source.startswith(b"PK") or "content.xml" in zipfile.ZipFile(io.BytesIO(source)).namelist()):
            other_parts = Parts(source) if source.startswith(b"PK") else None
            try:
                other = other_parts.xml("content.xml") if other_parts else ET.fromstring(source)
            except ET.ParseError:
                other = None
            there = child(other, "body", "text")
            theirs = _odt_elements(there) if there is not None else []
        copies = _OdtImports(root, parts, other, other_parts)
        prefix = "m" + hashlib.sha1(target).hexdigest()[:6]
        writer = opendocument.Writer(prefix)
        above = _parents(other) if other is not None else {}

        def made(p: Piece, _near: ET.Element | None) -> list[ET.Element]:
            place, block = _place(p.id), loads(p.body)
            if p.origin == "copied" and place is not None and place < len(theirs):
                fixed = copies.fix(theirs[place])
                if block.type != "p" or block.list is None:
                    return [fixed]
                return [self._wrapped(fixed, copies.list_style(self._style_of(theirs[place], above)), block.list.level)]
            xml = writer.blocks([block])
            return list(ET.fromstring(f"<x {opendocument._NAMES}>{xml}</x>"))

        self._insert(body, own, pieces, made)
        auto = child(root, "automatic-styles")
        if auto is None:
            auto = ET.Element(_O["office"] + "automatic-styles")
            root.insert(list(root).index(child(root, "body")), auto)
        auto.extend(ET.fromstring(f"<x {opendocument._NAMES}>{writer.styles()}</x>"))
        if flat:
            return ET.tostring(root, encoding="UTF-8", xml_declaration=True)
        return parts.save()

    @staticmethod
    def _wrapped(item: ET.Element, style: str | None, level: int) -> ET.Element:
        """An item in lists of its own, as deep as it was."""
        out = item
        for _ in range(level + 1):
            holder = ET.Element(_O["text"] + "list")
            ET.SubElement(holder, _O["text"] + "list-item").append(out)
            out = holder
        if style:
            out.set(_O["text"] + "style-name", style)
        return out

    @staticmethod
    def _style_of(e: ET.Element, above: dict) -> str | None:
        while e in above:
            e = above[e]
            if local(e) == "list" and (name := attr(e, "style-name")):
                return name
        return None

    def _insert(self, body: ET.Element, own: list[ET.Element], pieces: list[Piece], made) -> None:
        """As ``_edit``, but a new block behind an item of a list splits the list at its top, and what edits leave empty goes."""
        parents = _parents(body)
        kept = {_place(p.id) for p in pieces if p.origin == "own"}
        after: ET.Element | None = None

        def top(e: ET.Element) -> ET.Element:
            while parents.get(e) is not None and local(parents[e]) in ("list", "list-item", "list-header"):
                e = parents[e]
            return e

        def split(e: ET.Element) -> ET.Element:
            """The part of e's outermost list up to e; what follows becomes a list of its own behind it."""
            outer, rest = top(e), None
            while e is not outer:
                holder = parents[e]
                later = list(holder)[list(holder).index(e) + 1 :]
                shell = ET.Element(holder.tag, {k: v for k, v in holder.attrib.items() if not k.endswith("}id")})
                if rest is not None:
                    shell.append(rest)
                    parents[rest] = shell
                for x in later:
                    holder.remove(x)
                    shell.append(x)
                    parents[x] = shell
                rest, e = (shell if len(shell) else None), holder
            if rest is not None:
                rest.set(_O["text"] + "continue-numbering", "true")
                above = parents[outer]
                above.insert(list(above).index(outer) + 1, rest)
                parents[rest] = above
            return outer

        for p in pieces:
            place = _place(p.id)
            if p.origin == "own" and place is not None and place < len(own):
                after = own[place]
                continue
            for e in made(p, after):
                if after is None:
                    first = top(own[0]) if own else None
                    holder = parents[first] if first is not None else body
                    holder.insert(list(holder).index(first) if first is not None else len(holder), e)
                else:
                    before = split(after)
                    holder = parents[before]
                    holder.insert(list(holder).index(before) + 1, e)
                parents[e] = holder
                parents |= _parents(e)
                after = e
        for k, e in enumerate(own):
            if k in kept:
                continue
            while True:
                holder = parents[e]
                holder.remove(e)
                if local(holder) not in ("list", "list-item", "list-header") or len(holder):
                    break
                e = holder


class _OdtImports:
    """Copies XML of one OpenDocument text into another, with its automatic styles, list styles and pictures."""

    def __init__(self, root: ET.Element, parts: Parts | None, other: ET.Element | None, other_parts: Parts | None):
        self.root, self.parts, self.other, self.other_parts = root, parts, other, other_parts
        self.names: dict[tuple[str, str], str] = {}

    def _styles(self, root: ET.Element | None) -> list[ET.Element]:
        found = child(root, "automatic-styles")
        return list(found) if found is not None else []

    def _signed(self, e: ET.Element) -> str:
        """What a style says, apart from its name."""
        bare = copy.deepcopy(e)
        for k in [k for k in bare.attrib if k == _O["style"] + "name"]:
            del bare.attrib[k]
        return ET.tostring(bare, encoding="unicode")

    def automatic(self, name: str, kind: str) -> str:
        """An automatic style: one that says the same, or a copy under a free name. Named styles keep their names."""
        if (kind, name) in self.names:
            return self.names[kind, name]
        own = next((s for s in self._styles(self.other) if attr(s, "name") == name and local(s) == kind), None)
        if own is None:
            return name
        here, signed = self._styles(self.root), self._signed(own)
        same = next((s for s in here if local(s) == kind and self._signed(s) == signed), None)
        free, k = name, 1
        taken = {attr(s, "name") for s in here}
        while same is None and free in taken:
            free, k = f"{name}_{k}", k + 1
        self.names[kind, name] = attr(same, "name") if same is not None else free
        if same is None:
            holder = child(self.root, "automatic-styles")
            if holder is None:
                holder = ET.Element(_O["office"] + "automatic-styles")
                self.root.insert(list(self.root).index(child(self.root, "body")), holder)
            new = copy.deepcopy(own)
            new.set(_O["style"] + "name", free)
            holder.append(new)
            if based := attr(new, "list-style-name"):
                new.set(_O["style"] + "list-style-name", self.automatic(based, "list-style"))
        return self.names[kind, name]

    def list_style(self, name: str | None) -> str | None:
        return self.automatic(name, "list-style") if name else None

    def fix(self, e: ET.Element) -> ET.Element:
        out = copy.deepcopy(e)
        out.tail = None
        parents = _parents(out)
        for x in list(out.iter()):
            kind = local(x)
            if kind in ("bookmark", "bookmark-start", "bookmark-end", "annotation", "annotation-end", "change", "change-start", "change-end", "object") and x in parents:
                holder = parents[x]
                before = list(holder).index(x)
                if x.tail:
                    if before:
                        holder[before - 1].tail = (holder[before - 1].tail or "") + x.tail
                    else:
                        holder.text = (holder.text or "") + x.tail
                holder.remove(x)
                continue
            for key in [k for k in x.attrib if k.rpartition("}")[2] == "style-name"]:
                x.attrib[key] = self.automatic(x.attrib[key], "list-style" if kind == "list" else "style")
            for key in [k for k in x.attrib if k.endswith("}id")]:
                del x.attrib[key]
            href = x.attrib.get(_O["xlink"] + "href", "")
            if kind == "image" and href and self.other_parts and href in self.other_parts.files and self.parts:
                x.attrib[_O["xlink"] + "href"] = self.picture(href)
        return out

    def picture(self, href: str) -> str:
        name = self.parts.add(href, self.other_parts.files[href])
        manifest = self.parts.xml("META-INF/manifest.xml")
        if manifest is not None and not any(attr(f, "full-path") == name for f in manifest):
            space = manifest.tag.rpartition("}")[0] + "}"
            ET.SubElement(manifest, space + "file-entry", {space + "full-path": name, space + "media-type": f"image/{name.rpartition('.')[2]}"})
        return name


# ------------------------------------------------------------------ documents without a package, and columns


class ModelBackend:
    """Writes the merged blocks as a new file of a kind."""

    def __init__(self, kind: str):
        self.kind = kind

    def apply(self, target: bytes | None, source: bytes | None, pieces: list[Piece]) -> bytes:
        out = writers.WRITERS[writers.formats(self.kind)[0]](Doc("merged", self.kind, [loads(p.body) for p in pieces]))
        return out if isinstance(out, bytes) else out.encode()


def backend(kind: str) -> Backend:
    """The backend of a kind of document."""
    return {"docx": DocxBackend, "odt": OdtBackend, "fodt": OdtBackend}[kind]() if kind in ("docx", "odt", "fodt") else ModelBackend(kind)


def edited_files(merged: DataFrame, files: DataFrame) -> DataFrame:
    """pair_id and content of each pair's target file after a merge.

    ``merged``: pair_id, pos, id, body, copied and had (the target's own body of the block; null if new), as ``pieces`` gives
    it; ``files``: pair_id, kind (of the target), target and source (their bytes; null if there is no file).
    """
    tune(merged.sparkSession)
    piece = F.struct("pos", "id", "body", "origin")
    lists = merged.groupBy("pair_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair, kind, target, source, pieces in batch.itertuples(index=False):
                found = [Piece(x["id"], x["body"], x["origin"]) for x in (pieces if pieces is not None else ())]
                out.append((pair, backend(kind).apply(bytes(target) if target is not None else None, bytes(source) if source is not None else None, found)))
            yield pd.DataFrame(out, columns=["pair_id", "content"])

    joined = files.join(lists, "pair_id", "left").select("pair_id", "kind", "target", "source", "p")
    return joined.mapInPandas(kernel, "pair_id string, content binary")


def pieces(merged: DataFrame, target: DataFrame) -> DataFrame:
    """Merged blocks with their origin: own (the target's body as it was), changed (its block, another body), or copied."""
    had = target.select("pair_id", F.col("id").alias("had_id"), F.col("body").alias("had"))
    joined = merged.join(had, (merged["pair_id"] == had["pair_id"]) & (merged["id"] == had["had_id"]) , "left").drop(had["pair_id"])
    origin = F.when(F.col("had_id").isNull(), "copied").when(F.col("had") == F.col("body"), "own").otherwise("changed")
    return joined.select("pair_id", "pos", "id", "body", origin.alias("origin"))


def file_blocks(doc: Doc, side: str) -> list[tuple[str, str]]:
    """(id, body) of a file's blocks: ids end in their place."""
    return [(f"{side}:{k}", dumps(b)) for k, b in enumerate(doc.blocks)]


__all__ = ["Backend", "DocxBackend", "ModelBackend", "OdtBackend", "Parts", "Piece", "backend", "edited_files", "file_blocks", "pieces"]
