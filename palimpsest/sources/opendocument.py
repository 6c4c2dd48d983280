"""New OpenDocument texts (.odt): blocks as content with automatic styles, list styles and tables.

Defined results: objects without a form of their own become their text; markers are left out; a document without blocks
is an empty text.
"""

from __future__ import annotations

import io
import re
import zipfile
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

from ..model import Block, Doc, Fmt, Row, Span

# Names of the format's vocabularies, and of styles for roles.
SPACES = {
    "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0", "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0",
    "style": "urn:oasis:names:tc:opendocument:xmlns:style:1.0", "fo": "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0", "xlink": "http://www.w3.org/1999/xlink",
    "draw": "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0",
}
MIME = "application/vnd.oasis.opendocument.text"
ROLE_STYLES = {"title": "Title", "subtitle": "Subtitle", "quote": "Quotations", "code": "Preformatted_20_Text", "caption": "Caption"}
NUMBER_FORMS = {"lowerLetter": "a", "upperLetter": "A", "lowerRoman": "i", "upperRoman": "I"}
BULLETS = ["•", "◦", "▪"]
_NAMES = " ".join(f'xmlns:{k}="{v}"' for k, v in SPACES.items())


def encoded(text: str) -> str:
    """Text with its white space in elements, as readers fold it otherwise."""
    out = []
    for part in re.findall(r"\n|\t| +|[^\n\t ]+", text):
        if part in "\n\t":
            out.append("<text:line-break/>" if part == "\n" else "<text:tab/>")
        elif part[0] == " ":
            out.append(" " if len(part) == 1 and out and not out[-1].startswith("<text:") else f'<text:s text:c="{len(part)}"/>')
        else:
            out.append(escape(part))
    if out and out[-1] == " ":
        out[-1] = '<text:s text:c="1"/>'
    return "".join(out)


class Writer:
    """Blocks as content, and the automatic styles that it uses."""

    def __init__(self, prefix: str = "P"):
        self.prefix = prefix
        self.texts: dict[tuple, str] = {}
        self.paragraphs: dict[tuple, str] = {}
        self.lists: dict[object, tuple[str, dict[int, tuple]]] = {}
        self.notes = 0

    # ---- inline

    def span(self, s: Span) -> str:
        if s.marker:
            return ""
        o = s.obj
        if o and o.kind in ("footnote", "endnote"):
            self.notes += 1
            return f'<text:note text:id="{self.prefix}n{self.notes}" text:note-class="{o.kind}"><text:note-citation>{self.notes}</text:note-citation><text:note-body><text:p>{encoded(o.note or "")}</text:p></text:note-body></text:note>'
        if o and o.kind == "image" and o.src:
            return f'<draw:frame draw:name={quoteattr(o.label or "Image")}><draw:image xlink:href={quoteattr(o.src)}/></draw:frame>'
        text = encoded((o.text or f"[{o.label}]") if o else s.text)
        style = self.style(s.fmt)
        text = f'<text:span text:style-name="{style}">{text}</text:span>' if style else text
        return f"<text:a xlink:href={quoteattr(s.fmt.href)}>{text}</text:a>" if s.fmt.href else text

    def style(self, f: Fmt) -> str:
        props = []
        for on, prop in (
            (f.b, 'fo:font-weight="bold"'), (f.i, 'fo:font-style="italic"'), (f.u, 'style:text-underline-style="solid"'), (f.s, 'style:text-line-through-style="solid"'),
            (f.sup, 'style:text-position="super 58%"'), (f.sub, 'style:text-position="sub 58%"'), (f.code, 'style:font-name="monospace"'), (f.hl, 'fo:background-color="#ffff00"'),
        ):
            props += [prop] if on else []
        return self.texts.setdefault(tuple(props), f"{self.prefix}t{len(self.texts) + 1}") if props else ""

    # ---- blocks

    def paragraph(self, b: Block) -> str:
        style = f"Heading_20_{b.level or 1}" if b.role == "h" else f"Contents_20_{b.level or 1}" if b.role == "toc" else ROLE_STYLES.get(b.role, "")
        if b.align:
            style = self.paragraphs.setdefault((style, b.align), f"{self.prefix}p{len(self.paragraphs) + 1}")
        named = f' text:style-name="{style}"' if style else ""
        body = "".join(map(self.span, b.spans))
        return f'<text:h text:outline-level="{b.level or 1}"{named}>{body}</text:h>' if b.role == "h" else f"<text:p{named}>{body}</text:p>"

    def list_style(self, b: Block) -> str:
        name, levels = self.lists.setdefault((b.list.key, b.list.ordered), (f"{self.prefix}l{len(self.lists) + 1}", {}))
        level = b.list.level
        levels.setdefault(level, (b.list.ordered, NUMBER_FORMS.get(b.list.formats.get(level) or ["decimal", "lowerLetter", "lowerRoman"][level % 3] * (level in b.list.formats), "1"), b.list.starts.get(level, 1)))
        return name

    def items(self, items: list[Block], depth: int = 0) -> str:
        """Items of one list, with deeper ones inside the item before them."""
        out, k = [], 0
        while k < len(items):
            end = k + 1
            while end < len(items) and items[end].list.level > depth:
                end += 1
            own = items[k].list.level == depth
            inner = items[k + own : end]
            out.append("<text:list-item>" + (self.paragraph(items[k]) if own else "") + (f"<text:list>{self.items(inner, depth + 1)}</text:list>" if inner else "") + "</text:list-item>")
            k = end
        return "".join(out)

    def blocks(self, blocks: list[Block]) -> str:
        out = []
        for key, group in groupby(blocks, lambda b: (b.list.key, b.list.ordered) if b.type == "p" and b.list else id(b)):
            group = list(group)
            if isinstance(key, tuple):
                styles = {self.list_style(b) for b in group}
                ident = re.sub(r"[^\w.-]", "_", str(key[0] or "l"))
                out.append(f'<text:list xml:id="{ident}" text:style-name="{min(styles)}">{self.items(group)}</text:list>')
            elif group[0].type == "p":
                out.append(self.paragraph(group[0]))
            elif group[0].type == "table":
                out.append(self.table(group[0]))
            else:
                out.append(self.blocks(group[0].blocks))
        return "".join(out)

    def table(self, b: Block) -> str:
        width = max((sum(c.colspan for c in r.cells) for r in b.rows), default=1)
        heads = [r for r in b.rows if r.header and all(x.header for x in b.rows[: b.rows.index(r)])]
        head = f"<table:table-header-rows>{''.join(map(self.row, heads))}</table:table-header-rows>" if heads else ""
        return f'<table:table><table:table-column table:number-columns-repeated="{width}"/>{head}{"".join(map(self.row, b.rows[len(heads) :]))}</table:table>'

    def row(self, r: Row) -> str:
        cells = []
        for c in r.cells:
            kind = "covered-table-cell" if c.vmerge == "continue" else "table-cell"
            spans = (f' table:number-columns-spanned="{c.colspan}"' if c.colspan > 1 else "") + (' table:number-rows-spanned="2"' if c.vmerge == "restart" else "")
            cells.append(f"<table:{kind}{spans}>{self.blocks(c.blocks)}</table:{kind}>")
        return f"<table:table-row>{''.join(cells)}</table:table-row>"

    def styles(self) -> str:
        """The automatic styles."""
        out = [f'<style:style style:name="{n}" style:family="text"><style:text-properties {" ".join(props)}/></style:style>' for props, n in self.texts.items()]
        sides = {"center": "center", "right": "end", "justify": "justify"}
        out += [f'<style:style style:name="{n}" style:family="paragraph"{f" style:parent-style-name={quoteattr(p)}" if p else ""}><style:paragraph-properties fo:text-align="{sides.get(a, a)}"/></style:style>' for (p, a), n in self.paragraphs.items()]
        for name, levels in self.lists.values():
            inner = []
            for k, (ordered, form, start) in sorted(levels.items()):
                inner.append(f'<text:list-level-style-number text:level="{k + 1}" style:num-format="{form}" style:num-suffix="." text:start-value="{start}"/>' if ordered else f'<text:list-level-style-bullet text:level="{k + 1}" text:bullet-char="{BULLETS[k % 3]}"/>')
            out.append(f'<text:list-style style:name="{name}">{"".join(inner)}</text:list-style>')
        return "".join(out)


def to_odt(doc: Doc) -> bytes:
    w = Writer()
    body = w.blocks(doc.blocks)
    headings = "".join(f'<style:style style:name="Heading_20_{n}" style:display-name="Heading {n}" style:family="paragraph" style:default-outline-level="{n}"/>' for n in range(1, 10))
    contents = "".join(f'<style:style style:name="Contents_20_{n}" style:display-name="Contents {n}" style:family="paragraph"/>' for n in range(1, 10))
    roles = "".join(f'<style:style style:name="{n}" style:display-name="{n.replace("_20_", " ")}" style:family="paragraph"/>' for n in ROLE_STYLES.values())
    parts = {
        "content.xml": f'<office:document-content {_NAMES} office:version="1.3"><office:automatic-styles>{w.styles()}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>',
        "styles.xml": f'<office:document-styles {_NAMES} office:version="1.3"><office:styles>{headings}{contents}{roles}</office:styles></office:document-styles>',
        "META-INF/manifest.xml": '<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3">'
        f'<manifest:file-entry manifest:full-path="/" manifest:media-type="{MIME}"/>' + "".join(f'<manifest:file-entry manifest:full-path="{n}" manifest:media-type="text/xml"/>' for n in ("content.xml", "styles.xml")) + "</manifest:manifest>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIME, zipfile.ZIP_STORED)
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>\n' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()
