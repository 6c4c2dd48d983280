"""PDF files as blocks: by their tags where nearly all text is tagged, else by how it is laid out.

Without tags, runs become lines, each line is given a kind from what it looks like (entry of a table of contents, row of a
table, heading, list item, text), lines that continue each other become paragraphs, and paragraphs are joined across
pages and given their footnotes.

Defined results: running heads, page numbers and artifacts are left out; a file without text has no blocks and says so in
its notes; pictures are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex

from ..model import OBJECT, Block, Cell, Doc, Fmt, ListInfo, Obj, Row, Span, merge_spans
from ..operators.changes import block_text
from .pdf_text import Node, Page, Run, pages

# What list markers, sentence ends, page numbers, contents titles, notes and dot leaders look like.
BULLETS = "•●◦○▪■□‣⁃∙·–—-*"
GLUED_BULLETS = BULLETS.translate(dict.fromkeys(map(ord, "-*–—")))
NUMBER_LABEL = r"\(?([0-9]{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,7})[.)]"
SENTENCE_END = r"[.!?:;][\"”’)]?$"
PAGE_NUMBER = r"(page\s+)?#+(\s*(of|/)\s*#+)?|[-–—]\s*#+\s*[-–—]"
CONTENTS = r"(table of )?contents|index|inhalt(sverzeichnis)?|sommaire|table des matières|índice|indice|inhoud(sopgave)?"
NOTES = r"(end)?notes|footnotes"
ENTRY_NUMBER = r"\d{1,4}|[ivxlc]{1,6}"
LEADERS = r"\.{4,}|…{2,}|(\. ){3,}"
# Shares of a size by which things are told apart (see where they are used).
SMALL, TALLER, SAME_SIZE = 0.85, 1.12, 0.6
UNTAGGED = "This PDF has no structure tags, so its paragraphs, headings and lists were worked out from the page layout. Pictures are not compared."
NO_TEXT = "This PDF has no text layer (it is probably a scan), so there is nothing to compare."
NO_EDITING = "PDFs can’t be edited in place: a merged result is saved as a new PDF, or as Word, OpenDocument or another editable format."

HEADINGS = {"H": 1, "H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6}
ROLES = {"Title": "title", "Subtitle": "subtitle", "Caption": "caption", "BlockQuote": "quote", "Quote": "quote", "Code": "code"}
INLINE = {"Span", "Link", "Reference", "Annot", "Form", "Ruby", "RB", "RT", "RP", "Warichu", "WT", "WP", "Em", "Strong", "Sub", "BibEntry", "Quote", "Lbl", "LBody"}


@dataclass
class Layout:
    """What pages have in common: the size of the text, its margins, and the heights of pages."""

    base: float
    left: float
    right: float
    heights: dict[int, float]


@dataclass
class Line:
    runs: list[Run]
    y: float
    x0: float
    x1: float
    size: float
    page: int
    text: str


@dataclass
class Para:
    """A block with where it came from."""

    block: Block
    runs: list[Run] = field(default_factory=list)
    page: int = 0
    note: tuple[str, str, bool] | None = None  # label, text, and whether it is from a list of notes at the end
    notes_title: bool = False


def half(x: float) -> float:
    return round(x * 2) / 2


def usual(values) -> float | None:
    """The most frequent value; of equally frequent ones the smallest."""
    counts = Counter(values)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def dominant_size(runs: list[Run]) -> float:
    """The size that most characters have; of equal ones the first."""
    counts: Counter = Counter()
    for r in runs:
        counts[half(r.size)] += len(r.text.strip())
    return max(counts, key=counts.get, default=0) or 11


def mark_bold(runs: list[Run]) -> None:
    """Text heavier than the weight of most characters is bold."""
    counts: Counter = Counter()
    for r in runs:
        counts[r.weight] += len(r.text.strip())
    body = max(counts, key=counts.get, default=400)
    for r in runs:
        r.bold = r.weight >= max(500, body + 100)


def layout_of(all_pages: list[Page], runs: list[Run]) -> Layout:
    base = dominant_size(runs)
    body = [r for r in runs if r.text.strip() and abs(r.size - base) < SAME_SIZE]
    width = all_pages[0].width if all_pages else 612
    left = usual(round(r.x) for r in body)
    left = 72 if left is None else left
    widest = max((r.x + r.w for r in body if r.x + r.w <= width - 18), default=width - left)
    return Layout(base, left, widest if widest > width - left + 4 else width - left, {p.number: p.height for p in all_pages})


# ------------------------------------------------------------------ text of a paragraph


def _trimmed(spans: list[Span]) -> list[Span]:
    """Without white space at the ends."""
    while spans and not spans[0].obj and not spans[0].text.strip():
        spans = spans[1:]
    while spans and not spans[-1].obj and not spans[-1].text.strip():
        spans = spans[:-1]
    if spans and not spans[0].obj:
        spans = [Span(spans[0].text.lstrip(), spans[0].fmt), *spans[1:]]
    if spans and not spans[-1].obj:
        spans = [*spans[:-1], Span(spans[-1].text.rstrip(), spans[-1].fmt)]
    return spans


class _Text:
    """Spans of runs that follow each other: spaces come back between lines and over gaps, and hyphens at line ends go."""

    def __init__(self, base: float):
        self.base, self.spans = base, []
        self.line: Run | None = None  # the last run on the baseline
        self.last: Run | None = None
        self.broken = False  # a line has ended

    @property
    def tail(self) -> str:
        return self.spans[-1].text if self.spans and not self.spans[-1].obj else ""

    def join(self, r: Run, small: bool) -> str:
        """The text of a run with what has to stand before it; may take a hyphen off the text so far."""
        text = r.text
        fresh = self.broken or (self.line is not None and not small and abs(r.y - self.line.y) > max(self.line.size, r.size) * 0.6)
        if fresh:
            if regex.search(r"\p{L}-$", self.tail) and regex.match(r"\p{Ll}", text):
                self.spans[-1] = Span(self.tail[:-1], self.spans[-1].fmt)
                return text
            return " " * bool(self.tail and not self.tail[-1].isspace()) + text.lstrip()
        gap = self.last is not None and r.x - (self.last.x + self.last.w) > r.size * 0.25
        return " " * (gap and not self.tail[-1:].isspace() and not text[:1].isspace()) + text

    def add(self, r: Run) -> None:
        if r.figure is not None:
            if self.tail and not self.tail[-1].isspace():
                self.spans.append(Span(" ", self.spans[-1].fmt))
            self.spans.append(Span(OBJECT, Fmt(), Obj("image", f"img:pdf:{r.figure}", r.figure or "Picture")))
            self.last = None
            return
        if not r.text:
            self.broken = self.broken or (r.eol and bool(self.spans))
            return
        small = r.size < self.base * SMALL
        text = self.join(r, small)
        raised = r.y - self.line.y if small and self.line is not None and abs(r.y - self.line.y) < self.base * 0.6 else 0.0
        fmt = Fmt(b=r.bold, i=r.italic, code=r.mono, href=r.href, sup=raised > self.base * 0.15, sub=raised < -self.base * 0.1)
        self.spans = merge_spans([*self.spans, Span(text, fmt)])
        self.broken = r.eol
        if not (fmt.sup or fmt.sub):
            self.line = r
        self.last = r

    def done(self) -> list[Span]:
        return merge_spans([s if s.obj else Span(re.sub(" {2,}", " ", s.text), s.fmt) for s in _trimmed(self.spans)])


def spans_of(runs: list[Run], base: float) -> list[Span]:
    text = _Text(base)
    for r in runs:
        text.add(r)
    return text.done()


def _extents(runs: list[Run], base: float) -> list[tuple[float, float]]:
    """Where each line of a paragraph begins and ends."""
    lines: list[list[float]] = []
    for r in runs:
        if r.text.strip() and r.size >= base * SMALL:
            own = next((x for x in lines if abs(x[0] - r.y) < r.size * 0.5), None)
            if own is None:
                lines.append([r.y, r.x, r.x + r.w])
            else:
                own[1:] = min(own[1], r.x), max(own[2], r.x + r.w)
    return [(a, b) for _, a, b in lines]


def alignment(runs: list[Run], geo: Layout) -> str | None:
    lines, width, middle = _extents(runs, geo.base), geo.right - geo.left, (geo.left + geo.right) / 2
    if lines and all(b - a < width * 0.85 and abs((a + b) / 2 - middle) < 3 for a, b in lines) and any(a > geo.left + 6 for a, _ in lines):
        return "center"
    return "right" if lines and all(abs(b - geo.right) < 3 and a > geo.left + width * 0.3 for a, b in lines) else None


def ends_full(runs: list[Run], geo: Layout) -> bool:
    """Whether the last line reaches the right margin, so that the text may go on."""
    lines = _extents(runs, geo.base)
    return bool(lines) and lines[-1][1] > geo.right - geo.base * 3


def _entry_tab(spans: list[Span]) -> list[Span]:
    """An entry of a table of contents with a tab before its page number, in place of dots and gaps."""
    if not spans or spans[-1].obj:
        return spans
    last = spans[-1]
    if m := re.fullmatch(r"(?is)(.*\S)[\s.·…]+(\d+|[ivxlc]+)", last.text):
        return [*spans[:-1], Span(f"{m[1]}\t{m[2]}", last.fmt)]
    if len(spans) > 1 and re.fullmatch(r"(?i)\s*(\d+|[ivxlc]+)", last.text):
        before = spans[-2]
        return [*spans[:-2], Span(re.sub(r"[\s.·…]+$", "", before.text), before.fmt), Span("\t" + last.text.strip(), last.fmt)]
    return spans


def paragraph(runs: list[Run], geo: Layout, page: int, aligned: bool = True, **props) -> Para:
    """Formats that come with a role (bold headings, slanted quotes) are left out."""
    spans, role = spans_of(runs, geo.base), props.get("role", "p")
    words = [s for s in spans if not s.obj and s.text.strip()]
    for flag, roles in (("b", ("h", "title", "subtitle", "toc")), ("i", ("quote", "caption"))):
        if role in roles and words and all(getattr(s.fmt, flag) for s in words):
            spans = [Span(s.text, s.fmt.but(**{flag: False}), s.obj) for s in spans]
    spans = _entry_tab(spans) if role == "toc" else spans
    align = alignment(runs, geo) if aligned and not props.get("list") else None
    return Para(Block(spans=merge_spans(spans), align=align, **props), runs, page)


def label_info(label: str) -> tuple[bool, str, int | None, str]:
    """Whether a printed label numbers, its format, where it starts, and its template."""
    label = label.strip()
    m = re.fullmatch(NUMBER_LABEL, label)
    if not m:
        return False, "bullet", None, label
    value, template = m[1], label.replace(m[1], "%1", 1)
    if value.isdigit():
        return True, "decimal", int(value), template
    for form, pattern in (("lowerRoman", "[ivxlcdm]{2,}|i"), ("upperRoman", "[IVXLCDM]{2,}|I")):
        if re.fullmatch(pattern, value):
            return True, form, None, template
    return True, "lowerLetter" if value.islower() else "upperLetter", ord(value[0].lower()) - 96, template


def list_info(label: str, level: int, key: str) -> ListInfo:
    ordered, form, start, template = label_info(label)
    return ListInfo(ordered, level, key, formats={level: form}, starts={} if start is None else {level: start}, template=template)


# ------------------------------------------------------------------ lines


def lines_of(page: Page) -> list[Line]:
    """Runs by baseline. A run joins the line being written if it is near its baseline (small print may stand off more),
    or one of the lines just before, in front of which it stands, as some writers draw numbers after their text."""
    groups: list[dict] = []

    def near(g: dict, r: Run) -> bool:
        odd = min(g["size"], r.size) < SMALL * max(g["size"], r.size)
        return abs(g["y"] - r.y) <= max(g["size"], r.size) * (0.6 if odd else 0.3)

    for r in page.runs:
        if r.artifact:
            continue
        if not r.text.strip():
            if groups:
                groups[-1]["runs"].append(r)
            continue
        own = groups[-1] if groups and near(groups[-1], r) else None
        if own is None:
            own = next((g for g in groups[-4:-1][::-1] if near(g, r) and r.x + r.w <= g["x0"] + r.size), None)
        if own is None:
            own = {"runs": [], "y": r.y, "size": r.size, "x0": r.x}
            groups.append(own)
        own["runs"].append(r)
        own["x0"] = min(own["x0"], r.x)
        if r.size > own["size"] * 1.15:
            own |= {"size": r.size, "y": r.y}
    out = []
    for g in groups:
        real = [r for r in g["runs"] if r.text.strip()]
        if real:
            size = dominant_size(real)
            ordered = sorted(g["runs"], key=lambda r: (not r.text and r.eol, r.x))
            low = min(r.y for r in real if r.size >= size * SMALL)
            out.append(Line(ordered, low, min(r.x for r in real), max(r.x + r.w for r in real), size, page.number, "".join(r.text for r in ordered).strip()))
    return out


def without_furniture(all_pages: list[Page], lines: list[Line]) -> list[Line]:
    """Lines but for those at the edges of pages that repeat, or are page numbers."""
    heights = {p.number: p.height for p in all_pages}
    edge = lambda l: not heights[l.page] * 0.08 <= l.y <= heights[l.page] * 0.9
    said = lambda l: re.sub(r"\s+", " ", re.sub(r"\d+", "#", l.text.lower()))
    on: dict[str, set[int]] = {}
    for l in filter(edge, lines):
        on.setdefault(said(l), set()).add(l.page)
    often = {k for k, p in on.items() if len(p) >= max(2, len(all_pages) * 0.4)}
    return [l for l in lines if not (edge(l) and (said(l) in often or re.fullmatch(PAGE_NUMBER, said(l), re.I)))]


def cells_of(line: Line) -> list[list[Run]]:
    """A line cut at gaps of over two sizes."""
    cells: list[list[Run]] = []
    before: Run | None = None
    for r in line.runs:
        if not r.text.strip():
            if cells:
                cells[-1].append(r)
            continue
        if before is None or r.x - (before.x + before.w) > line.size * 2:
            cells.append([])
        cells[-1].append(r)
        before = r
    return cells


def entry_end(line: Line) -> float | None:
    """The right edge of the page number, if a line is an entry of a table of contents."""
    real = [r for r in line.runs if r.text.strip()]
    if len(real) < 2 or not re.fullmatch(ENTRY_NUMBER, real[-1].text.strip(), re.I):
        return None
    gap = real[-1].x - (real[-2].x + real[-2].w)
    return real[-1].x + real[-1].w if gap >= line.size * 1.5 or re.search(LEADERS, line.text) else None


def marker(line: Line) -> tuple[str, list[Run]] | None:
    """The list marker that a line begins with, and the runs after it."""
    at = next((k for k, r in enumerate(line.runs) if r.text.strip()), None)
    if at is None:
        return None
    first, rest = line.runs[at], line.runs[at + 1 :]
    text, after = first.text.strip(), next((r for r in rest if r.text.strip()), None)
    apart = after is not None and after.x - (first.x + first.w) > first.size * 0.2
    if after is not None and (len(text) == 1 and text in BULLETS or apart and re.fullmatch(NUMBER_LABEL, text)):
        return text, rest
    if len(text) > 1 and text[0] in GLUED_BULLETS and re.match(r".\s+\S", text):
        return text[0], [Run(**(vars(first) | {"text": first.text.lstrip()[1:]})), *rest]
    return None


def _table_rows(lines: list[Line], at: int) -> int:
    """How many lines from ``at`` on are rows of one table: cells begin where those of the first do."""
    first = lines[at]
    starts = [c[0].x for c in cells_of(first)]
    n = 0
    for l in lines[at:]:
        cells = cells_of(l)
        fits = l.page == first.page and abs(l.size - first.size) <= 1 and len(cells) > 1 and not re.search(r"\.{4,}", l.text)
        if not fits or not all(any(abs(x - c[0].x) < 4 for x in starts) for c in cells):
            break
        n += 1
    return n if n > 1 and not re.search(r"\.{4,}|…{2,}", first.text) else 0


# ------------------------------------------------------------------ layout


class _Pages:
    """Lines as paragraphs."""

    def __init__(self, lines: list[Line], geo: Layout):
        self.lines, self.geo, self.out = lines, geo, []
        self.leading = self._leading()
        self.sizes = sorted({half(l.size) for l in lines if l.size >= geo.base * TALLER}, reverse=True)
        self.list_left = min((l.x0 for l in lines if marker(l)), default=geo.left)
        self.lists, self.in_list, self.in_notes = 0, False, False

    def _leading(self) -> float:
        """The distance of lines inside a paragraph: the smallest that recurs."""
        base = self.geo.base
        body = [l for l in self.lines if abs(l.size - base) < SAME_SIZE]
        gaps = [half(a.y - b.y) for a, b in zip(body, body[1:], strict=False) if a.page == b.page and a.y > b.y]
        counts = Counter(g for g in gaps if base * 0.9 <= g < base * 3)
        often = [g for g, n in counts.items() if n >= max(2, len(gaps) * 0.1)]
        return min(often) if often else usual(g for g in gaps if g < base * 2.2) or base * 1.2

    def kinds(self) -> Iterator[tuple[str, list[Line]]]:
        """Stretches of lines: (toc or table, its lines), else (h, li or p, one line)."""
        at = 0
        while at < len(self.lines):
            l, entries = self.lines[at], 0
            while at + entries < len(self.lines) and entry_end(self.lines[at + entries]) is not None:
                entries += 1
            if entries > 1:
                ends = [entry_end(x) for x in self.lines[at : at + entries]]
                before = self.lines[at - 1].text if at else ""
                if all(abs(e - ends[0]) < 2 for e in ends) or re.fullmatch(CONTENTS, before.strip(), re.I):
                    yield "toc", self.lines[at : at + entries]
                    at += entries
                    continue
            kind = "h" if l.size >= self.geo.base * TALLER else "li" if marker(l) else "p"
            n = _table_rows(self.lines, at) if kind == "p" else 0
            yield ("table", self.lines[at : at + n]) if n else (kind, [l])
            at += n or 1

    def starts(self, before: Line, l: Line, several: bool) -> bool:
        """Whether a line of the same kind as the one before begins a paragraph."""
        base, right = self.geo.base, self.geo.right
        full, ended = before.x1 > right - base * 3, re.search(SENTENCE_END, before.text) is not None
        if before.page != l.page:
            return abs(l.size - before.size) > base * 0.1 or not full or (ended and not regex.match(r"\p{Ll}", l.text))
        gap = before.y - l.y
        first = next(r for r in l.runs if r.text.strip())
        word = first.text.split()[0]
        room = before.x1 + base * 0.3 + first.w * len(word) / len(first.text) < right - 1 and not re.search("[-‐­]$", before.text)
        indented = several and l.x0 > before.x0 + base * 0.8
        return gap > self.leading * 1.25 or gap < 0 or room or abs(l.size - before.size) > base * 0.1 or indented or (not full and ended)

    def read(self) -> list[Para]:
        group: list[Line] = []
        own = "p"
        for kind, lines in self.kinds():
            l = lines[0]
            joins = kind == own and kind in ("h", "p") or kind == "p" and own == "li"
            if group and not (joins and kind == own and not self.starts(group[-1], l, len(group) > 1)):
                self.close(own, group)
                group = []
            if kind in ("toc", "table"):
                self.contents(lines) if kind == "toc" else self.table(lines)
                self.in_list = False
            else:
                if not group and kind == "li" and not self.in_list:
                    self.lists += 1
                own = kind
                group.append(l)
        if group:
            self.close(own, group)
        self.title()
        return self.out

    def close(self, kind: str, lines: list[Line]) -> None:
        geo, first = self.geo, lines[0]
        runs, props = [r for l in lines for r in l.runs], {}
        if kind == "h":
            place = self.sizes.index(half(first.size)) if half(first.size) in self.sizes else 0
            props = {"role": "h", "level": min(6, place + 1)}
        elif kind == "li":
            label, rest = marker(first)
            runs = [*rest, *(r for l in lines[1:] for r in l.runs)]
            props = {"list": list_info(label, max(0, min(8, round((first.x0 - self.list_left) / 18))), f"L{self.lists}")}
        self.in_list = kind == "li"
        p = paragraph(runs, geo, first.page, **props)
        text = block_text(p.block).strip()
        p.notes_title = re.fullmatch(NOTES, text, re.I) is not None
        if self.in_notes and kind == "li" and p.block.list.ordered and (number := re.search(r"\d+", label)):
            p.note = number[0], text, True
        self.in_notes = p.notes_title or (self.in_notes and kind == "li")
        foot = re.match(r"(\d{1,3}|[*†‡§])\s*(\S.*)", text, re.S)
        if foot and kind == "p" and first.y < geo.heights.get(first.page, 792) * (0.4 if first.size < geo.base * 0.93 else 0.2):
            p.note = foot[1], foot[2].strip(), False
        self.out.append(p)

    def table(self, lines: list[Line]) -> None:
        starts: list[float] = []
        for c in (c for l in lines for c in cells_of(l)):
            if not any(abs(x - c[0].x) < 4 for x in starts):
                starts.append(c[0].x)
        starts.sort()
        rows = []
        for l in lines:
            cells = [Cell() for _ in starts]
            for c in cells_of(l):
                k = next(k for k, x in enumerate(starts) if abs(x - c[0].x) < 4)
                cells[k].blocks.append(paragraph(c, self.geo, l.page, aligned=False).block)
            rows.append(Row(cells))
        self.out.append(Para(Block("table", rows=rows), page=lines[0].page))

    def contents(self, lines: list[Line]) -> None:
        inner = []
        title = self.out[-1] if self.out else None
        if title and title.block.type == "p" and not title.block.list and re.fullmatch(CONTENTS, block_text(title.block).strip(), re.I):
            self.out.pop()
            inner.append(Block(spans=[Span(s.text, s.fmt.but(b=False), s.obj) for s in title.block.spans]))
        left = min(l.x0 for l in lines)
        inner += [paragraph(l.runs, self.geo, l.page, role="toc", level=1 + max(0, round((l.x0 - left) / 12))).block for l in lines]
        self.out.append(Para(Block("opaque", label="Table of contents", blocks=inner), page=lines[0].page))

    def title(self) -> None:
        """The largest text, once and at the top of the first page, is the title; headings then move up a level."""
        heads = [p for p in self.out if p.block.role == "h" and p.block.type == "p"]
        top = [p for p in heads if p.block.level == 1]
        if len(self.sizes) < 2 or len(top) != 1 or top[0].page != 1 or sum(half(l.size) == self.sizes[0] for l in self.lines) > 2:
            return
        for p in heads:
            p.block.level = max(1, (p.block.level or 2) - 1)
        top[0].block.role, top[0].block.level = "title", None


def joined(paras: list[Para], geo: Layout) -> list[Para]:
    """Paragraphs and tables of contents that a page break cuts in two are one again."""
    out: list[Para] = []
    for p in paras:
        a, b = out[-1] if out else None, p.block
        if a is not None and p.page == a.page + 1:
            if a.block.type == b.type == "opaque" and a.block.label == b.label:
                out[-1] = Para(Block("opaque", label=b.label, blocks=a.block.blocks + b.blocks), page=p.page)
                continue
            plain = a.block.type == b.type == "p" and a.block.role in ("p", "quote") and b.role == "p" and not b.list and not a.note and not p.note
            lower = regex.match(r"\p{Ll}", block_text(b)) is not None
            if plain and abs(dominant_size(a.runs) - dominant_size(p.runs)) < SAME_SIZE and ends_full(a.runs, geo) and (lower or not re.search(SENTENCE_END, block_text(a.block))):
                spans = list(a.block.spans)
                if lower and spans and not spans[-1].obj and regex.search(r"\p{L}-$", spans[-1].text):
                    spans[-1] = Span(spans[-1].text[:-1], spans[-1].fmt)
                else:
                    spans.append(Span(" "))
                out[-1] = Para(Block(**(vars(a.block) | {"spans": merge_spans([*spans, *b.spans]), "align": None})), a.runs + p.runs, p.page)
                continue
        out.append(p)
    return out


def with_notes(paras: list[Para]) -> list[Para]:
    """Notes put at their raised references; those without one stay paragraphs, and a title of notes goes with its notes."""
    gone: set[int] = set()
    for i, n in enumerate(paras):
        if not n.note:
            continue
        label, text, at_end = n.note
        for p in reversed(paras[:i]):
            k = next((k for k, s in enumerate(p.block.spans) if s.fmt.sup and not s.obj and s.text.strip() == label), None) if p.block.type == "p" else None
            if k is None or p.note or (not at_end and p.page < n.page - 1):
                continue
            spans = list(p.block.spans)
            spans[k] = Span(OBJECT, Fmt(), Obj("footnote", f"footnote:{text}", f"Footnote: {text}", note=text))
            if k + 1 < len(spans) and not spans[k + 1].obj and re.match(r"\s+[.,;:!?)]", spans[k + 1].text):
                spans[k + 1] = Span(spans[k + 1].text.lstrip(), spans[k + 1].fmt)
            p.block.spans = merge_spans(spans)
            gone.add(i)
            break
    left = [p for i, p in enumerate(paras) if i not in gone]
    return [p for k, p in enumerate(left) if not p.notes_title or (k + 1 < len(left) and left[k + 1].note)]


# ------------------------------------------------------------------ tags


class _Tagged:
    """The structure tree as paragraphs."""

    def __init__(self, all_pages: list[Page], geo: Layout):
        self.geo, self.out, self.lists = geo, [], 0
        self.runs: dict[tuple[int, int], list[Run]] = {}
        for p in all_pages:
            for r in p.runs:
                if r.mcid is not None and not r.artifact:
                    self.runs.setdefault((p.number, r.mcid), []).append(r)

    def text(self, node: Node) -> tuple[list[Run], int]:
        """Runs of a node in order, and their first page. Lines end where the baseline moves."""
        out, page = [], 0
        for k in node.kids:
            if isinstance(k, Node):
                if k.role == "Figure":
                    out.append(Run("", 0, 0, 0, 0, figure=k.alt))
                    continue
                inner, at = self.text(k)
                page, out = page or at, out + inner
            else:
                found = self.runs.get(k, [])
                page = page or (k[0] if found else 0)
                out += found
        return out, page

    def add(self, node: Node, aligned: bool = True, **props) -> None:
        runs, page = self.text(node)
        if any(r.text.strip() or r.figure is not None for r in runs):
            p = paragraph(runs, self.geo, page, aligned, **props)
            p.notes_title = re.fullmatch(NOTES, block_text(p.block).strip(), re.I) is not None
            self.out.append(p)

    def walk(self, node: Node) -> None:
        role = node.role
        if role in HEADINGS:
            self.add(node, role="h", level=HEADINGS[role])
        elif role == "L":
            self.lists += 1
            self.list(node, 0, f"L{self.lists}")
        elif role == "Table":
            self.table(node)
        elif role == "TOC":
            inner = self.inside(lambda: [self.add(k, role="toc", level=1) for k in self.entries(node)])
            self.out.append(Para(Block("opaque", label="Table of contents", blocks=[p.block for p in inner]), page=inner[0].page if inner else 0))
        elif role == "Note":
            runs, page = self.text(node)
            text = "".join(s.text for s in spans_of(runs, self.geo.base)).strip()
            p = paragraph(runs, self.geo, page)
            m = re.match(r"(\d{1,3}|[*†‡§])[.)]?\s*(\S.*)", text, re.S)
            p.note = (m[1], m[2].strip(), True) if m else None
            self.out.append(p)
        elif role in ROLES or role in ("P", "Normal", "TOCI", "Formula", "Aside") or role in INLINE or role == "Figure" or (node.kids and not any(isinstance(k, Node) for k in node.kids)):
            self.add(Node(role, [node]) if role == "Figure" else node, role=ROLES.get(role, "p"))
        else:
            loose: list = []
            for k in [*node.kids, None]:
                if isinstance(k, Node) and k.role not in INLINE:
                    self.walk(k)
                elif k is not None:
                    self.add(Node("P", [k]))

    def inside(self, do) -> list[Para]:
        """What is added by ``do``, taken out again."""
        had, self.out = self.out, []
        do()
        had, self.out = self.out, had
        return had

    def entries(self, node: Node) -> Iterator[Node]:
        for k in node.kids:
            if isinstance(k, Node):
                yield from self.entries(k) if k.role == "TOC" else [k]

    def list(self, node: Node, level: int, key: str) -> None:
        for item in (k for k in node.kids if isinstance(k, Node)):
            if item.role == "L":
                self.list(item, level + 1, key)
                continue
            parts = [k for k in item.kids if isinstance(k, Node)]
            label = "".join(r.text for k in parts if k.role == "Lbl" for r in self.text(k)[0]).strip()
            body = [x for k in parts if k.role != "Lbl" for x in (k.kids if k.role == "LBody" else [k])] + [k for k in item.kids if not isinstance(k, Node)]
            own = Node("P", [k for k in body if not (isinstance(k, Node) and k.role == "L")])
            self.add(own, list=list_info(label or "•", level, key))
            for k in body:
                if isinstance(k, Node) and k.role == "L":
                    self.list(k, level + 1, key)

    def table(self, node: Node) -> None:
        rows, page = [], 0
        for r in self.rows(node):
            cells = []
            for c in (k for k in r.kids if isinstance(k, Node) and k.role in ("TH", "TD")):
                inner = self.inside(lambda c=c: self.walk(Node("Div", c.kids)))
                page = page or next((p.page for p in inner), 0)
                for p in inner:
                    p.block.align = None
                cells.append(Cell([p.block for p in inner], header=c.role == "TH"))
            rows.append(Row(cells, bool(cells) and all(c.header for c in cells)))
        self.out.append(Para(Block("table", rows=rows), page=page))

    def rows(self, node: Node) -> Iterator[Node]:
        for k in node.kids:
            if isinstance(k, Node):
                yield from [k] if k.role == "TR" else self.rows(k)


# ------------------------------------------------------------------ reading


def read(content: bytes, name: str) -> Doc:
    all_pages, tree = pages(content)
    runs = [r for p in all_pages for r in p.runs if not r.artifact]
    mark_bold(runs)
    n = sum(len(r.text.strip()) for r in runs)
    geo, notes = layout_of(all_pages, runs), []
    if tree is not None and n and sum(len(r.text.strip()) for r in runs if r.mcid is not None) >= n * 0.8:
        tagged = _Tagged(all_pages, geo)
        tagged.walk(tree)
        paras = tagged.out
    else:
        lines = without_furniture(all_pages, [l for p in all_pages for l in lines_of(p)])
        paras = _Pages(lines, geo).read()
        notes = [UNTAGGED]
    blocks = [p.block for p in with_notes(joined(paras, geo))]
    return Doc(name, "pdf", blocks, "pdf", "PDF", notes=[*([] if n else [NO_TEXT]), *notes, NO_EDITING])
