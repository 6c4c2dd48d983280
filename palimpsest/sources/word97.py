"""Word 97-2003 documents (.doc) as blocks.

A file is a compound file of streams. The main stream has text and pages of properties, the table stream says which text
is where. Text is read piece by piece; each paragraph has the properties of its style and its own, each run of
characters those of its style, its paragraph's style and its own.

Defined results: an encrypted or damaged file is refused; text boxes, headers and comments are not read; text that was
deleted with tracking on is left out, as in the other readers; tables inside cells are read as the cell's paragraphs.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..model import Block, Cell, Doc, Fmt, ListInfo, Row, Span, merge_spans
from .office import atom, field_key, role_of

# Numbers of property changes ("sprms"), places in the file's head, and number formats.
IN_TABLE, ROW_END, ALIGN, ALIGN_OLD, LIST_LEVEL, LIST, OUTLINE, TABLE_CELLS = 0x2416, 0x2417, 0x2461, 0x2403, 0x260A, 0x460B, 0x2640, 0xD608
BOLD, ITALIC, STRIKE, UNDERLINE, RAISED, HIDDEN, HIGHLIGHT, CHARACTER_STYLE, DELETED, SYMBOL = 0x0835, 0x0836, 0x0837, 0x2A3E, 0x2A48, 0x083C, 0x2A0C, 0x4A30, 0x0800, 0x6A09
STYLES, NOTE_REFS, NOTE_TEXTS, CHARACTERS, PARAGRAPHS, PIECES, END_REFS, END_TEXTS, LISTS, LIST_USES = 1, 2, 3, 12, 13, 33, 46, 47, 73, 74
NUMBER_FORMS = {0: "decimal", 1: "upperRoman", 2: "lowerRoman", 3: "upperLetter", 4: "lowerLetter", 22: "decimalZero", 23: "bullet", 255: "none"}
ALIGNS = {1: "center", 2: "right", 3: "justify"}
HIGHLIGHTS = {1: "black", 2: "blue", 3: "cyan", 4: "green", 5: "magenta", 6: "red", 7: "yellow", 8: "white"}
#: Built-in styles that are known by number: headings, and entries of a table of contents.
HEADING, CONTENTS = range(1, 10), range(19, 28)


class Damaged(ValueError):
    """A file that is not what it says."""


# ------------------------------------------------------------------ compound files


class Compound:
    """The streams of a compound file, by name."""

    END = 0xFFFFFFFA

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise Damaged("not a compound file")
        if struct.unpack_from("<HH", data, 30) not in ((9, 6), (12, 6)):
            raise Damaged("not a compound file")
        self.data = data
        self.size, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir, _, self.cutoff, first_mini, _, next_fat, _ = struct.unpack_from("<IIIIIIII", data, 44)
        sectors = list(struct.unpack_from("<109I", data, 76))
        while next_fat < self.END and len(sectors) < min(n_fat, len(data) // self.size) + 1:
            more = struct.unpack(f"<{self.size // 4}I", self._sector(next_fat))
            sectors += more[:-1]
            next_fat = more[-1]
        fat = b"".join(self._sector(s) for s in sectors[:n_fat] if s < self.END)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        directory = self._chain(first_dir)
        self.entries: dict[str, tuple[int, int]] = {}
        root = (0, 0)
        for at in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            name = directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<II", directory, at + 116)
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries[name] = (start, size)
        mini = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.mini = self._chain(root[0])[: root[1]]

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < self.END and n not in seen and n < len(self.fat):
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            return b""
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < self.END and start not in seen and start < len(self.mini_fat):
            seen.add(start)
            out.append(self.mini[start * self.small : (start + 1) * self.small])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


# ------------------------------------------------------------------ properties


def changes(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Property changes in order: number and operand."""
    at = 0
    while at + 2 <= len(data):
        number = struct.unpack_from("<H", data, at)[0]
        at += 2
        size = (1, 1, 2, 4, 2, 2, -1, 3)[number >> 13]
        if number == TABLE_CELLS:
            size = (struct.unpack_from("<H", data, at)[0] - 1) if at + 2 <= len(data) else 0
            at += 2
        elif size < 0:
            size = data[at] if at < len(data) else 0
            at += 1
        yield number, data[at : at + size]
        at += size


def _number(x: bytes) -> int:
    return int.from_bytes(x, "little")


@dataclass
class Style:
    number: int  # of the built-in style
    name: str
    base: int
    para: bytes = b""
    chars: bytes = b""


@dataclass
class Level:
    start: int
    form: str
    template: str


@dataclass
class Props:
    """What a paragraph's property changes come to."""

    style: int = 0
    in_table: bool = False
    row_end: bool = False
    align: str | None = None
    level: int = 0
    list_use: int = 0
    outline: int = 9
    merges: list[int] = field(default_factory=list)


class Word97:
    def __init__(self, content: bytes):
        self.files = Compound(content)
        self.main = self.files.stream("WordDocument")
        if len(self.main) < 900 or struct.unpack_from("<H", self.main)[0] != 0xA5EC:
            raise Damaged("no Word document in it")
        flags = struct.unpack_from("<H", self.main, 10)[0]
        if flags & 0x0100:
            raise Damaged("it is protected with a password")
        self.table = self.files.stream("1Table" if flags & 0x0200 else "0Table")
        self.lengths = struct.unpack_from("<8i", self.main, 76)  # text, notes, headers, macros, comments, endnotes, ...
        self.pieces = list(self._pieces())
        self.styles = self._styles()
        self.lists = self._lists()
        self.paragraphs = self._runs(PARAGRAPHS, 13)
        self.characters = self._runs(CHARACTERS, 1)

    def part(self, n: int) -> bytes:
        at, size = struct.unpack_from("<II", self.main, 154 + 8 * n) if 154 + 8 * n + 8 <= len(self.main) else (0, 0)
        return self.table[at : at + size]

    # ---- text

    def _pieces(self) -> Iterator[tuple[int, int, int, bool]]:
        """First and last character, place in the main stream, and whether a character is one byte."""
        data, at = self.part(PIECES), 0
        while at < len(data) and data[at] == 1:
            at += 3 + struct.unpack_from("<H", data, at + 1)[0]
        if at >= len(data) or data[at] != 2:
            return
        size = struct.unpack_from("<I", data, at + 1)[0]
        n = (size - 4) // 12
        places = struct.unpack_from(f"<{n + 1}I", data, at + 5)
        for k in range(n):
            where = struct.unpack_from("<I", data, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
            narrow = bool(where & 0x40000000)
            yield places[k], places[k + 1], (where & 0x3FFFFFFF) // (2 if narrow else 1), narrow

    def text(self, first: int, last: int) -> list[tuple[str, int]]:
        """Characters [first, last) with their places in the main stream."""
        out = []
        for a, b, at, narrow in self.pieces:
            for k in range(max(a, first), min(b, last)):
                where = at + (k - a) * (1 if narrow else 2)
                raw = self.main[where : where + (1 if narrow else 2)]
                c = (raw.decode("cp1252", "ignore") or chr(raw[0])) if narrow and raw else raw.decode("utf-16-le", "surrogatepass") if len(raw) == 2 else ""
                out.append((c, where))
        return out

    def _runs(self, part: int, entry: int) -> list[tuple[int, int, bytes]]:
        """Stretches of the main stream with their property changes, from pages of 512 bytes."""
        index = self.part(part)
        n = (len(index) - 4) // 8
        out = []
        for page in struct.unpack_from(f"<{n}I", index, 4 * (n + 1)) if n > 0 else ():
            data = self.main[page * 512 : page * 512 + 512]
            if len(data) < 512:
                continue
            count = data[511]
            ends = struct.unpack_from(f"<{count + 1}I", data)
            for k in range(count):
                at = data[4 * (count + 1) + entry * k] * 2
                own = b""
                if at and entry == 1:
                    own = data[at + 1 : at + 1 + data[at]]
                elif at:
                    own = data[at + 1 : at + 2 * data[at]] if data[at] else data[at + 2 : at + 2 + 2 * data[at + 1]]
                out.append((ends[k], ends[k + 1], own))
        return sorted(out)

    @staticmethod
    def _at(runs: list[tuple[int, int, bytes]], where: int) -> bytes:
        k = bisect.bisect_right(runs, where, key=lambda r: r[0]) - 1
        return runs[k][2] if k >= 0 and where < runs[k][1] else b""

    # ---- styles and lists

    def _styles(self) -> list[Style | None]:
        data = self.part(STYLES)
        if len(data) < 6:
            return []
        head = struct.unpack_from("<H", data)[0]
        count, base_size = struct.unpack_from("<HH", data, 2)
        at, out = 2 + head, []
        for _ in range(count):
            size = struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0
            own, at = data[at + 2 : at + 2 + size], at + 2 + size
            if size < base_size + 2:
                out.append(None)
                continue
            number, second, third = struct.unpack_from("<HHH", own)
            n = struct.unpack_from("<H", own, base_size)[0]
            name = own[base_size + 2 : base_size + 2 + 2 * n].decode("utf-16-le", "replace")
            s = Style(number & 0xFFF, name.split(",")[0], second >> 4)
            place, parts = base_size + 4 + 2 * n, []
            for _ in range(third & 15):
                place += place % 2
                length = struct.unpack_from("<H", own, place)[0] if place + 2 <= len(own) else 0
                parts.append(own[place + 2 : place + 2 + length])
                place += 2 + length
            if second & 15 == 1 and parts:
                s.para, s.chars = parts[0][2:], parts[1] if len(parts) > 1 else b""
            elif second & 15 == 2 and parts:
                s.chars = parts[0]
            out.append(s)
        return out

    def chain(self, number: int) -> list[Style]:
        """A style and those it builds on, the base first."""
        out: list[Style] = []
        while number < len(self.styles) and self.styles[number] is not None and len(out) < 16:
            out.insert(0, self.styles[number])
            number = out[0].base
        return out

    def _lists(self) -> list[tuple[int, dict[int, Level]]]:
        """Of each use of a list: its number and levels."""
        at, size = struct.unpack_from("<II", self.main, 154 + 8 * LISTS)
        levels: dict[int, dict[int, Level]] = {}
        if size >= 2:
            count = struct.unpack_from("<H", self.table, at)[0]
            heads = [(struct.unpack_from("<i", self.table, at + 2 + 28 * k)[0], self.table[at + 2 + 28 * k + 26] & 1) for k in range(count)]
            at += 2 + 28 * count
            for ident, simple in heads:
                for n in range(1 if simple else 9):
                    if at + 30 > len(self.table):
                        break
                    start, form = struct.unpack_from("<iB", self.table, at)
                    chars, para = self.table[at + 24], self.table[at + 25]
                    at += 28 + chars + para
                    length = struct.unpack_from("<H", self.table, at)[0]
                    text = self.table[at + 2 : at + 2 + 2 * length].decode("utf-16-le", "replace")
                    at += 2 + 2 * length
                    template = "".join(f"%{ord(c) + 1}" if ord(c) < 9 else c for c in text)
                    levels.setdefault(ident, {})[n] = Level(start, NUMBER_FORMS.get(form, "decimal"), template)
        uses = self.part(LIST_USES)
        count = struct.unpack_from("<I", uses)[0] if len(uses) >= 4 else 0
        return [(i, levels.get(i, {})) for k in range(count) if 4 + 16 * k + 4 <= len(uses) for i in struct.unpack_from("<i", uses, 4 + 16 * k)]

    # ---- what properties come to

    def para_props(self, where: int) -> Props:
        own = self._at(self.paragraphs, where)
        p = Props(struct.unpack_from("<H", own)[0] if len(own) >= 2 else 0)
        for data in (*(s.para for s in self.chain(p.style)), own[2:]):
            for number, x in changes(data):
                if number == IN_TABLE:
                    p.in_table = bool(_number(x))
                elif number == ROW_END:
                    p.row_end = bool(_number(x))
                elif number in (ALIGN, ALIGN_OLD):
                    p.align = ALIGNS.get(_number(x))
                elif number == LIST_LEVEL:
                    p.level = _number(x)
                elif number == LIST:
                    p.list_use = _number(x) if _number(x) < 0x8000 else 0
                elif number == OUTLINE:
                    p.outline = _number(x)
                elif number == TABLE_CELLS and x:
                    count, first = x[0], 1 + 2 * (x[0] + 1)
                    p.merges = [struct.unpack_from("<H", x, first + 20 * k)[0] if first + 20 * k + 2 <= len(x) else 0 for k in range(count)]
        return p

    def char_fmt(self, where: int, style: int, plain: bool) -> tuple[Fmt, bool, str | None]:
        """Format of a character, whether it is to be seen, and a symbol in its place. ``plain``: what the paragraph's style
        says does not count, as the role tells it."""
        own = self._at(self.characters, where)
        named = next((_number(x) for n, x in changes(own) if n == CHARACTER_STYLE), None)
        base: dict = {}
        for s in self.chain(style):
            base = self._apply(s.chars, base, base)
        start = {} if plain else base
        for s in self.chain(named) if named else ():
            start = self._apply(s.chars, start, start)
        out = self._apply(own, start, base)
        symbol = next((chr(struct.unpack_from("<H", x, 2)[0]) for n, x in changes(own) if n == SYMBOL and len(x) == 4), None)
        return Fmt(**{k: v for k, v in out.items() if k in ("b", "i", "s", "u", "sup", "sub", "hl")}), not (out.get("hidden") or out.get("gone")), symbol

    @staticmethod
    def _apply(data: bytes, now: dict, style: dict) -> dict:
        """Character property changes over a format; a toggle of 128 or more is told by the style's."""
        out = dict(now)
        flags = {BOLD: "b", ITALIC: "i", STRIKE: "s", HIDDEN: "hidden", DELETED: "gone"}
        for number, x in changes(data):
            v = _number(x)
            if number in flags:
                key = flags[number]
                out[key] = bool(v) if v < 128 else bool(style.get(key)) != (v == 129)
            elif number == UNDERLINE:
                out["u"] = v != 0
            elif number == RAISED:
                out |= {"sup": v == 1, "sub": v == 2}
            elif number == HIGHLIGHT:
                out["hl"] = HIGHLIGHTS.get(v, "")
        return out

    # ---- blocks

    def role(self, p: Props) -> tuple[str, int | None]:
        for s in reversed(self.chain(p.style)):
            if s.number in HEADING:
                return "h", s.number
            if s.number in CONTENTS:
                return "toc", s.number - CONTENTS.start + 1
            if found := role_of(s.name):
                return found
        return ("h", p.outline + 1) if p.outline < 9 else ("p", None)

    def list_of(self, p: Props) -> ListInfo | None:
        if not 0 < p.list_use <= len(self.lists):
            return None
        ident, levels = self.lists[p.list_use - 1]
        level = levels.get(p.level)
        ordered = level is None or level.form not in ("bullet", "none")
        return ListInfo(ordered, p.level, str(ident), formats={k: v.form for k, v in levels.items()}, starts={k: v.start for k, v in levels.items()}, template=level.template if level else None)

    def notes(self, refs: int, texts: int, start: int, kind: str) -> dict[int, tuple[str, str]]:
        """Notes by the place of their reference: kind and text."""
        a, b = self.part(refs), self.part(texts)
        n = (len(a) - 4) // 6
        ends = struct.unpack_from(f"<{len(b) // 4}I", b)
        out = {}
        for k, place in enumerate(struct.unpack_from(f"<{n}I", a) if n > 0 else ()):
            if k + 1 < len(ends):
                text = "".join(c for c, _ in self.text(start + ends[k], start + ends[k + 1]) if c == "\r" or c >= " ")
                out[place] = kind, "\n".join(x.strip() for x in text.strip().split("\r"))
        return out

    def blocks(self) -> list[Block]:
        main, foot, head, macros, comments = self.lengths[:5]
        notes = self.notes(NOTE_REFS, NOTE_TEXTS, main, "footnote") | self.notes(END_REFS, END_TEXTS, main + foot + head + macros + comments, "endnote")
        out: list[Block] = []
        rows: list[Row] = []
        cells: list[list[Block]] = [[]]
        group: list[tuple[int, str, int]] = []
        for k, (c, where) in enumerate(self.text(0, main)):
            if c not in "\r\x07\x0c" or (c == "\x0c" and not group):
                group.append((k, c, where))
                continue
            p = self.para_props(where)
            block = self.paragraph(group, p, notes)
            group = []
            if not p.in_table:
                if rows:
                    out.append(Block("table", rows=rows))
                rows, cells = [], [[]]
                out.append(block)
            elif p.row_end:
                found = []
                for n, inner in enumerate(cells[:-1]):
                    merge = p.merges[n] if n < len(p.merges) else 0
                    if merge & 3 == 1 and found:  # joined to the cell on its left
                        found[-1].colspan += 1
                        continue
                    found.append(Cell(inner, 1, {1: "continue", 3: "restart"}.get(merge >> 5 & 3)))
                rows.append(Row(found))
                cells = [[]]
            else:
                cells[-1].append(block)
                if c == "\x07":
                    cells.append([])
        if rows:
            out.append(Block("table", rows=rows))
        if group:
            out.append(self.paragraph(group, Props(), notes))
        return out

    def paragraph(self, group: list[tuple[int, str, int]], p: Props, notes: dict) -> Block:
        role, level = self.role(p)
        spans: list[Span] = []
        fields: list[list] = []  # code, spans before it, whether the code has ended
        for k, c, where in group:
            fmt, seen, symbol = self.char_fmt(where, p.style, role != "p")
            if c == "\x13":
                fields.append(["", spans, False])
                spans = []
            elif c == "\x14" and fields:
                fields[-1][0], fields[-1][2], spans = "".join(s.text for s in spans), True, []
            elif c == "\x15" and fields:
                code, before, ended = fields.pop()
                spans = [*before, *self.field(code if ended else "".join(s.text for s in spans), spans if ended else [])]
            elif not seen and not (fields and not fields[-1][2]):
                continue
            elif c == "\x02" and k in notes:
                kind, text = notes[k]
                spans.append(atom(kind, text, fmt.but(sup=False), note=text))
            elif symbol is not None:
                spans.append(atom("symbol", f"{ord(symbol):04X}", fmt, text=symbol))
            elif c in "\x01\x08":
                spans.append(atom("image", f"img:doc:{k}", fmt, label="Image"))
            elif c in "\x0b\x0c":
                spans.append(Span("\n", fmt) if c == "\x0b" else atom("pagebreak", "page", fmt))
            elif c in "\x1e\x1f":
                spans.append(Span("‑" if c == "\x1e" else "­", fmt))
            elif c == "\t" or c >= " ":
                spans.append(Span(c, fmt))
        for _, before, _ in reversed(fields):
            spans = [*before, *spans]
        return Block(role=role, level=level, align=p.align, list=self.list_of(p), spans=merge_spans(spans))

    @staticmethod
    def field(code: str, spans: list[Span]) -> list[Span]:
        name = (code.split() or [""])[0].upper()
        if name == "HYPERLINK":
            target = re.search(r'"([^"]*)"', code)
            return [Span(s.text, s.fmt.but(href=target[1]), s.obj) for s in spans] if target else spans
        if name == "TOC" or any(s.obj for s in spans):
            return spans
        text = "".join(s.text for s in spans)
        return [atom("field", field_key(name, text), spans[0].fmt if spans else Fmt(), text=text, label=name)]


def read(content: bytes, name: str) -> Doc:
    try:
        return Doc(name, "doc", Word97(content).blocks(), "doc", "Word 97")
    except (struct.error, IndexError) as e:
        raise Damaged(f"it is damaged ({e})") from e
