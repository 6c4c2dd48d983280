"""Markdown documents as blocks.

Blocks are read line by line with one open block, which takes a line or is closed by it. Inline text is read by one
regular expression that has an alternative for each construct; a construct is a span of its own or text inside with a
format added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..model import OBJECT, Block, Cell, Doc, Fmt, ListInfo, Obj, Row, Span, merge_spans
from .text import decoded

# What begins a block, by its first line, and what a line under a table's head or a paragraph says.
STARTS = {
    "fence": r" {0,3}(?P<fence>`{3,}|~{3,}).*",
    "heading": r" {0,3}(?P<depth>#{1,6})(?:[ \t]+(?P<title>.*?))?(?:[ \t]+#+)?[ \t]*",
    "rule": r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*",
    "quote": r" {0,3}> ?(?P<quoted>.*)",
    "item": r"(?P<indent>[ \t]*)(?P<mark>[-+*]|\d{1,9}[.)])[ \t]+(?P<item>.*)",
}
COLUMNS = r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*"
UNDERLINES = {1: r" {0,3}=+\s*", 2: r" {0,3}-+\s*"}

# Inline constructs. Of two that begin at one place the first listed counts.
CONSTRUCTS = {
    "broken": r"\\\n",
    "escaped": r"\\(?P<char>[\\`*_{}\[\]()#+\-.!|~<>\"'])",
    "line": r"(?P<gap>[ \n]*\n)",
    "code": r"(?P<ticks>`+)(?P<quoted>.*?[^`])(?P=ticks)(?!`)",
    "image": r"!\[(?P<alt>[^\]]*)\]\(\s*<?(?P<src>[^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)",
    "link": r"\[(?P<label>(?:\\.|[^\]\\])*)\]\(\s*<?(?P<href>[^)\s>]*)>?(?:\s+\"[^\"]*\")?\s*\)",
    "address": r"<(?P<url>(?:https?|ftp)://[^>\s]+|mailto:[^>\s]+)>",
    "newline": r"<[bB][rR]\s*/?>",
    "tag": r"<(?P<name>(?i:sup|sub|u|ins|del|s|b|strong|i|em|mark))>(?P<inner>.*?)</(?i:(?P=name))>",
    "struck": r"~~(?P<struck_text>.+?)(?<![\s\\])~~",
    "strong": r"\*\*(?!\s)(?P<strong_text>.+?)(?<![\s\\])\*\*|(?<![^\W_])__(?!\s)(?>(?P<strong_word>.+?)(?<![\s\\])__)(?![^\W_])",
    "slanted": r"\*(?![\s*])(?P<slanted_text>.+?)(?<![\s\\])\*|(?<![^\W_])_(?![\s_])(?>(?P<slanted_word>.+?)(?<![\s\\])_)(?![^\W_])",
}
TAGS = {
    "sup": {"sup": True}, "sub": {"sub": True}, "u": {"u": True}, "ins": {"u": True}, "del": {"s": True}, "s": {"s": True},
    "b": {"b": True}, "strong": {"b": True}, "i": {"i": True}, "em": {"i": True}, "mark": {"hl": "yellow"},
}

_START = re.compile("|".join(f"(?P<{kind}_>{p.replace(chr(92) + '1', '(?P=bar)').replace('([-*_])', '(?P<bar>[-*_])')})" for kind, p in STARTS.items()))
_INLINE = re.compile("|".join(f"(?P<{name}>{p})" for name, p in CONSTRUCTS.items()), re.S)
_BREAK = re.compile(CONSTRUCTS["newline"])
_NAMES = set(CONSTRUCTS)


def _start(line: str) -> tuple[str, re.Match] | None:
    """The kind of block that a line begins, with what it says; None for text."""
    m = _START.fullmatch(line)
    return (next(k for k in STARTS if m[f"{k}_"] is not None), m) if m else None


def _texts(line: str) -> bool:
    return bool(line.strip()) and _start(line) is None


# ------------------------------------------------------------------ inline


def _inside(m: re.Match, kind: str) -> tuple[str, dict]:
    """Text inside a construct, and what its format adds."""
    if kind == "link":
        return m["label"], {"href": m["href"]}
    if kind == "tag":
        return m["inner"], TAGS[m["name"].lower()]
    if kind == "struck":
        return m["struck_text"], {"s": True}
    return next(m[f"{kind}_{x}"] for x in ("text", "word") if m[f"{kind}_{x}"] is not None), {"b" if kind == "strong" else "i": True}


def _alone(m: re.Match, kind: str, fmt: Fmt) -> Span:
    """A construct that is a span of its own."""
    if kind == "escaped":
        return Span(m["char"], fmt)
    if kind == "line":
        out, spaces = "", 0
        for c in m["gap"]:  # two spaces before a line's end keep it; else lines join by one
            out, spaces = (out, spaces + 1) if c == " " else (out + "\n", 0) if spaces > 1 else (out, 1)
        return Span(out + " " * spaces, fmt)
    if kind == "code":
        text = m["quoted"]
        return Span(text[1:-1] if len(text) > 2 and text[0] == text[-1] == " " else text, fmt.but(code=True))
    if kind == "image":
        return Span(OBJECT, fmt, Obj("image", "img:" + m["src"], m["alt"] or "Image", src=m["src"]))
    if kind == "address":
        return Span(m["url"].removeprefix("mailto:"), fmt.but(href=m["url"]))
    return Span("\n", fmt)


def _spans(text: str, fmt: Fmt) -> Iterator[Span]:
    at = 0
    for m in _INLINE.finditer(text):
        yield Span(text[at : m.start()], fmt)
        at, kind = m.end(), next(k for k in m.groupdict() if k in _NAMES and m[k] is not None)
        if kind in ("link", "tag", "struck", "strong", "slanted"):
            inner, more = _inside(m, kind)
            yield from _spans(inner, fmt.but(**more))
        else:
            yield _alone(m, kind, fmt)
    yield Span(text[at:], fmt)


def inline(text: str) -> list[Span]:
    return merge_spans(list(_spans(text, Fmt())))


def _paragraph(lines: list[str], **props) -> Block:
    return Block(spans=inline("\n".join(lines).strip()), **props)


# ------------------------------------------------------------------ blocks


class _Open:
    """A block whose lines are still coming."""

    def __init__(self, first: str):
        self.lines = [first]

    def take(self, line: str) -> bool:
        """Whether the line belongs to the block."""
        raise NotImplementedError

    def blocks(self) -> Iterator[Block]:
        """The finished block."""
        raise NotImplementedError


class _Fence(_Open):
    def __init__(self, m: re.Match):
        self.lines, self.closed = [], False
        self.end = re.compile(rf" {{0,3}}{re.escape(m['fence'][0])}{{{len(m['fence'])},}}\s*")

    def take(self, line: str) -> bool:
        if self.closed:
            return False
        self.closed = self.end.fullmatch(line) is not None
        if not self.closed:
            self.lines.append(line)
        return True

    def blocks(self) -> Iterator[Block]:
        yield Block(role="code", spans=[Span("\n".join(self.lines))] if self.lines else [])


class _Quote(_Open):
    def take(self, line: str) -> bool:
        found = _start(line)
        if found and found[0] == "quote":
            self.lines.append(found[1]["quoted"])
            return True
        return False

    def blocks(self) -> Iterator[Block]:
        for part in re.split(r"(?:\A|\n)[^\S\n]*(?:\n[^\S\n]*)*(?:\n|\Z)", "\n".join(self.lines)):
            if part.strip():
                yield _paragraph([part], role="quote")


class _Table(_Open):
    def take(self, line: str) -> bool:
        belongs = len(self.lines) == 1 or ("|" in line and bool(line.strip()))
        if belongs:
            self.lines.append(line)
        return belongs

    def blocks(self) -> Iterator[Block]:
        head, _, *rest = self.lines
        yield Block("table", rows=[self.row(head, True), *(self.row(x, False) for x in rest)])

    @staticmethod
    def row(line: str, header: bool) -> Row:
        bars = re.split(r"((?<!\\)\|)", line.strip())
        if len(bars) > 1 and not bars[0]:
            bars = bars[2:]
        if len(bars) > 1 and not bars[-1]:
            bars = bars[:-2]
        return Row([Cell([_paragraph([_BREAK.sub("\n", c.strip().replace("\\|", "|"))])], header=header) for c in bars[::2]], header=header)


class _Item(_Open):
    def __init__(self, m: re.Match, info: ListInfo):
        super().__init__(m["item"])
        self.info = info

    def take(self, line: str) -> bool:
        if _texts(line):
            self.lines.append(line.strip())
            return True
        return False

    def blocks(self) -> Iterator[Block]:
        yield _paragraph(self.lines, list=self.info)


class _Text(_Open):
    level: int | None = None

    def take(self, line: str) -> bool:
        if self.level or not _texts(line):
            return False
        self.level = next((n for n, p in UNDERLINES.items() if re.fullmatch(p, line)), None)
        if not self.level:
            self.lines.append(line)
        return True

    def blocks(self) -> Iterator[Block]:
        yield _paragraph(self.lines, **({"role": "h", "level": self.level} if self.level else {}))


class _Lists:
    """Lists follow each other as one until another block comes between; deeper indents are deeper levels."""

    def __init__(self):
        self.count, self.indents = 0, None

    def end(self) -> None:
        self.indents = None

    def item(self, m: re.Match) -> ListInfo:
        if self.indents is None:
            self.count, self.indents = self.count + 1, []
        indent = len(m["indent"].replace("\t", " " * 4))
        self.indents = sorted({i for i in self.indents if i < indent} | {indent})
        level, mark = len(self.indents) - 1, m["mark"]
        return ListInfo(mark[0].isdigit(), level, f"l{self.count}", starts={level: int(mark[:-1])} if mark[0].isdigit() else {})


def _opened(line: str, after: str, lists: _Lists) -> _Open | list[Block]:
    """The block that a line opens, or the finished ones it is."""
    kind, m = _start(line) or ("text", None)
    if kind in ("text", "item") and "|" in line and "-" in after and re.fullmatch(COLUMNS, after):
        kind = "table"
    if kind == "item":
        return _Item(m, lists.item(m))
    lists.end()
    if kind == "heading":
        return [_paragraph([m["title"] or ""], role="h", level=len(m["depth"]))]
    if kind == "rule":
        return []
    return _Fence(m) if kind == "fence" else _Quote(m["quoted"]) if kind == "quote" else _Table(line) if kind == "table" else _Text(line)


def read(text: str, name: str) -> Doc:
    lines = decoded(text)[0].split("\n")
    out: list[Block] = []
    lists, block = _Lists(), None
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        if block is not None and block.take(line):
            continue
        out += block.blocks() if block is not None else ()
        block = None
        if line.strip():
            opened = _opened(line, after, lists)
            if isinstance(opened, list):
                out += opened
            else:
                block = opened
    out += block.blocks() if block is not None else ()
    return Doc(name, "markdown", out, "md", "Markdown")
