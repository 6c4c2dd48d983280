"""Tokens, comparison keys, signatures and word bags of blocks (the Python side, for kernels).

Spark's own functions cover plain text (see ``text``); words that cross formatted spans, objects, and Unicode
normalization need this.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field, replace

import regex

from ..model import OBJECT, Block, Fmt, Span
from .options import CompareOptions

# Character classes of the comparison.
INVISIBLE = "­​‌‍⁠﻿"
SPACE = r"\s   -     　﻿"
_LETTER = rf"\p{{L}}\p{{M}}\p{{N}}_{INVISIBLE}"
WORD_PATTERN = rf"[{_LETTER}]+(?:['’\-‐‑][{_LETTER}]+)*|[{SPACE}]+|[\s\S]"
NO_SPACES_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
FOLDS = {"'": "‘’‚‛′", '"': "“”„‟″", "-": "‐‑‒–—―−", "...": "…"}

_WORDS = regex.compile(WORD_PATTERN)
_DENSE = regex.compile(rf"[{NO_SPACES_SCRIPTS}]|[^{NO_SPACES_SCRIPTS}]+")
_HAS_DENSE = regex.compile(rf"[{NO_SPACES_SCRIPTS}]")
_WORDISH = regex.compile(r"[\p{L}\p{N}]")
_ONLY_SPACE = regex.compile(rf"[{SPACE}]+")
_ASCII = re.compile(r"[\x20-\x7e]*")
_FIXED_SPACES = dict.fromkeys([0xA0, 0x2007, 0x202F, *range(0x2000, 0x200B)], " ")
_GONE = dict.fromkeys(map(ord, INVISIBLE))
_FOLDED = {ord(c): plain for plain, all_ in FOLDS.items() for c in all_}
_VISIBLE = regex.compile(r"[^\s ​‌‍﻿­]")


def utf16(text: str) -> int:
    """Length in UTF-16 units, in which offsets and lengths count."""
    return len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)


def normalize(text: str, o: CompareOptions) -> str:
    if not _ASCII.fullmatch(text):
        text = unicodedata.normalize("NFC", text).translate(_GONE).translate(_FIXED_SPACES)
    if o.normalize_punctuation:
        text = text.translate(_FOLDED)
    if o.ignore_case:
        text = text.lower()
    return " " if o.ignore_whitespace and _ONLY_SPACE.fullmatch(text) else text


def split_words(text: str, granularity: str = "word") -> list[str]:
    """Words, runs of white space and single other characters; scripts without spaces go character by character."""
    if granularity == "char":
        return list(text)
    out: list[str] = []
    for word in _WORDS.findall(text):
        if len(word) > 1 and not word.isascii() and _HAS_DENSE.search(word) and not _ONLY_SPACE.fullmatch(word):
            out += _DENSE.findall(word)
        else:
            out.append(word)
    return out


def fmt_sig(f: Fmt) -> str:
    """What of a format is compared. Links are underlined anyway; code and highlight are not compared."""
    flags = (("b", f.b), ("i", f.i), ("u", f.u and not f.href), ("s", f.s), ("^", f.sup), ("_", f.sub))
    return "".join(c for c, on in flags if on) + (f"@{f.href}" if f.href else "")


@dataclass
class Token:
    key: str
    text: str
    pieces: list[tuple[int, int, int]]  # span, start, end
    space: bool
    word: bool


@dataclass
class Tokens:
    all: list[Token]
    first: int = 0
    last: int = 0
    keys: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.keys = [t.key for t in self.all[self.first : self.last]]


def _pieces_sig(parts: list[tuple[str, int]]) -> str:
    runs: list[list] = []
    for sig, n in parts:
        if runs and runs[-1][0] == sig:
            runs[-1][1] += n
        else:
            runs.append([sig, n])
    return runs[0][0] if len(runs) == 1 else ",".join(f"{s}:{n}" for s, n in runs)


def _stretch(spans: list[Span], group: list[int], o: CompareOptions) -> list[Token]:
    """Tokens of neighbouring text spans, whose words may cross them."""
    out, at, used = [], 0, 0
    for word in split_words("".join(spans[k].text for k in group), o.granularity):
        pieces, left = [], len(word)
        while left:
            room = len(spans[group[at]].text) - used
            n = min(room, left)
            pieces.append((group[at], used, used + n))
            left, used = left - n, used + n
            if used == len(spans[group[at]].text):
                at, used = at + 1, 0
        space = bool(_ONLY_SPACE.fullmatch(word))
        key = normalize(word, o)
        if not o.ignore_formatting and not space:
            key += "\0" + _pieces_sig([(fmt_sig(spans[k].fmt), e - s) for k, s, e in pieces])
        out.append(Token(key, word, pieces, space, not space and bool(_WORDISH.search(word))))
    return out


def tokenize(spans: list[Span], o: CompareOptions) -> Tokens:
    """Tokens of spans; objects are tokens of their own, markers none. White space at the ends may be left out."""
    tokens: list[Token] = []
    group: list[int] = []
    for k, s in enumerate([*spans, None]):
        if s is not None and s.obj is None:
            if not s.marker and s.text:
                group.append(k)
            continue
        if group:
            tokens += _stretch(spans, group, o)
            group = []
        if s is not None:
            raised = s.obj.kind in ("footnote", "endnote")
            sig = "" if o.ignore_formatting else fmt_sig(replace(s.fmt, sup=False, sub=False) if raised else s.fmt)
            tokens.append(Token(f"{OBJECT}{s.obj.kind}:{normalize(s.obj.key, o)}\0{sig}", s.text, [(k, 0, len(s.text))], False, True))
    first, last = 0, len(tokens)
    if o.ignore_whitespace:
        while first < last and tokens[first].space:
            first += 1
        while last > first and tokens[last - 1].space:
            last -= 1
    return Tokens(tokens, first, last)


def props_sig(b: Block, o: CompareOptions) -> str:
    level = str(b.level or 1) if b.role in ("h", "toc") else ""
    listed = f"|{'ol' if b.list.ordered else 'ul'}{b.list.level}" if b.list else ""
    return b.role + level + listed + (f"|{b.align}" if b.align and not o.ignore_formatting else "")


def is_blank(b: Block) -> bool:
    """A paragraph with nothing to see: markers, page breaks and invisible characters only."""
    if b.type != "p":
        return False
    shown = [s for s in b.spans if not s.marker and not (s.obj and s.obj.kind == "pagebreak")]
    return not any(s.obj or _VISIBLE.search(s.text) for s in shown)


def skipped(b: Block, o: CompareOptions) -> bool:
    return b.type == "marker" or (o.ignore_empty and is_blank(b))


def _visible(blocks: list[Block], o: CompareOptions) -> str:
    return "\x03".join(block_sig(x, o) for x in blocks if not skipped(x, o))


def row_sig(row, o: CompareOptions) -> str:
    return "\x04".join(_visible(c.blocks, o) for c in row.cells)


#: Text that normalization leaves as it is, whatever the options but letter case and white space.
_SIMPLE = re.compile("[\\x20-\\x7e¡-¬®-ɏ]*")


def _plain_sig(text: str, o: CompareOptions) -> str:
    """The keys of unformatted text, run together: text says where they part. Only keys that are empty (of invisible
    characters alone) would be lost, and are counted."""
    if _SIMPLE.fullmatch(text) and not (o.granularity == "char" and o.ignore_whitespace):
        if o.ignore_whitespace:
            text = re.sub(" +", " ", text).strip(" ")
        return text.lower() if o.ignore_case else text
    keys = [k.split("\0")[0] for k in tokenize([Span(text)], o).keys]
    empty = sum(not k for k in keys)
    return "".join(keys) + (f"\x01{empty}" if empty else "")


def block_sig(b: Block, o: CompareOptions) -> str:
    """Equal signatures mean no visible difference."""
    shown = [s for s in b.spans if not s.marker]
    if b.type == "p" and not any(s.obj or (not o.ignore_formatting and fmt_sig(s.fmt)) for s in shown):
        return f"P{props_sig(b, o)}\x01\x01{_plain_sig(''.join(s.text for s in shown), o)}"
    if b.type == "p":
        return "\x01".join(["P" + props_sig(b, o), *tokenize(b.spans, o).keys]) if b.spans else "P" + props_sig(b, o) + "\x01"
    if b.type == "table":
        return "T" + "\x05".join(row_sig(r, o) for r in b.rows)
    return f"O{b.label}\x02{_visible(b.blocks, o)}" if b.type == "opaque" else "M"


def word_bag(blocks: list[Block], o: CompareOptions) -> Counter:
    """Words of blocks and all inside them, by comparison key without formatting."""
    plain = replace(o, granularity="word", ignore_formatting=True)
    bag: Counter = Counter()
    for b in blocks:
        if b.type == "p":
            t = tokenize(b.spans, plain)
            bag.update(x.key for x in t.all[t.first : t.last] if x.word)
        elif b.type == "table":
            for row in b.rows:
                for cell in row.cells:
                    bag += word_bag(cell.blocks, o)
        else:
            bag += word_bag(b.blocks, o)
    return bag


def dice(a: Counter, b: Counter) -> float:
    """Dice similarity of bags; two empty ones are equal."""
    total = a.total() + b.total()
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return 2 * sum(min(n, large[w]) for w, n in small.items() if w in large) / total
