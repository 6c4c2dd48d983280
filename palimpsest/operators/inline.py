"""Word-level differences of two paragraphs."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.options import CompareOptions
from ..functions.tokens import Tokens, tokenize, utf16
from ..model import Block, Span
from .sequence import edit_runs, interned, regions


@dataclass
class Seg:
    """A stretch of compared tokens, [a0, a1) of the left and [b0, b1) of the right; ``change`` numbers the changed ones."""

    equal: bool
    a0: int
    a1: int
    b0: int
    b1: int
    change: int = -1
    fmt_only: bool = False


@dataclass
class InlineDiff:
    a: Tokens
    b: Tokens
    segs: list[Seg]

    @property
    def changes(self) -> list[Seg]:
        return [s for s in self.segs if not s.equal]


def _compared(t: Tokens, i: int, j: int) -> list:
    return t.all[t.first + i : t.first + j]


def tidy(found: list[tuple], a: Tokens, b: Tokens) -> list[tuple]:
    """Folds an equal stretch between two changes into them if it is white space or no longer than either of them.

    The leftmost one that can be folded goes first, after every fold anew: a fold makes the change on its left longer,
    which can only matter from there on, so one step back is far enough to look again.
    """
    size = lambda t, i, j: sum(utf16(x.text) for x in _compared(t, i, j))
    out = list(found)
    k = 1
    while k + 1 < len(out):
        before, middle, after = out[k - 1 : k + 2]
        if middle[0] and not before[0] and not after[0]:
            n = size(a, middle[1], middle[2])
            longest = [max(size(a, r[1], r[2]), size(b, r[3], r[4])) for r in (before, after)]
            if n <= min(longest) or all(x.space for x in _compared(a, middle[1], middle[2])):
                out[k - 1 : k + 2] = [(False, before[1], after[2], before[3], after[4])]
                k = max(1, k - 2)
                continue
        k += 1
    return out


def diff_tokens(a: Tokens, b: Tokens) -> InlineDiff:
    words = lambda t, i, j: [k.split("\0")[0] for k in t.keys[i:j]]
    segs, n = [], 0
    for equal, a0, a1, b0, b1 in tidy(regions(edit_runs(*interned(a.keys, b.keys))), a, b):
        segs.append(Seg(equal, a0, a1, b0, b1, -1 if equal else n, not equal and words(a, a0, a1) == words(b, b0, b1)))
        n += not equal
    return InlineDiff(a, b, segs)


def flatten(blocks: list[Block]) -> list[Span]:
    """Blocks as one list of spans: paragraphs on lines, cells of inner tables between bars."""
    out: list[Span] = []

    def line() -> None:
        if out:
            out.append(Span("\n"))

    for b in blocks:
        if b.type == "p":
            line()
            out += [s for s in b.spans if not s.marker]
        elif b.type == "opaque":
            inner = flatten(b.blocks)
            if inner:
                line()
                out += inner
        elif b.type == "table":
            for row in b.rows:
                line()
                for n, cell in enumerate(row.cells):
                    if n:
                        out.append(Span(" | "))
                    out += [Span(" ", s.fmt) if s.text == "\n" and s.obj is None else s for s in flatten(cell.blocks)]
    return out


def diff_blocks(left: list[Block], right: list[Block], o: CompareOptions) -> InlineDiff:
    """Of two paragraphs their own spans are compared, of anything else the flattened ones."""
    one = len(left) == len(right) == 1 and left[0].type == right[0].type == "p"
    sides = (left[0].spans, right[0].spans) if one else (flatten(left), flatten(right))
    return diff_tokens(*(tokenize(s, o) for s in sides))


def full_range(t: Tokens, i: int, j: int) -> tuple[int, int]:
    """Places among all tokens of the compared ones [i, j)."""
    if j > i or i < len(t.keys):
        return t.first + i, t.first + max(i, j)
    end = t.last if t.keys else len(t.all)
    return end, end
