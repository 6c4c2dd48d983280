"""Style sheets with simple selectors (a tag, classes, or both), applied to a tree of elements."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?((?:\.[\w-]+)*)")
_TOKEN = re.compile(r"/\*.*?\*/|[{}]|[^{}/]+|/", re.S)


@dataclass(frozen=True)
class Rule:
    tag: str
    classes: frozenset[str]
    style: str
    place: int

    def fits(self, tag: str, classes: set[str]) -> bool:
        return (not self.tag or self.tag == tag) and self.classes <= classes


def rules(sheet: str) -> list[Rule]:
    """Rules of a sheet in order. At-rules (media queries, font faces), and what is inside them, are left out, and so are
    selectors of any other form."""
    out: list[Rule] = []
    heads: list[str] = [""]  # what stands before each open brace, and before the next
    for token in _TOKEN.findall(sheet):
        if token == "{":
            heads.append("")
        elif token == "}":
            body = heads.pop() if len(heads) > 1 else ""
            head = heads[-1].rpartition(";")[2].strip()
            heads[-1] = ""
            if body.strip() and not any("@" in h for h in (*heads, head)):
                out += [Rule((m[1] or "").lower(), frozenset(filter(None, m[2].split("."))), body.strip(), len(out) + k) for k, m in enumerate(filter(None, map(_simple, head.split(","))))]
        elif not token.startswith("/*"):
            heads[-1] += token
    return out


def _simple(selector: str) -> re.Match | None:
    m = _SELECTOR.fullmatch(selector.strip())
    return m if m and m[0] else None


def styled(tag: str, classes: str, own: str, sheet: list[Rule]) -> str:
    """The style of an element: rules for tags, then those for classes, in order, then its own."""
    have = set(classes.split())
    found = sorted((r for r in sheet if r.fits(tag, have)), key=lambda r: (bool(r.classes), r.place))
    return ";".join([*(r.style for r in found), own])
