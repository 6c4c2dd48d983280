"""Documents as ordered blocks. Inside Python kernels blocks are these classes; in tables a block is a row whose ``body``
is its JSON, since a Spark schema cannot be recursive."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

OBJECT = "￼"


@dataclass
class Fmt:
    b: bool = False
    i: bool = False
    u: bool = False
    s: bool = False
    sup: bool = False
    sub: bool = False
    code: bool = False
    href: str = ""
    hl: str = ""

    def but(self, **changes) -> Fmt:
        return Fmt(**(asdict(self) | changes))


@dataclass
class Obj:
    """Something in a line that is not text: image, footnote, endnote, field, math, pagebreak, symbol, textbox, object."""

    kind: str
    key: str
    label: str = ""
    text: str | None = None
    src: str | None = None
    note: str | None = None
    width: int | None = None
    height: int | None = None


@dataclass
class Span:
    text: str = ""
    fmt: Fmt = field(default_factory=Fmt)
    obj: Obj | None = None
    marker: bool = False

    @property
    def size(self) -> int:
        """Characters in a paragraph's text: a marker has none, an object is one."""
        return 0 if self.marker else 1 if self.obj else len(self.text)


@dataclass
class ListInfo:
    ordered: bool
    level: int = 0
    key: str | None = None
    override: str | None = None
    formats: dict[int, str] = field(default_factory=dict)
    starts: dict[int, int] = field(default_factory=dict)
    template: str | None = None


def _many():
    return field(default_factory=list)


@dataclass
class Block:
    """``type`` is p, table, opaque or marker; each uses its own fields."""

    type: str = "p"
    role: str = "p"
    level: int | None = None
    align: str | None = None
    list: ListInfo | None = None
    spans: list[Span] = _many()
    rows: list[Row] = _many()
    fragment: bool = False
    label: str = ""
    blocks: list[Block] = _many()
    id: str = ""
    source: str = field(default="", repr=False, compare=False)  # the JSON it was read from, where that is kept


@dataclass
class Cell:
    blocks: list[Block] = field(default_factory=list)
    colspan: int = 1
    vmerge: str | None = None
    header: bool = False


@dataclass
class Row:
    cells: list[Cell] = field(default_factory=list)
    header: bool = False
    id: str = ""


@dataclass
class Doc:
    name: str
    kind: str
    blocks: list[Block]
    ext: str = ""
    label: str = ""
    mono: bool = False
    eol: str = "\n"
    delimiter: str = ","
    notes: list[str] = field(default_factory=list)
    version: int = 0


def para(text: str = "", **props) -> Block:
    return Block(spans=[Span(text)] if text else [], **props)


def _lean(value):
    """A dataclass tree as JSON values, without what has its default."""
    if isinstance(value, (Fmt, Obj, Span, ListInfo, Block, Cell, Row)):
        blank = type(value).__dataclass_fields__
        out = {}
        for name in blank:
            if name == "source":
                continue
            v = _lean(getattr(value, name))
            if v not in (None, "", False, [], {}) or name in ("type", "text", "ordered", "kind"):
                out[name] = v
        return out
    if isinstance(value, list):
        return [_lean(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _lean(v) for k, v in value.items()}
    return value


def dumps(block: Block) -> str:
    return json.dumps(_lean(block), ensure_ascii=False, separators=(",", ":"))


def _span(d: dict) -> Span:
    return Span(d.get("text", ""), Fmt(**d.get("fmt", {})), Obj(**d["obj"]) if d.get("obj") else None, d.get("marker", False))


def _block(d: dict) -> Block:
    d = dict(d)
    d["spans"] = [_span(s) for s in d.get("spans", [])]
    d["blocks"] = [_block(b) for b in d.get("blocks", [])]
    rows = d.get("rows", [])
    d["rows"] = [Row([Cell(**(c | {"blocks": [_block(b) for b in c.get("blocks", [])]})) for c in r.get("cells", [])], r.get("header", False), r.get("id", "")) for r in rows]
    if d.get("list"):
        ints = {k: {int(i): x for i, x in d["list"].get(k, {}).items()} for k in ("formats", "starts")}
        d["list"] = ListInfo(**(d["list"] | ints))
    return Block(**d)


def loads(text: str) -> Block:
    return _block(json.loads(text))


def same_fmt(a: Fmt, b: Fmt) -> bool:
    return a == b


def merge_spans(spans: list[Span]) -> list[Span]:
    """Neighbouring text of one format joined; empty text dropped."""
    out: list[Span] = []
    for s in spans:
        plain = not s.marker and s.obj is None
        if plain and not s.text:
            continue
        if plain and out and not out[-1].marker and out[-1].obj is None and out[-1].fmt == s.fmt:
            out[-1] = Span(out[-1].text + s.text, s.fmt)
        else:
            out.append(s)
    return out
