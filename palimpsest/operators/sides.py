"""Both sides of aligned rows as HTML: changed words are marked, and a caret stands where only the other side has text.

Defined results: a side without a block is a placeholder; a block without text is an empty paragraph; text is escaped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.options import DEFAULTS, CompareOptions
from ..functions.tokens import Tokens, props_sig
from ..model import Block, Row, Span, loads
from ..storage import tune
from .changes import describe
from .inline import InlineDiff, diff_blocks, flatten, full_range

SIDES = "pair_id string, row_no int, kind string, a string, b string"
EMPTY = '<span class="empty">¶</span>'


def _pieces(spans: list[Span], t: Tokens, i: int, j: int) -> str:
    """Tokens [i, j) as HTML, run by run."""
    from ..model import merge_spans
    from ..sources.writers import _span_html

    cut = [spans[k] if spans[k].obj else Span(spans[k].text[s:e], spans[k].fmt) for x in t.all[i:j] for k, s, e in x.pieces]
    return "".join(map(_span_html, merge_spans(cut)))


def marked(spans: list[Span], d: InlineDiff, side: str) -> str:
    """One side of a word-level comparison."""
    t, tag, other = (d.a, "del", "B") if side == "a" else (d.b, "ins", "A")
    out, at = [], 0
    for s in d.segs:
        i, j = full_range(t, *((s.a0, s.a1) if side == "a" else (s.b0, s.b1)))
        out.append(_pieces(spans, t, at, max(at, i)))  # what is not compared, at the ends
        at = max(at, j)
        if s.equal:
            out.append(_pieces(spans, t, i, j))
        elif j > i:
            cls, title = ("chg fmt", ' title="Formatting differs"') if s.fmt_only else ("chg", "")
            out.append(f'<{tag} class="{cls}" data-c="{s.change}"{title}>{_pieces(spans, t, i, j)}</{tag}>')
        else:
            out.append(f'<span class="caret" data-c="{s.change}" title="Text here only in {other}"></span>')
    return "".join([*out, _pieces(spans, t, at, len(t.all))])


def changed_paragraph(l: Block, r: Block, o: CompareOptions = DEFAULTS) -> tuple[str, str]:
    """Both sides of a changed pair; other blocks than paragraphs are compared as flat text."""
    d = diff_blocks([l], [r], o)
    plain = l.type == r.type == "p"
    differ = plain and props_sig(l, o) != props_sig(r, o)
    sides = []
    for b, side in ((l, "a"), (r, "b")):
        chip = f'<span class="chip">{describe(b)}</span>' if differ else ""
        sides.append(f'<div class="blk{" props" if differ else ""}">{chip}{marked(b.spans if plain else flatten([b]), d, side) or EMPTY}</div>')
    return sides[0], sides[1]


def row_html(r: Row, columns: int, cell=None, whole: bool = False) -> str:
    """A table row on a grid of columns; ``cell``: its own HTML for a cell's place."""
    from ..sources.writers import blocks_html

    cells = []
    for k, c in enumerate(r.cells):
        inner = "" if c.vmerge == "continue" else cell(k) if cell else blocks_html(c.blocks)
        cells.append(f'<div class="tcell{" vcont" if c.vmerge == "continue" else ""}" style="grid-column:span {c.colspan}">{inner}</div>')
    return f'<div class="trow{" th" if r.header else ""}{" whole" if whole else ""}" style="--cols:{columns}">{"".join(cells)}</div>'


def changed_row(l: Row, r: Row, columns: tuple[int, int], o: CompareOptions = DEFAULTS) -> tuple[str, str]:
    """Both sides of a changed table row: cell by cell where both have as many, else as a whole."""
    from ..sources.writers import blocks_html

    if len(l.cells) != len(r.cells):
        return row_html(l, columns[0], whole=True), row_html(r, columns[1], whole=True)
    found = [diff_blocks(a.blocks, b.blocks, o) for a, b in zip(l.cells, r.cells, strict=True)]

    def one(row: Row, side: str, width: int) -> str:
        def cell(k: int) -> str:
            blocks = row.cells[k].blocks
            if not found[k].changes:
                return blocks_html(blocks)
            single = len(l.cells[k].blocks) == len(r.cells[k].blocks) == 1 and l.cells[k].blocks[0].type == r.cells[k].blocks[0].type == "p"
            return f'<div class="blk cell">{marked(blocks[0].spans if single else flatten(blocks), found[k], side) or EMPTY}</div>'

        return row_html(row, width, cell)

    return one(l, "a", columns[0]), one(r, "b", columns[1])


def side_html(rows: DataFrame, o: CompareOptions = DEFAULTS) -> DataFrame:
    """HTML of both sides of each row: pair_id, row_no, kind, a, b. Tables are shown whole, with their changed rows marked."""
    tune(rows.sparkSession)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources.writers import blocks_html
        from .compare import compare_tables

        for batch in batches:
            out = []
            for pair, n, kind, left, right in batch.itertuples(index=False):
                l, r = (loads(x) if x else None for x in (left, right))
                if kind == "mod":
                    a, b = changed_paragraph(l, r, o)
                elif kind == "table":
                    widths = tuple(max((sum(c.colspan for c in x.cells) for x in t.rows), default=1) for t in (l, r))
                    lines = []
                    for sub, i, j in compare_tables(l.rows, r.rows, o):
                        x, y = None if i is None else l.rows[i], None if j is None else r.rows[j]
                        lines.append(changed_row(x, y, widths, o) if sub == "mod" else tuple("" if z is None else row_html(z, w) for z, w in zip((x, y), widths, strict=True)))
                    a, b = ("".join(x) for x in zip(*lines, strict=True)) if lines else ("", "")
                else:
                    a, b = (f'<div class="ph"><span>not in {s}</span></div>' if x is None else blocks_html([x]) for x, s in ((l, "A"), (r, "B")))
                out.append((pair, n, kind, a, b))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SIDES.split(", ")])

    return rows.select("pair_id", "row_no", "kind", "l_body", "r_body").mapInPandas(kernel, SIDES)
