"""Word 97-2003 files, built here byte by byte, read as blocks."""

import struct

import pytest

from palimpsest.operators.changes import block_text
from palimpsest.sources import load, word97


def compound(streams):
    """A compound file of streams: large ones in sectors, small ones in the ministream."""
    sectors, fat = [], []

    def put(data):
        first, n = len(fat), max(1, -(-len(data) // 512))
        for k in range(n):
            sectors.append(data[k * 512 : k * 512 + 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    mini, mini_fat, entries = b"", [], []
    for name, data in streams.items():
        if len(data) >= 4096:
            entries.append((name, 2, put(data), len(data)))
        else:
            first, n = len(mini_fat), max(1, -(-len(data) // 64))
            mini_fat += [first + k + 1 if k + 1 < n else 0xFFFFFFFE for k in range(n)]
            mini += data.ljust(n * 64, b"\0")
            entries.append((name, 2, first, len(data)))
    root = put(mini)
    first_mini = put(b"".join(struct.pack("<I", x) for x in mini_fat).ljust(512, b"\xff"))
    directory = b""
    for name, kind, start, size in [("Root Entry", 5, root, len(mini)), *entries]:
        raw = name.encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)
    first_dir = put(directory)
    fat_sector = len(fat)
    fat.append(0xFFFFFFFD)
    table = b"".join(struct.pack("<I", x) for x in fat).ljust(512, b"\xff")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, first_dir, 0, 4096, first_mini, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<I", fat_sector).ljust(436, b"\xff") + b"".join(sectors) + table


def sprm(number, *operand):
    return struct.pack("<H", number) + bytes(operand)


def style(number, name, kind=1, base=0xFFF, para=b"", chars=b""):
    parts = [b"\0\0" + para, chars] if kind == 1 else [chars]
    body = struct.pack("<HHHHH", number, kind | base << 4, len(parts), 0, 0) + struct.pack("<H", len(name)) + name.encode("utf-16-le") + b"\0\0"
    for p in parts:
        body += b"\0" * (len(body) % 2) + struct.pack("<H", len(p)) + p
    body += b"\0" * (len(body) % 2)
    return struct.pack("<H", len(body)) + body


def page(runs, wide):
    """A page of property changes: runs (first, last, changes)."""
    head = b"".join(struct.pack("<I", a) for a, _, _ in runs) + struct.pack("<I", runs[-1][1])
    entries, tail, at = b"", b"", 511
    data = bytearray(512)
    for _, _, own in runs:
        if wide:
            body = bytes([0, (len(own) + 1) // 2]) + own + b"\0" * (len(own) % 2)
        else:
            body = bytes([len(own)]) + own
        at = (at - len(body)) // 2 * 2
        data[at : at + len(body)] = body
        entries += bytes([at // 2]) + (b"\0" * 12 if wide else b"")
    data[: len(head + entries)] = head + entries + tail
    data[511] = len(runs)
    return bytes(data)


def document(paragraphs, styles, notes=(), lists=b"", uses=b"", encrypted=False):
    """A file of paragraphs (text, style, paragraph changes, [(first, last, character changes)]), half of it in wide characters."""
    text = "".join(t for t, *_ in paragraphs)
    note_text = "".join(f"\x02 {n}\r" for _, n in notes) + ("\r" if notes else "")
    half = len(paragraphs[0][0])
    start = 2048
    first, second = text[:half].encode("cp1252"), (text[half:] + note_text).encode("utf-16-le")
    wide_at = start + len(first)
    where = lambda k: start + k if k < half else wide_at + 2 * (k - half)
    paps, chps, at = [], [], 0
    for t, s, own, runs in paragraphs:
        paps.append((where(at), where(at + len(t)) if at + len(t) != half else wide_at, struct.pack("<H", s) + own))
        k = 0
        for a, b, c in [*runs, (len(t), len(t), b"")]:
            if a > k:
                chps.append((where(at + k), where(at + a), b""))
            if b > a:
                chps.append((where(at + a), where(at + b), c))
            k = b
        at += len(t)
    pap_page, chp_page = page(paps, True), page(chps, False)
    body = first + second
    body = body.ljust(-(-(start + len(body)) // 512) * 512 - start, b"\0")
    n = (start + len(body)) // 512
    clx = b"\x02" + struct.pack("<I", 12 * 2 + 4) + struct.pack("<III", 0, half, len(text) + len(note_text)) + struct.pack("<HIH", 0, start * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, wide_at, 0)
    sheet = struct.pack("<HHH", 18, len(styles), 10) + b"\0" * 14 + b"".join(styles)
    ends = [0]
    for _, x in notes:
        ends.append(ends[-1] + len(x) + 3)
    parts = {
        word97.STYLES: sheet, word97.PIECES: clx, word97.PARAGRAPHS: struct.pack("<III", paps[0][0], paps[-1][1], n), word97.CHARACTERS: struct.pack("<III", chps[0][0], chps[-1][1], n + 1),
        word97.NOTE_REFS: b"".join(struct.pack("<I", k) for k, _ in notes) + struct.pack("<I", len(text)) + b"\0\0" * len(notes) if notes else b"",
        word97.NOTE_TEXTS: b"".join(struct.pack("<I", e) for e in ends) + struct.pack("<I", ends[-1] + 1) if notes else b"", word97.LIST_USES: uses,
    }
    table, places = b"", {}
    for k, data in parts.items():
        places[k] = (len(table), len(data))
        table += data
    places[word97.LISTS] = (len(table), 2 + 28 if lists else 0)
    table += lists
    head = bytearray(start)
    struct.pack_into("<HH", head, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", head, 10, 0x0200 | (0x0100 if encrypted else 0))
    struct.pack_into("<8i", head, 76, len(text), len(note_text), 0, 0, 0, 0, 0, 0)
    for k, (a, b) in places.items():
        struct.pack_into("<II", head, 154 + 8 * k, a, b)
    return compound({"WordDocument": (bytes(head) + body + pap_page + chp_page).ljust(4096, b"\0"), "1Table": table})


BOLD, ITALIC = sprm(word97.BOLD, 1), sprm(word97.ITALIC, 1)
STYLES = [style(0, "Normal"), style(1, "heading 1", base=0, chars=BOLD), style(0xFFE, "Quote", base=0), style(0xFFE, "Strong", 2, chars=BOLD), style(0xFFE, "Mine", base=1)]


def test_paragraphs_and_characters():
    link = 'go \x13 HYPERLINK "http://x/" \x14there\x15 now'
    paragraphs = [
        ("Title é\r", 1, b"", []), ("plain bold it under\r", 0, b"", [(6, 10, BOLD), (11, 13, ITALIC), (14, 19, sprm(word97.UNDERLINE, 1))]),
        ("mid\r", 0, sprm(word97.ALIGN, 1), []), ("quoted\r", 2, b"", []), (link + "\r", 0, b"", []), ("by name\r", 4, b"", []), ("x2 gone hidden\r", 0, b"", [(1, 2, sprm(word97.RAISED, 1)), (3, 7, sprm(word97.DELETED, 1)), (8, 14, sprm(word97.HIDDEN, 1))]),
        ("strong off\r", 0, b"", [(0, 6, sprm(word97.CHARACTER_STYLE, 3, 0)), (7, 10, sprm(word97.HIGHLIGHT, 7))]), ("a\x0bb 中\x1e\r", 0, b"", []), ("page \x13 PAGE \x143\x15\r", 0, b"", []), ("out\r", 0, sprm(word97.OUTLINE, 2), []),
    ]
    blocks = load.read(document(paragraphs, STYLES), "x.doc").blocks
    got = [(b.role, b.level, b.align, block_text(b)) for b in blocks]
    assert got == [
        ("h", 1, None, "Title é"), ("p", None, None, "plain bold it under"), ("p", None, "center", "mid"), ("quote", None, None, "quoted"), ("p", None, None, "go there now"), ("h", 1, None, "by name"),
        ("p", None, None, "x2  "), ("p", None, None, "strong off"), ("p", None, None, "a\nb 中‑"), ("p", None, None, "page 3"), ("h", 3, None, "out"),
    ]
    assert [(s.text, s.fmt.b, s.fmt.i, s.fmt.u) for s in blocks[1].spans] == [("plain ", False, False, False), ("bold", True, False, False), (" ", False, False, False), ("it", False, True, False), (" ", False, False, False), ("under", False, False, True)]
    assert not blocks[0].spans[0].fmt.b and [s.fmt.href for s in blocks[4].spans] == ["", "http://x/", ""] and blocks[6].spans[1].fmt.sup
    assert blocks[7].spans[0].fmt.b and blocks[7].spans[-1].fmt.hl == "yellow" and blocks[9].spans[1].obj.key == "PAGE"


def test_tables_lists_and_notes():
    cell, end = sprm(word97.IN_TABLE, 1), sprm(word97.IN_TABLE, 1) + sprm(word97.ROW_END, 1)
    merges = lambda *m: struct.pack("<H", word97.TABLE_CELLS) + struct.pack("<H", 1 + 1 + 2 * (len(m) + 1) + 20 * len(m)) + bytes([len(m)]) + b"\0\0" * (len(m) + 1) + b"".join(struct.pack("<H", x) + b"\0" * 18 for x in m)
    item = lambda level: sprm(word97.LIST_LEVEL, level) + sprm(word97.LIST, 1, 0)
    level = lambda start, form, text: struct.pack("<iB", start, form) + b"\0" * 23 + struct.pack("<H", len(text)) + text.encode("utf-16-le")
    lists = struct.pack("<H", 1) + struct.pack("<i", 77) + b"\0" * 24 + b"\0\0"[:0] + level(3, 0, "\0.") + level(1, 23, "•") + b"".join(level(1, 4, chr(n) + ")") for n in range(2, 9))
    lists = lists[:2] + (struct.pack("<i", 77) + b"\0" * 24) + lists[30:]
    paragraphs = [
        ("before\x02\r", 0, b"", []), ("a\x07", 0, cell, []), ("b\r", 0, cell, []), ("c\x07", 0, cell, []), ("\x07", 0, end + merges(3 << 5, 0), []), ("\x07", 0, cell, []), ("d\x07", 0, cell, []), ("\x07", 0, end + merges(1 << 5, 0), []),
        ("one\r", 0, item(0), []), ("deep\r", 0, item(1), []), ("end\r", 0, b"", []),
    ]
    uses = struct.pack("<I", 1) + struct.pack("<i", 77) + b"\0" * 12
    blocks = load.read(document(paragraphs, STYLES, notes=[(6, "see there")], lists=lists, uses=uses), "x.doc").blocks
    assert [b.type for b in blocks] == ["p", "table", "p", "p", "p"]
    table = blocks[1]
    assert [[block_text(x) for x in c.blocks] for r in table.rows for c in r.cells] == [["a"], ["b", "c"], [""], ["d"]]
    assert [[c.vmerge for c in r.cells] for r in table.rows] == [["restart", None], ["continue", None]]
    assert [(b.list.ordered, b.list.level, b.list.key, b.list.starts[b.list.level], b.list.template) for b in blocks[2:4]] == [(True, 0, "77", 3, "%1."), (False, 1, "77", 1, "•")]
    assert blocks[0].spans[-1].obj.kind == "footnote" and blocks[0].spans[-1].obj.note == "see there"


def test_refused_files():
    whole = document([("x\r", 0, b"", [])], STYLES)
    assert load.read(whole, "x.doc").kind == "doc"
    for bad in (load.CFB, load.CFB + b"x" * 600, compound({"Other": b"y"}), document([("x\r", 0, b"", [])], STYLES, encrypted=True), whole[:1500]):
        with pytest.raises(load.Unreadable):
            load.read(bad, "x.doc")
