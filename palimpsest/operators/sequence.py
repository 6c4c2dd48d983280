"""Shortest edit scripts of sequences, and order-preserving pairing of what changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

EQ, DEL, INS = 0, 1, 2
#: Pairs less alike than this are not made.
PAIR_AT = 0.4
#: Changed stretches with more pairs than this are paired by place only.
MAX_PAIRS = 250_000


def _crossing(a: Sequence, b: Sequence) -> tuple[int, int] | None:
    """Where a forward and a backward shortest path meet (Myers, 1986); None if they never do before half of all steps.

    ``forward[k]`` is how far the best path on diagonal k has come, and ``backward`` the same from the other ends. Ties
    between going right and down are for going down from the smaller diagonal, and diagonals go in ascending order;
    these choices decide which of several shortest scripts is reported.
    """
    n, m = len(a), len(b)
    delta, half = n - m, (n + m + 1) // 2
    odd = delta % 2 != 0
    fronts = ({1: 0}, {1: 0})
    low, high = [0, 0], [0, 0]
    for d in range(half):
        for way in (0, 1):
            mine, other = fronts[way], fronts[1 - way]
            k = -d + low[way]
            while k <= d - high[way]:
                left, right = mine.get(k - 1, -1), mine.get(k + 1, -1)
                x = right if k == -d or (k != d and left < right) else left + 1
                y = x - k
                if way == 0:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                mine[k] = x
                if x > n:
                    high[way] += 2
                elif y > m:
                    low[way] += 2
                elif odd == (way == 0):
                    met = other.get(delta - k, -1)
                    if met != -1 and x + met >= n:
                        return (x, y) if way == 0 else (met, met - (delta - k))
                k += 2
    return None


def _shared(x: Sequence, y: Sequence) -> int:
    """How many items two sequences begin with alike."""
    return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def edit_runs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Runs (operation, length) of a shortest script from a to b. Deterministic: there is no time limit.

    Divide and conquer in linear space: boxes of the edit graph wait on a stack, a box loses what its sides begin and end
    with alike, and the rest is cut where the shortest paths from both of its corners cross.
    """
    script: list[tuple[int, int]] = []
    waiting: list[tuple] = [(a, b)]
    while waiting:
        x, y = waiting.pop()
        if isinstance(x, int):
            script.append((x, y))
            continue
        head = _shared(x, y)
        x, y = x[head:], y[head:]
        tail = _shared(x[::-1], y[::-1])
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        script.append((EQ, head))
        waiting.append((EQ, tail))
        cut = _crossing(x, y) if len(x) and len(y) else None
        waiting += [(INS, len(y)), (DEL, len(x))] if cut is None else [(x[cut[0] :], y[cut[1] :]), (x[: cut[0]], y[: cut[1]])]
    runs = ((op, sum(n for _, n in group)) for op, group in groupby((r for r in script if r[1]), key=lambda r: r[0]))
    return list(runs)


def interned(a: Sequence[str], b: Sequence[str]) -> tuple[list[int], list[int]]:
    numbers: dict[str, int] = {}
    return tuple([numbers.setdefault(x, len(numbers)) for x in side] for side in (a, b))


def regions(runs: list[tuple[int, int]]) -> list[tuple[bool, int, int, int, int]]:
    """Alternating equal and changed stretches (equal, a0, a1, b0, b1)."""
    out: list[tuple[bool, int, int, int, int]] = []
    i = j = 0
    for op, n in runs:
        i1, j1 = i + n * (op != INS), j + n * (op != DEL)
        if op != EQ and out and not out[-1][0]:
            out[-1] = (False, out[-1][1], i1, out[-1][3], j1)
        else:
            out.append((op == EQ, i, i1, j, j1))
        i, j = i1, j1
    return out


def pair_up(nl: int, nr: int, alike: Callable[[int, int], float], fits: Callable[[int, int], bool]) -> list[tuple[int | None, int | None]]:
    """Pairs items of a changed stretch in order, for the largest total similarity.

    Skipping on the left wins ties, then skipping on the right; a pair has to be strictly better. What lies between
    pairs is paired by place where both sides have as many items, and else reported one side after the other.
    """
    pairs: list[tuple[int, int]] = []
    if nl and nr and nl * nr <= MAX_PAIRS:
        best = [[0.0] * (nr + 1)]
        for i in range(nl):
            row = [0.0]
            for j in range(nr):
                top = max(best[i][j + 1], row[j])
                s = alike(i, j) if fits(i, j) else 0.0
                row.append(max(top, best[i][j] + s) if s >= PAIR_AT else top)
            best.append(row)
        i, j = nl, nr
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        pairs.reverse()
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for p, q, paired in [*((p, q, True) for p, q in pairs), (nl, nr, False)]:
        if p - i == q - j:
            for l, r in zip(range(i, p), range(j, q), strict=True):
                out += [(l, r)] if fits(l, r) else [(l, None), (None, r)]
        else:
            out += [(l, None) for l in range(i, p)] + [(None, r) for r in range(j, q)]
        if paired:
            out.append((p, q))
        i, j = p + 1, q + 1
    return out
