"""Longest matching runs of two sequences: difflib's results (no junk), in less time."""

from __future__ import annotations

from collections.abc import Sequence

# Up to so many pairs of places a run is looked for by bits, above by a suffix automaton.
MOST_BITS = 1 << 20


def _by_bits(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """The longest run, the first in `a`, then in `b`: one bit for each pair of places, runs found by doubling shifts."""
    width = len(b) // 8 + 1  # one bit at least is left over, so that no run goes on in the next row
    masks: dict = dict.fromkeys(a, 0)
    for j, t in enumerate(b):
        if t in masks:
            masks[t] |= 1 << j
    rows = {t: m.to_bytes(width, "little") for t, m in masks.items()}
    ones = int.from_bytes(b"".join([rows[t] for t in a]), "little")
    if not ones:
        return 0, 0, 0
    step, powers, long = width * 8 + 1, [ones], 1
    while nxt := powers[-1] & (powers[-1] >> (long * step)):
        powers.append(nxt)
        long *= 2
    runs, size = powers[-1], long
    for k in range(len(powers) - 2, -1, -1):
        if more := runs & (powers[k] >> (size * step)):
            runs, size = more, size + (1 << k)
    i, j = divmod((runs & -runs).bit_length() - 1, width * 8)
    return i, j, size


def _by_automaton(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """The same, in time and space that grow with the lengths: an automaton of all runs of `b`, each with where it ends first."""
    to, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for j, t in enumerate(b):
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        first.append(j)
        p = last
        while p != -1 and t not in to[p]:
            to[p][t] = cur
            p = link[p]
        if p != -1:
            q = to[p][t]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p != -1 and to[p].get(t) == q:
                    to[p][t] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    best, state, run = (0, 0, 0), 0, 0
    for i, t in enumerate(a):
        while state and t not in to[state]:
            state = link[state]
            run = length[state]
        if t in to[state]:
            state = to[state][t]
            run += 1
            if run > best[2]:
                best = (i - run + 1, first[state] - run + 1, run)
    return best


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(i, j, n) of the runs that SequenceMatcher(None, a, b, autojunk=False) finds, in order, neighbours joined."""
    x, y = a, b
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        find = _by_bits if (i1 - i0) * (j1 - j0) <= MOST_BITS else _by_automaton
        i, j, n = find(x[i0:i1], y[j0:j1])
        if n:
            i, j = i + i0, j + j0
            found.append((i, j, n))
            todo += [(i0, i, j0, j), (i + n, i1, j + n, j1)]
    blocks: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + n)
        else:
            blocks.append((i, j, n))
    return blocks


def changed(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """(i, j, k, m): the stretches a[i:j] and b[k:m] between the matching runs."""
    out, i, k = [], 0, 0
    for p, q, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < p or k < q:
            out.append((i, p, k, q))
        i, k = p + n, q + n
    return out


def ratio(a: str, b: str) -> float:
    """Twice the matched places by all places, as SequenceMatcher's."""
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


def most_common(a: str, b: str) -> int:
    """How long the longest common subsequence is: no sum of matching runs in order is longer. One number holds a row of the table."""
    masks: dict[str, int] = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        if u := row & masks.get(t, 0):
            row = (row + u | row - u) & full
    return len(b) - row.bit_count()
