"""Re-Pair over many sequences at once, and the runs that its rules and its top sequences hold.

Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair occurs twice. A pair's turn depends
only on pairs that overlap it, so every pair that is ahead of all pairs overlapping it is replaced in the same round:
the grammar is that of one replacement at a time, in a few dozen rounds over whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words compared at once before a comparison goes on to the end, and words that sift the candidate periods.
STEP, SIFT = 64, 8


@dataclass
class Grammar:
    """Rules of a batch. A rule stands for ``words[rep:rep + size]`` and joins two symbols at word ``rep + left``;
    ``places[bounds[r]:bounds[r + 1]]`` are all positions where rule ``r`` is derived. ``tops`` are the positions of the
    symbols of the top sequences, ascending; ``pairs[i]`` names the pair of words i and i + 1, -1 across sequences."""

    rep: np.ndarray
    size: np.ndarray
    left: np.ndarray
    places: np.ndarray
    bounds: np.ndarray
    tops: np.ndarray
    pairs: np.ndarray


def _ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Every value's number among the distinct values, and how many there are."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.cumsum(new) - 1
    out = np.empty(len(values), np.int64)
    out[order] = rank
    return out, int(rank[-1]) + 1 if len(values) else 0


def compress(words: np.ndarray, starts: np.ndarray) -> Grammar:
    """Re-Pair of the sequences that begin at ``starts`` in ``words``, whose ids no two sequences share."""
    n = len(words)
    joined = np.ones(n, bool)  # i and i + 1 are neighbours whose pair may still occur twice
    joined[-1:] = False
    joined[starts[1:] - 1] = False
    names = np.full(n, -1, np.int64)
    sym, at = words.astype(np.int64), np.arange(n)
    fresh = int(sym.max()) + 1 if n else 0
    width = np.ones(n, np.int64)
    reps, sizes, lefts, placed, counts, tops = [], [], [], [], [], []
    first = True
    while len(sym):
        i = np.flatnonzero(joined)
        if not len(i):
            break
        a, b = sym[i], sym[i + 1]
        pair, kinds = _ranks(a * fresh + b)
        if first:
            names[i] = pair
            first = False
        # Of the overlapping pairs within x x x x every other one counts.
        twin = a == b
        counted = np.ones(len(i), bool)
        if twin.any():
            t = np.flatnonzero(twin)
            head = np.ones(len(t), bool)
            head[1:] = i[t[1:]] != i[t[:-1]] + 1
            since = np.arange(len(t)) - np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
            counted[t] = since % 2 == 0
        times = np.bincount(pair[counted], minlength=kinds)
        alive = times[pair] >= 2
        ahead = np.zeros(len(sym) + 2, np.int64)
        # Ties go by a mixed number: in order of the symbols they would queue up behind each other.
        mixed = (np.arange(kinds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)).astype(np.int64)
        rank = np.where(alive & counted, (times[pair] << 30) + mixed[pair] + 1, 0)
        ahead[i + 1] = rank
        behind = (ahead[i] > rank) | (ahead[i + 2] > rank)
        blocked = np.bincount(pair[behind & counted], minlength=kinds) > 0
        take = alive & counted & ~blocked[pair]
        keep_pair = np.zeros(len(sym), bool)
        keep_pair[i] = alive
        if take.any():
            where = i[take]
            rule, made = _ranks(pair[take])
            order = np.argsort(rule, kind="stable")
            each = np.bincount(rule, minlength=made)
            lead = where[order][np.concatenate([[0], np.cumsum(each)[:-1]])]
            reps.append(at[lead])
            lefts.append(width[lead])
            sizes.append(width[lead] + width[lead + 1])
            placed.append(at[where[order]])
            counts.append(each)
            sym[where] = fresh + rule
            width[where] += width[where + 1]
            fresh += made
            new = np.zeros(len(sym) + 1, bool)
            new[where] = True
            # The pair behind a new symbol is that behind its right half.
            joined[where] = joined[where + 1]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            old = np.flatnonzero(stay)
            sym, at, width, joined, keep_pair = sym[old], at[old], width[old], joined[old], keep_pair[old]
            new = np.append(new[old], False)
            joined &= keep_pair | new[:-1] | new[1:]
        else:
            joined &= keep_pair
        # A symbol without a live pair on either side is final.
        live = joined.copy()
        live[1:] |= joined[:-1]
        tops.append(at[~live])
        sym, at, width, joined = sym[live], at[live], width[live], joined[live]
    tops.append(at)

    def whole(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    bounds = np.concatenate([[0], np.cumsum(whole(counts))]).astype(np.int64)
    return Grammar(whole(reps), whole(sizes), whole(lefts), whole(placed), bounds, np.sort(whole(tops)), names)


def open_stretches(pairs: np.ndarray, least: int, rounds: int = 8) -> np.ndarray:
    """Whether words i and i + 1 can lie in one run: each pair of words in a run occurs ``least`` times in it.

    Pairs too rare in their stretch cut it, which makes other pairs rare in what is left. Any number of rounds is safe.
    """
    can = pairs >= 0
    for _ in range(rounds):
        i = np.flatnonzero(can)
        if not len(i):
            break
        stretch = np.cumsum(np.concatenate([[True], i[1:] != i[:-1] + 1]))
        kind, kinds = _ranks(stretch * (int(pairs.max()) + 1) + pairs[i])
        rare = np.bincount(kind, minlength=kinds)[kind] < least
        if not rare.any():
            break
        can[i[rare]] = False
    return can


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree; both are equally long."""
    near = a[:STEP] != b[:STEP]
    if near.any():
        return int(near.argmax())
    differs = a != b
    return int(differs.argmax()) if differs.any() else len(a)


def crossing(v: np.ndarray, b: int, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """Runs ``(begin, end, period)`` of ``v`` that hold both words beside position ``b``.

    A run of at least four periods has two of them on one side of ``b``, so a period shows as a square that begins, or
    ends, at ``b``. A square inside a run of a smaller period repeats a multiple of that period and is passed over.
    """
    found: list[tuple[int, int, int]] = []
    kept = []
    m = len(v)
    for mirrored in (False, True):
        u, c = (v[::-1], m - b) if mirrored else (v, b)
        most = min((m - c) // 2, m // exponent)
        if most < 1 or c < 1:
            continue
        q = np.flatnonzero(u[c + 1 : c + 1 + most] == u[c]) + 1
        for j in range(1, SIFT):
            if not len(q):
                break
            q = q[(q <= j) | (u[np.minimum(c + q + j, m - 1)] == u[min(c + j, m - 1)])]
        for p in q.tolist():
            lo, hi = (m - c - 2 * p, m - c) if mirrored else (c, c + 2 * p)
            if any(s <= lo and hi <= e and f <= p for s, e, f in found):
                continue
            right = _equal(u[c : m - p], u[c + p : m])
            if right < p:
                continue
            left = _equal(u[:c][::-1], u[p : c + p][::-1])
            begin, end = c - left, c + p + right
            run = (m - end, m - begin, p) if mirrored else (begin, end, p)
            found.append(run)
            if left and end - begin >= max(shortest, exponent * p):
                kept.append(run)
    return kept


def merge(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that share a whole period are one; the result is ordered by begin, then period."""
    if not len(begin):
        return begin, end, period
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
    shift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] + period[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    begin, end, period = begin[first], reach[last] - shift[last], period[first]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def runs(words: np.ndarray, starts: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs of the sequences, as ``begin, end, period`` in ``words``, by begin, then period.

    A run lies in the expansion of some symbol, or of a top sequence, and across that one's boundary. Boundaries of a rule
    are looked at once, in one of its expansions, and what is found holds wherever the rule is derived. Boundaries
    of a top sequence are halved, so that a word is looked at once for each level.
    """
    g = compress(words, starts)
    can = open_stretches(g.pairs, exponent - 1)
    # Words from low[i] to high[i] may lie in one run with word i.
    cut = np.flatnonzero(~can)
    b, e, p = [], [], []
    # Where a boundary is closed no run crosses it.
    asked = np.flatnonzero((g.size >= shortest) & can[np.minimum(g.rep + g.left - 1, len(can) - 1)])
    for r in asked.tolist():
        rep, mid = int(g.rep[r]), int(g.rep[r] + g.left[r])
        k = int(np.searchsorted(cut, mid - 1))
        low = max(rep, int(cut[k - 1]) + 1 if k else 0)
        high = min(rep + int(g.size[r]), int(cut[k]) + 1)
        if high - low < shortest:
            continue
        for s, t, q in crossing(words[low:high], mid - low, exponent, shortest):
            where = g.places[g.bounds[r] : g.bounds[r + 1]] - rep + low
            b.append(where + s)
            e.append(where + t)
            p.append(np.full(len(where), q))
    inner = g.tops[(g.tops > 0)]
    inner = inner[can[inner - 1]]
    k = np.searchsorted(cut, inner - 1)
    low, high = np.where(k > 0, cut[np.maximum(k - 1, 0)] + 1, 0), cut[np.minimum(k, len(cut) - 1)] + 1 if len(cut) else inner
    wide = high - low >= shortest
    inner, low, high = inner[wide], low[wide], high[wide]
    edges = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]])) if len(inner) else np.zeros(1, np.int64)
    todo = [(int(low[x]), int(high[x]), int(x), int(y)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    while todo:
        lo, hi, x, y = todo.pop()
        if x >= y or hi - lo < shortest:
            continue
        half = (x + y) // 2
        mid = int(inner[half])
        for s, t, q in crossing(words[lo:hi], mid - lo, exponent, shortest):
            b.append(np.array([lo + s]))
            e.append(np.array([lo + t]))
            p.append(np.array([q]))
        todo += [(lo, mid, x, half), (mid, hi, half + 1, y)]
    if not b:
        none = np.zeros(0, np.int64)
        return none, none, none
    return merge(np.concatenate(b), np.concatenate(e), np.concatenate(p))
