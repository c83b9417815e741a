"""Packing a histogram of lengths into sequences of one capacity, by linear grouping.

Large lengths are rounded up to the largest of their group, all groups holding equally many pieces; configurations of the few
sizes left are optimised by column generation; actual lengths then take the places, and what remains, small lengths
above all, goes where it fits best. Everything here works on counts: the effort depends on the capacity, not on the
number of pieces.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: Lengths above the capacity over one of these are large, tried in turn; groups they are rounded in.
LARGE, GROUPS = (8, 4, 2), 64
#: A plan this near the least number of sequences that could hold all tokens ends the trial.
NEAR = 1.0002
#: Configurations this near the optimum of the relaxed problem will do.
CLOSE = 1e-4
_EPS = 1e-9


@dataclass
class Plan:
    """Where pieces go: those numbered ``first[i]`` to ``first[i] + count[i] - 1`` among all of ``length[i]`` lie in the
    sequences from ``sequence[i]`` on, one in each, at ``offset[i]``. Ordered by length, then number."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def place(self, length: int, first: int, count: int, sequence: int, offset: int) -> None:
        if count:
            self.rows.append((length, first, count, sequence, offset))

    def open(self, count: int) -> int:
        begin = self.sequences
        self.sequences += count
        return begin

    def arrays(self) -> np.ndarray:
        """Columns length, first, count, sequence, offset."""
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5).T


def _best_configuration(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest total worth, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for g, (w, s) in enumerate(zip(worth.tolist(), sizes.tolist(), strict=True)):
        if w <= _EPS:
            continue
        now = best.copy()
        for times in range(1, capacity // s + 1):
            with_it = best[: capacity + 1 - times * s] + times * w
            better = with_it > now[times * s :] + _EPS
            now[times * s :][better] = with_it[better]
            taken[g, times * s :][better] = times
        best = now
    chosen = np.zeros(len(sizes), np.int64)
    room = capacity
    for g in range(len(sizes) - 1, -1, -1):
        chosen[g] = taken[g, room]
        room -= int(chosen[g] * sizes[g])
    return float(best[capacity]), chosen


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, together at most the demand: nearly the optimum of the relaxed problem,
    rounded down. ``sizes`` are distinct; there are at most as many configurations as sizes."""
    n = len(sizes)
    if not n:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * n + 100):
        inverse = np.linalg.inv(basis)
        worth, chosen = _best_configuration(np.maximum(inverse.sum(axis=0), 0), sizes, capacity)
        used, step = inverse @ demand, inverse @ chosen
        # No choice of configurations needs less than the sum over the worth.
        if worth <= 1 + 1e-7 or used.sum() * (1 - 1 / worth) < max(0.5, CLOSE * used.sum()):
            break
        ratio = np.where(step > _EPS, np.maximum(used, 0) / np.where(step > _EPS, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = chosen
    times = np.maximum(np.floor(np.linalg.solve(basis, demand) + 1e-6), 0).astype(np.int64)
    left = demand.astype(np.int64).copy()
    result = []
    for column, wanted in zip(basis.T.round().astype(np.int64), times.tolist(), strict=True):
        need = column > 0
        count = min(wanted, int((left[need] // column[need]).min())) if need.any() else 0
        if count > 0:
            left -= column * count
            result.append((column, count))
    return result


def _substituted(plan: Plan, counts: np.ndarray, share: int, groups: int) -> tuple[dict[int, list], dict[int, list]]:
    """Places large pieces as configurations say; gives the open sequences by room, and the pieces left by length."""
    capacity = plan.capacity
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)
    lengths = np.arange(len(counts))
    large = np.where((lengths > capacity // share) & (lengths < capacity), counts, 0)
    total = int(large.sum())
    if not total:
        return rooms, left
    until = np.cumsum(large)  # ranks among the large pieces, shortest first
    cuts = np.unique(np.array([(total * g) // groups for g in range(1, groups + 1)], np.int64))
    cuts = cuts[cuts > 0]
    rounded = np.searchsorted(until, cuts)  # the largest length of each group: that of its last rank
    sizes, last = np.unique(rounded[::-1], return_index=True)
    ends = cuts[::-1][last]
    begins = np.concatenate([[0], ends[:-1]])
    next_rank = begins.copy()

    def pieces(rank: int, count: int):
        """Lengths along ``count`` ranks from ``rank``: (steps from rank, length, number among its length, how many)."""
        at = rank
        while at < rank + count:
            length = int(np.searchsorted(until, at, side="right"))
            here = min(int(until[length]), rank + count) - at
            yield at - rank, length, at - int(until[length] - large[length]), here
            at += here

    for column, times in configurations(sizes, (ends - begins).astype(np.int64), capacity):
        base = plan.open(times)
        # One slot takes neighbouring ranks, so a slot's lengths change at few of the sequences.
        used = np.zeros(times + 1, np.int64)
        bounds = {0, times}
        slots = []
        for g in np.flatnonzero(column).tolist():
            for _ in range(int(column[g])):
                slot = list(pieces(int(next_rank[g]), times))
                next_rank[g] += times
                slots.append(slot)
                bounds.update(step for step, *_ in slot)
        edges = sorted(bounds)
        used = dict.fromkeys(edges[:-1], 0)
        for slot in slots:
            starts = [step for step, *_ in slot]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                step, length, number, _ = slot[bisect.bisect_right(starts, low) - 1]
                plan.place(length, number + low - step, high - low, base + low, used[low])
                used[low] += length
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rooms[capacity - used[low]].append((base + low, high - low))
    for g in range(len(sizes)):
        for _, length, number, here in pieces(int(next_rank[g]), int(ends[g] - next_rank[g])):
            left[length].append((number, here))
    return rooms, left


def pack(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> Plan:
    """A plan for ``counts[l]`` pieces of each length l from 1 to ``capacity``: that of the fewest sequences among those
    for each notion of a large piece."""
    tokens = int((np.arange(capacity + 1) * counts).sum())
    best = None
    for share in LARGE:
        plan = _packed(counts, capacity, share, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= NEAR * -(-tokens // capacity):
            break
    return best


def _packed(counts: np.ndarray, capacity: int, share: int, groups: int) -> Plan:
    plan = Plan(capacity)
    full = int(counts[capacity])
    plan.place(capacity, 0, full, plan.open(full), 0)
    rooms, left = _substituted(plan, counts, share, groups)
    rooms.pop(0, None)
    spaces = sorted(rooms)
    small = range(1, min(capacity // share, capacity - 1) + 1)
    lots = {**left, **{int(s): [(0, int(counts[s]))] for s in small if counts[s]}}
    for length in sorted(lots, reverse=True):
        for first, count in lots[length]:
            while count:
                k = bisect.bisect_left(spaces, length)
                if k == len(spaces):
                    # Nothing has the room: as many fresh sequences as the rest fills, and one that it does not.
                    each = capacity // length
                    for many, fresh in ((each, count // each), (count % each, 1)):
                        if not many or not fresh:
                            continue
                        base = plan.open(fresh)
                        for slot in range(many):
                            plan.place(length, first + slot * fresh, fresh, base, slot * length)
                        first, count = first + many * fresh, count - many * fresh
                        _keep(rooms, spaces, capacity - many * length, (base, fresh))
                    break
                room = spaces[k]
                base, held = rooms[room].pop()
                now = min(held, count)
                if now < held:
                    rooms[room].append((base + now, held - now))
                if not rooms[room]:
                    del rooms[room], spaces[k]
                plan.place(length, first, now, base, capacity - room)
                first, count = first + now, count - now
                _keep(rooms, spaces, room - length, (base, now))
    return plan


def _keep(rooms: dict[int, list], spaces: list[int], room: int, sequences: tuple[int, int]) -> None:
    if not room:
        return
    if not rooms.get(room):
        bisect.insort(spaces, room)
        rooms[room] = []
    rooms[room].append(sequences)
