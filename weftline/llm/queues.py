"""A priority queue that keeps a bounded part in memory."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

#: Messages held in memory, and messages of a sorted run that are read back at once.
HELD, READ = 200_000, 4096


class SpillingQueue:
    """Messages, tuples of plain values, in ascending order.

    Past ``held`` messages the queue writes all it holds as one sorted run; the least message is that of the heap or of
    some run's head. Runs lie in unnamed files of the task alone, which end with it, like Spark's own spills.
    """

    def __init__(self, held: int = HELD) -> None:
        self.held = held
        self.heap: list[tuple] = []
        self.heads: list[tuple[tuple, int]] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            message, run = self.heads[0]
            following = next(self.runs[run], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, run))
            return message
        return heapq.heappop(self.heap)

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        for at in range(0, len(self.heap), READ):
            pickle.dump(self.heap[at : at + READ], file)
        self.heap = []
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                while True:
                    try:
                        yield from pickle.load(file)
                    except EOFError:
                        return

        run = read()
        heapq.heappush(self.heads, (next(run), len(self.runs)))
        self.runs.append(run)
