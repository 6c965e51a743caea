"""A k-way merge of sorted runs by a tournament tree of losers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


class LoserTree:
    """Yields the rows of k sorted runs in order: each step replays one leaf-to-root path, log2(k) comparisons.

    Nodes 1..k-1 hold the loser of their match, node 0 the winner of all. An exhausted run loses to every other; equal
    keys go by the runs' order, so the merge is stable.
    """

    def __init__(self, runs: list[Iterable], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.head: list = [None] * len(runs)
        self.keys: list = [None] * len(runs)
        for i in range(len(runs)):
            self._advance(i)
        self.tree = self._build()

    def _advance(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.head[i] = row
        self.keys[i] = (1, i) if row is None else (0, self.key(row), i)

    def _build(self) -> list[int]:
        k = len(self.runs)
        winners, tree = [0] * k + list(range(k)), [0] * max(k, 1)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self.keys[b] < self.keys[a]:
                a, b = b, a
            winners[node], tree[node] = a, b
        if k:
            tree[0] = winners[1] if k > 1 else 0
        return tree

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k:
            best = self.tree[0]
            if self.head[best] is None:
                return
            yield self.head[best]
            self._advance(best)
            node = (best + k) // 2
            while node:
                if self.keys[self.tree[node]] < self.keys[best]:
                    self.tree[node], best = best, self.tree[node]
                node //= 2
            self.tree[0] = best
