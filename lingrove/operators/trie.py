"""Many n-grams looked for in bytes at once: all positions go down a trie together, one byte a step, and those that leave it drop out.

A key is packed as in ``grams``. A step is two lookups in small tables in place of a search among all keys, and each length goes on from the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np

MAX_CELLS = 8 << 20  # of a table of steps; a larger one is searched


class Trie:
    """keys: by length (2 to 8 bytes) the sorted distinct keys. Only these are pickled; the tables are made where they are first used."""

    def __init__(self, keys: Mapping[int, np.ndarray]):
        self.keys = {n: np.asarray(k, np.int64) for n, k in keys.items() if len(k)}
        self._made = False

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "_made": False}

    def _make(self) -> None:
        nodes: dict[int, np.ndarray] = {}
        for n in range(max(self.keys), 1, -1):
            parts = [self.keys[n].view(np.uint64)] if n in self.keys else []
            if n + 1 in nodes:
                parts.append(nodes[n + 1] >> np.uint64(8))
            nodes[n] = np.unique(np.concatenate(parts))
        self.nodes = {n: v.view(np.int64) for n, v in nodes.items()}
        used = np.unique(np.concatenate([(v & np.uint64(255)).astype(np.uint8) for v in nodes.values()]))
        self.width = len(used) + 1
        self.code = np.full(256, len(used), np.int32)
        self.code[used] = np.arange(len(used))
        self.first = np.full(1 << 16, -1, np.int32)
        self.first[self.nodes[2]] = np.arange(len(self.nodes[2]))
        self.steps: dict[int, tuple[bool, np.ndarray]] = {}
        for n in range(3, max(nodes) + 1):
            edge = np.searchsorted(nodes[n - 1], nodes[n] >> np.uint64(8)) * self.width + self.code[(nodes[n] & np.uint64(255)).astype(np.uint8)]
            if len(nodes[n - 1]) * self.width <= MAX_CELLS:
                table = np.full(len(nodes[n - 1]) * self.width, -1, np.int32)
                table[edge] = np.arange(len(edge))
                self.steps[n] = True, table
            else:
                self.steps[n] = False, edge
        # of the own keys of each length, the nodes, and for each node its place among them (-1: only the beginning of a key)
        self.own, self.place = {}, {}
        for n, k in self.keys.items():
            self.own[n] = np.searchsorted(nodes[n], k.view(np.uint64))
            self.place[n] = np.full(len(nodes[n]), -1, np.int64)
            self.place[n][self.own[n]] = np.arange(len(k))
        self._made = True

    def make(self) -> Trie:
        if not self._made and self.keys:
            self._make()
        return self

    def walk(self, data: np.ndarray, ok: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, nodes) for each length from 2 on: the starts, in order, from which the data goes on as a key does. ok: starts that count."""
        self.make()
        if not self.keys or len(data) < 2:
            return
        node = self.first[(data[:-1].astype(np.int32) << 8) | data[1:]]
        there = node >= 0
        if ok is not None:
            there &= ok[: len(there)]
        start = np.flatnonzero(there)
        node = node[start]
        yield 2, start, node
        code = self.code[data]
        for n, (dense, table) in self.steps.items():
            last = np.searchsorted(start, len(data) - n, "right")
            start, node = start[:last], node[:last]
            if not len(start):
                return
            if dense:
                node = table[node * np.int32(self.width) + code[start + (n - 1)]]
                on = np.flatnonzero(node >= 0)
            else:
                edge = node.astype(np.int64) * self.width + code[start + (n - 1)]
                node = np.minimum(np.searchsorted(table, edge), len(table) - 1)
                on = np.flatnonzero(table[node] == edge)
            start, node = start[on], node[on]
            yield n, start, node


def within_rows(offs: np.ndarray, size: int) -> np.ndarray:
    """Which starts have ``size`` bytes before the next row begins."""
    ok = np.ones(int(offs[-1]), bool)
    for k in range(1, size):
        at = offs[1:] - k
        ok[at[at >= 0]] = False
    return ok
