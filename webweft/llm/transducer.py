"""A minimal acyclic transducer over bytes: words with id sequences, suffixes shared, in one flat file.

Each transition adds a number to the path's sum; the sum at a final state is the word's rank in
sorted order, which points to its ids. States with equal futures are one state, so the automaton
is minimal; it is laid out as plain arrays that np.memmap opens without a copy.
"""

from __future__ import annotations

import numpy as np

_MAGIC = 0x77777431


def build(words: list[bytes], ids: list[bytes]) -> bytes:
    """The file of an automaton for distinct words with their ids (uint32 bytes); words in any order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    # the path of the last word, not yet frozen: [final, [(byte, state), ...], byte that leads on]
    path: list[list] = [[False, [], None]]
    last = b""
    for i in order:
        w = words[i]
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            done = freeze(path.pop())
            path[-1][1].append((path[-1][2], done))
        for b in w[same:]:
            path[-1][2] = b
            path.append([False, [], None])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((path[-1][2], done))
    root = freeze(path[0])
    n = len(states)
    final = np.array([f for f, _ in states], dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    edge: list[tuple[int, int, int]] = []
    for s, (f, edges) in enumerate(states):  # a state's successors are frozen before it
        total = int(f)
        for b, t in edges:  # ascending by byte, so the keys are sorted
            edge.append((s << 8 | b, t, total))
            total += count[t]
        count[s] = total
    key, target, add = np.array(edge, dtype=np.int32).reshape(-1, 3).T
    flat = b"".join(ids[i] for i in order)
    start = np.cumsum([0] + [len(ids[i]) // 4 for i in order]).astype(np.int32)
    head = np.array([_MAGIC, n, len(key), root, len(words), len(flat) // 4], dtype=np.int32)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, final, key, target, add, start)) + flat


class Transducer:
    """A file of build(), memory-mapped; lookup() walks many words through it together."""

    def __init__(self, path: str):
        m = np.memmap(path, dtype=np.int32, mode="r")
        magic, n, edges, self.root, self.words, n_ids = (int(x) for x in m[:6])
        if magic != _MAGIC:
            raise ValueError(f"{path} is no transducer file")
        cuts = np.cumsum([6, n, edges, edges, edges, self.words + 1, n_ids])
        self.final, self.key, self.target, self.add, self.start, self.ids = (m[a:b] for a, b in zip(cuts, cuts[1:]))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 where it is not in the lexicon."""
        n = len(words)
        if not n or not self.words:
            return np.full(n, -1)
        length = np.array([len(w) for w in words])
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int32)
        state, total = np.full(n, self.root), np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        for k in range(int(length.max())):
            live = live[(length[live] > k)]
            if not len(live):
                break
            key = state[live] << 8 | data[start[live] + k]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            total[live] += self.add[at]
            state[live] = np.where(found, self.target[at], -1)
            live = live[found]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] == 1), total, -1)

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        ranks = self.ranks(words).tolist()
        # a view of the mapped file: only the ids that are asked for are copied
        flat, start = memoryview(self.ids).cast("B"), self.start
        return [bytes(flat[4 * int(start[r]) : 4 * int(start[r + 1])]) if r >= 0 else None for r in ranks]
