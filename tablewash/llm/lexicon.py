"""Minimal acyclic word transducer: words -> id sequences, in flat arrays that tasks memory-map.

Words that share beginnings share states, and after minimization words that
share endings share them too. An edge carries how many words sort before those
behind it, so the walk of a word sums up to its number, which finds its ids.
"""

from __future__ import annotations

import json

import numpy as np


def compile_lexicon(words: list[bytes], ids: list[np.ndarray], path: str) -> None:
    """Write the automaton of ``words`` (sorted, distinct, none empty) and their ids to ``path``."""
    nodes: list[dict[int, int]] = [{}]  # label -> node
    final: list[bool] = [False]
    merged: dict[tuple, int] = {}
    stack: list[tuple[int, int]] = []  # (parent, label) of the latest word's path

    def settle(depth: int) -> None:
        """Nodes of the latest word below ``depth`` become shared ones."""
        while len(stack) > depth:
            parent, label = stack.pop()
            child = nodes[parent][label]
            key = (final[child], tuple(nodes[child].items()))
            nodes[parent][label] = merged.setdefault(key, child)

    before = b""
    for word in words:
        if word <= before:
            raise ValueError("lexicon words must be sorted, distinct and not empty")
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        settle(same)
        at = nodes[stack[-1][0]][stack[-1][1]] if stack else 0
        for label in word[same:]:
            nodes.append({})
            final.append(False)
            nodes[at][label] = len(nodes) - 1
            stack.append((at, label))
            at = len(nodes) - 1
        final[at] = True
        before = word
    settle(0)

    number: dict[int, int] = {}
    order: list[int] = []
    todo = [0]
    while todo:
        x = todo.pop()
        if x not in number:
            number[x] = len(order)
            order.append(x)
            todo.extend(nodes[x].values())
    counts: dict[int, int] = {}

    def words_behind(root: int) -> int:
        todo = [root]
        while todo:
            x = todo[-1]
            open_ = [y for y in nodes[x].values() if y not in counts]
            if open_:
                todo.extend(open_)
            else:
                counts[x] = final[x] + sum(counts[y] for y in nodes[x].values())
                todo.pop()
        return counts[root]

    words_behind(0)
    keys, targets, skips = [], [], []
    for x in order:
        skip = int(final[x])
        for label in sorted(nodes[x]):
            y = nodes[x][label]
            keys.append(number[x] * 256 + label)
            targets.append(number[y])
            skips.append(skip)
            skip += counts[y]
    arrays = {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int64),
        "skips": np.array(skips, np.int64),
        "final": np.array([final[x] for x in order], np.int64),
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        "ids": np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64),
    }
    head = json.dumps({"longest": max(map(len, words), default=0), "sizes": {k: len(v) for k, v in arrays.items()}}).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for v in arrays.values():
            f.write(v.tobytes())


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        flat = np.memmap(path, np.uint8, "r")
        at = 8 + n + -n % 8
        for k, size in head["sizes"].items():
            setattr(self, k, flat[at : at + 8 * size].view(np.int64))
            at += 8 * size
        self.longest = head["longest"]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the lexicon, -1 where it is not in it; all words walk in step."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        known = (lengths > 0) & (lengths <= self.longest)
        if not known.any() or not len(self.keys):
            return np.full(len(words), -1, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(known)
        for step in range(self.longest):
            key = state[live] * 256 + raw[begin[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            known[live[~there]] = False
            live, edge = live[there], edge[there]
            state[live] = self.targets[edge]
            number[live] += self.skips[edge]
            live = live[lengths[live] > step + 1]
            if not len(live):
                break
        known &= self.final[state] == 1
        return np.where(known, number, -1)

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]
