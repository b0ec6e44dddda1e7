"""A minimal acyclic subsequential transducer from byte strings to lists of token ids, built in one pass over sorted
words, stored as flat arrays and read through a memory map."""

from __future__ import annotations

import array
import mmap
import os
import struct
import tempfile
from bisect import bisect_left
from collections.abc import Iterable, Sequence

import numpy as np

_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"QTRN"


class _State:
    __slots__ = ("arcs", "final", "final_out")

    def __init__(self):
        self.arcs: list[list] = []  # [label, target, output]
        self.final, self.final_out = False, ()

    def key(self):
        return (self.final, self.final_out, tuple((a, id(t), o) for a, t, o in self.arcs))


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_words(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The transducer of the given words, as bytes. Words must be distinct; they are sorted here."""
    register: dict = {}
    path = [_State()]
    last = b""

    def freeze(down_to: int) -> None:
        for i in range(len(path) - 1, down_to, -1):
            state = path.pop()
            path[i - 1].arcs[-1][1] = register.setdefault(state.key(), state)

    for word, out in sorted(words):
        if word == last and path[0].arcs:
            raise ValueError("words must be distinct")
        if not word:
            raise ValueError("words must not be empty")
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for i in range(shared):  # outputs on the shared prefix keep what both words begin with; the rest moves on
            arc = path[i].arcs[-1]
            n = _common(arc[2], out)
            if rest := arc[2][n:]:
                below = path[i + 1]
                for a in below.arcs:
                    a[2] = rest + a[2]
                if below.final:
                    below.final_out = rest + below.final_out
                arc[2] = arc[2][:n]
            out = out[n:]
        for i in range(shared, len(word)):
            path[i].arcs.append([word[i], None, out])
            out = ()
            path.append(_State())
        path[-1].final, path[-1].final_out = True, out
        last = word
    freeze(0)
    return _flat(path[0])


def _flat(root: _State) -> bytes:
    number, order, stack = {id(root): 0}, [root], [root]
    while stack:
        for _, t, _ in stack.pop().arcs:
            if id(t) not in number:
                number[id(t)] = len(order)
                order.append(t)
                stack.append(t)
    pool, where = array.array("I", [0]), {(): 0}

    def put(ids: tuple) -> int:
        if ids not in where:
            where[ids] = len(pool)
            pool.extend((len(ids), *ids))
        return where[ids]

    first, final, target, out, label = array.array("I"), array.array("I"), array.array("I"), array.array("I"), bytearray()
    for s in order:
        first.append(len(target))
        final.append(put(s.final_out) + 1 if s.final else 0)
        for a, t, o in s.arcs:
            label.append(a)
            target.append(number[id(t)])
            out.append(put(o))
    first.append(len(target))
    label.extend(b"\0" * (-len(label) % 4))
    parts = [first, final, target, out, pool]
    return _HEAD.pack(_MAGIC, len(order), len(target), len(pool), len(label)) + b"".join(p.tobytes() for p in parts) + bytes(label)


class Transducer:
    """Looks words up in a memory map of the compiled bytes."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing is left behind when the process ends
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, pool, labels = _HEAD.unpack_from(self._map)
        if magic != _MAGIC:
            raise ValueError("not a transducer")
        self.states, self.arcs = states, arcs
        view, at = memoryview(self._map), _HEAD.size

        def take(n: int, kind: str):
            nonlocal at
            size = n * (4 if kind == "I" else 1)
            part = view[at : at + size].cast(kind)
            at += size
            return part

        self._first, self._final, self._target, self._out = take(states + 1, "I"), take(states, "I"), take(arcs, "I"), take(arcs, "I")
        self._pool, self._label = take(pool, "I"), take(labels, "B")
        first, label = np.asarray(self._first), np.asarray(self._label)[:arcs]
        self._ends, self._to = np.asarray(self._final) > 0, np.asarray(self._target)
        self._keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(first.astype(np.int64))) << 8 | label

    def accepts(self, words: Sequence[bytes]) -> np.ndarray:
        """Which of the words are in the lexicon: all walk the automaton together, a byte at a time."""
        out = np.zeros(len(words), bool)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        live, state, step = np.flatnonzero(size), np.zeros(np.count_nonzero(size), np.int64), 0
        while len(live) and len(self._keys):
            key = state << 8 | raw[begin[live] + step]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[at] == key
            live, state, step = live[hit], self._to[at[hit]].astype(np.int64), step + 1
            ended = size[live] == step
            out[live[ended]] = self._ends[state[ended]]
            live, state = live[~ended], state[~ended]
        return out

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        first, label, pool, state, ids = self._first, self._label, self._pool, 0, []
        for byte in word:
            end = first[state + 1]
            arc = bisect_left(label, byte, first[state], end)
            if arc == end or label[arc] != byte:
                return None
            if o := self._out[arc]:
                ids.extend(pool[o + 1 : o + 1 + pool[o]])
            state = self._target[arc]
        if not (o := self._final[state]):
            return None
        if o > 1:
            ids.extend(pool[o : o + pool[o - 1]])
        return ids
