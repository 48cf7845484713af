"""A minimal acyclic transducer from words to id sequences, in flat arrays that can be memory-mapped.

Built from sorted words in one pass: ids stand on the earliest edge at which all words through it share
them, and states with equal edges and outputs are one, so that words share suffixes as well as
prefixes. Lookups walk all words of a batch at once, a byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

Ids = tuple[int, ...]


class State:
    __slots__ = ("edges", "final")

    def __init__(self):
        self.edges: list[list] = []  # label, target, ids
        self.final: Ids | None = None  # ids at the end of a word


class Transducer(NamedTuple):
    """Edges in order of state and label; ``finals`` is -1 or where a final state's ids start."""

    keys: np.ndarray
    targets: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    finals: np.ndarray
    final_sizes: np.ndarray
    pool: np.ndarray
    root: np.ndarray  # the first state and the length of the longest word


def shared_head(a: Ids, b: Ids) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compile_words(entries: Iterable[tuple[bytes, Ids]]) -> Transducer:
    """``entries`` are words in byte order, each once and none empty, with their ids."""
    frozen: list[State] = []
    known: dict[tuple, int] = {}
    path, last, longest = [State()], b"", 0

    def freeze(state: State) -> int:
        key = (state.final, tuple(map(tuple, state.edges)))
        if key not in known:
            known[key] = len(frozen)
            frozen.append(state)
        return known[key]

    for word, ids in entries:
        if word <= last:
            raise ValueError("words must be in order, each once, and not empty")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1].edges[-1][1] = freeze(path.pop())
        # What an edge has beyond the common ids goes on to the next state.
        for state, after in zip(path[:same], path[1:], strict=False):
            edge = state.edges[-1]
            cut = shared_head(edge[2], ids)
            more, edge[2], ids = edge[2][cut:], edge[2][:cut], ids[cut:]
            if more:
                for next_edge in after.edges:
                    next_edge[2] = more + next_edge[2]
                if after.final is not None:
                    after.final = more + after.final
        for label in word[same:]:
            path[-1].edges.append([label, None, ids])
            path.append(State())
            ids = ()
        path[-1].final = ids
        last, longest = word, max(longest, len(word))
    for i in range(len(last), 0, -1):
        path[i - 1].edges[-1][1] = freeze(path.pop())
    root = freeze(path[0])
    pool: dict[Ids, int] = {(): 0}
    flat: list[int] = []

    def place(ids: Ids) -> int:
        if ids not in pool:
            pool[ids] = len(flat)
            flat.extend(ids)
        return pool[ids]

    edges = [(s * 256 + label, to, place(ids), len(ids))
             for s, state in enumerate(frozen) for label, to, ids in state.edges]
    finals = [(-1, 0) if s.final is None else (place(s.final), len(s.final)) for s in frozen]
    columns = list(zip(*edges, strict=True)) if edges else [()] * 4
    ends = list(zip(*finals, strict=True))
    return Transducer(*(np.array(c, np.int64) for c in (*columns, *ends, flat, (root, longest))))


def pack(transducer: Transducer) -> bytes:
    """One block of 64-bit numbers: the sizes of the arrays, then the arrays."""
    sizes = np.array([len(a) for a in transducer], np.int64)
    return np.concatenate([sizes, *transducer]).tobytes()


def mapped(path: str) -> Transducer:
    """The arrays of a file, read where they are touched."""
    whole = np.memmap(path, np.int64, "r")
    n = len(Transducer._fields)
    ends = n + np.cumsum(whole[:n])
    return Transducer(*(whole[j - size:j] for j, size in zip(
        ends.tolist(), whole[:n].tolist(), strict=True)))


def look_up(transducer: Transducer, words: list[bytes]) -> list[bytes | None]:
    """The ids of each word as packed 32-bit integers; None for words outside."""
    t, n = transducer, len(words)
    root, longest = t.root.tolist()
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(words), np.uint8)
    states, alive = np.full(n, root), np.flatnonzero((lengths > 0) & (lengths <= longest))
    inside = np.zeros(n, bool)
    found = []  # words, starts and sizes of ids, step by step
    step = 0
    while len(alive):
        keys = states[alive] * 256 + data[starts[alive] + step]
        at = np.searchsorted(t.keys, keys)
        good = t.keys[np.minimum(at, len(t.keys) - 1)] == keys
        alive, at = alive[good], at[good]
        states[alive] = t.targets[at]
        found.append((alive, t.starts[at], t.sizes[at]))
        step += 1
        done = lengths[alive] == step
        ended = alive[done]
        ended = ended[t.finals[states[ended]] >= 0]
        inside[ended] = True
        found.append((ended, t.finals[states[ended]], t.final_sizes[states[ended]]))
        alive = alive[~done]
    if not found:
        return [None] * n
    of, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
    some = (size > 0) & inside[of]
    of, start, size = of[some], start[some], size[some]
    order = np.argsort(of, kind="stable")
    of, start, size = of[order], start[order], size[order]
    first = np.cumsum(size) - size
    ids = t.pool[np.repeat(start - first, size) + np.arange(size.sum())].astype(np.int32).tobytes()
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, size, n))]).astype(np.int64) * 4
    return [ids[i:j] if known else None for i, j, known in zip(
        ends[:-1].tolist(), ends[1:].tolist(), inside.tolist(), strict=True)]
