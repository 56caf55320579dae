"""A minimal acyclic transducer from byte strings to rows of a table, as flat arrays that can be memory-mapped.

Words are added in sorted order and equal suffixes are shared as they are closed (incremental construction of Daciuk and
others, 2000). Each arc carries an additive output; the sum along a word's path is the word's rank among all words, so
words share suffix states and still have outputs of their own. A lookup walks all words of a batch together, one byte a
step, with a binary search in the sorted arc keys.
"""

from __future__ import annotations

import io

import numpy as np

_HEAD = 8


def compile_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """The .npy payload for a lexicon {word: ids}; the empty word is not stored."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]
    previous = b""
    for word in words:
        common = 0
        limit = min(len(word), len(previous))
        while common < limit and word[common] == previous[common]:
            common += 1
        while len(path) > common + 1:
            child = close(path.pop())
            path[-1][1].append((previous[len(path) - 1], child))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        child = close(path.pop())
        path[-1][1].append((previous[len(path) - 1], child))
    root = close(path[0])

    below = np.zeros(len(states), np.int64)
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):  # children have smaller numbers
        total = int(final)
        for label, child in arcs:
            keys.append(s * 256 + label)
            targets.append(child)
            outputs.append(total)
            total += int(below[child])
        below[s] = total
    finals = [int(final) for final, _ in states]
    lengths = [len(entries[w]) for w in words]
    ids = [i for w in words for i in entries[w]]
    head = [len(keys), len(states), len(words), len(ids), root, 0, 0, 0]
    flat = np.array([*head, *keys, *targets, *outputs, *finals, *np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).tolist(), *ids], dtype=np.int32)
    out = io.BytesIO()
    np.save(out, flat)
    return out.getvalue()


class Transducer:
    """A compiled lexicon, opened by memory map: every worker of a machine shares its pages."""

    def __init__(self, path: str):
        flat = np.load(path, mmap_mode="r")
        n_arcs, n_states, n_words, n_ids, self.root = (int(x) for x in flat[:5])
        cut = np.cumsum([_HEAD, n_arcs, n_arcs, n_arcs, n_states, n_words + 1, n_ids])
        self.keys, self.targets, self.outputs, self.finals, self.starts, self.ids = (flat[a:b] for a, b in zip(cut[:-1], cut[1:]))
        self.n_words = n_words

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, -1 where it is not in it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        result = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not len(words):
            return result
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        active = np.flatnonzero(lengths > 0)
        state = np.full(len(active), self.root, np.int64)
        weight = np.zeros(len(active), np.int64)
        step = 0
        while len(active):
            key = (state * 256 + data[begin[active] + step]).astype(np.int32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            active, at = active[ok], at[ok]
            state, weight = self.targets[at].astype(np.int64), weight[ok] + self.outputs[at]
            step += 1
            done = lengths[active] == step
            ended = done & (self.finals[state] == 1)
            result[active[ended]] = weight[ended]
            active, state, weight = active[~done], state[~done], weight[~done]
        return result
