"""Best splits of batches of utterances under a lexicon of words and costs, in arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Letters, with those that fill up shorter utterances, that are split together.
CELLS = 1 << 18
NONE = 1 << 60
#: Cells of a table of all steps of a tree; larger trees are searched.
STEPS = 1 << 22


class Words:
    """Known words as a tree over the numbers of letters: ``steps`` of (node, letter) to node, and each node's cost; node 0 is no word's start."""

    def __init__(self, words: dict[str, int], letters: dict[str, int], letter: int, new: int) -> None:
        self.new, self.longest = new, max(map(len, words), default=0)
        known = sorted({ord(c) for c in [*letters, *"".join(words)]})
        self.known = np.array(known, dtype=np.uint32)
        self.spelled = np.array([letters.get(chr(c), letter) for c in known] + [letter], dtype=np.int64)  # the last number is that of unknown letters
        place, self.wide = {chr(c): k for k, c in enumerate(known)}, len(known) + 1
        steps: dict[int, int] = {}
        costs = [NONE, NONE]
        for word, cost in words.items():
            node = 1
            for c in word:
                node = steps.setdefault(node * self.wide + place[c], len(costs))
                if node == len(costs):
                    costs.append(NONE)
            costs[node] = cost
        self.costs = np.array(costs, dtype=np.int64)
        keys = np.array(sorted(steps), dtype=np.int64)
        self.keys, self.nodes = keys, np.array([steps[k] for k in keys.tolist()], dtype=np.int64)
        self.table = np.zeros(len(costs) * self.wide, dtype=np.int32) if len(costs) * self.wide <= STEPS else None
        if self.table is not None:
            self.table[keys] = self.nodes

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at, len(self.known))

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(nodes), dtype=np.int64)
        wanted = nodes * self.wide + letters
        if self.table is not None:
            return self.table[wanted].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.nodes[at], 0)


def split_block(letters: np.ndarray, ends: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(begun, costs) of utterances that are the columns of ``letters`` (numbers, -1 below their end): where the words of the best split begin, and what it costs.

    ``ends`` marks letters that end a unit. Ties go to the earlier start.
    """
    height, width = letters.shape
    best, back = np.full((height + 1, width), NONE, dtype=np.int64), np.zeros((height + 1, width), dtype=np.int64)
    best[0] = 0
    units = np.vstack([np.ones((1, width), dtype=bool), ends])  # places where units meet
    spelled = np.vstack([np.zeros((1, width), dtype=np.int64), np.cumsum(np.where(letters < 0, 0, words.spelled[letters]), axis=0)])
    # known words, by where they stop: all places walk down the tree at once, those that leave it drop out
    flat, stops = letters.ravel(), []
    at = np.flatnonzero(units[:-1].ravel() & (flat >= 0))
    node = np.ones(len(at), dtype=np.int64)
    for k in range(min(words.longest, height)):
        here = at + k * width
        inside = here < len(flat)
        at, node, here = at[inside], node[inside], here[inside]
        inside = flat[here] >= 0
        at, node, here = at[inside], node[inside], here[inside]
        node = words.step(node, flat[here])
        at, here, node = at[node > 0], here[node > 0], node[node > 0]
        whole = (words.costs[node] < NONE) & ends.ravel()[here]
        stops.append(np.stack([here[whole] // width, here[whole] % width, at[whole] // width, words.costs[node[whole]]]))
    found = np.concatenate([np.zeros((4, 0), dtype=np.int64), *stops], axis=1)
    found = found[:, np.lexsort((found[2], found[0]))]
    bounds = np.searchsorted(found[0], np.arange(height + 1))
    open_, start = np.full(width, NONE, dtype=np.int64), np.zeros(width, dtype=np.int64)
    for j in range(height):
        from_here = np.where(units[j] & (best[j] < NONE), best[j] - spelled[j], NONE)
        nearer = from_here < open_
        open_, start = np.where(nearer, from_here, open_), np.where(nearer, j, start)
        cost, origin = open_ + spelled[j + 1] + words.new, start.copy()
        _, column, begin, own = found[:, bounds[j] : bounds[j + 1]]
        if len(column):
            ways = best[begin, column] + own
            order = np.lexsort((begin, ways, column))  # the least of each column first
            column, begin, ways = column[order], begin[order], ways[order]
            first = np.concatenate([[True], column[1:] != column[:-1]])
            column, begin, ways = column[first], begin[first], ways[first]
            better = (ways < cost[column]) | ((ways == cost[column]) & (begin < origin[column]))
            cost[column[better]], origin[column[better]] = ways[better], begin[better]
        best[j + 1], back[j + 1] = np.where(ends[j], cost, NONE), origin
    length = (letters >= 0).sum(axis=0)
    begun, column, place = np.zeros((height + 1, width), dtype=bool), np.arange(width), length
    while len(column := column[place > 0]):
        place = back[place[place > 0], column]
        begun[place, column] = True
    return begun[:-1], best[length, np.arange(width)]


def split_texts(texts: pa.Array, words: Words) -> tuple[list[str], np.ndarray]:
    """Texts of units apart by single spaces, joined to the words of their best splits, and what these cost; a null text is an empty one."""
    own = [t or "" for t in texts.to_pylist()]
    out, costs = [""] * len(own), np.zeros(len(own), dtype=np.int64)
    order = sorted((i for i, t in enumerate(own) if t), key=lambda i: len(own[i]))
    while order:
        some = max(1, CELLS // len(own[order[-1]]))
        taken, order = order[-some:], order[:-some]
        codes = [np.frombuffer(own[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for i in taken]
        spaces = [c == 32 for c in codes]
        bare = [c[~s] for c, s in zip(codes, spaces, strict=True)]
        letters, ends = np.full((max(map(len, bare)), len(bare)), -1, dtype=np.int64), np.zeros((max(map(len, bare)), len(bare)), dtype=bool)
        for k, (c, s) in enumerate(zip(bare, spaces, strict=True)):
            letters[: len(c), k] = words.numbers(c)
            ends[: len(c), k] = np.append(s[1:], True)[~s]
        begun, cost = split_block(letters, ends, words)
        for k, i in enumerate(taken):
            cut = np.flatnonzero(begun[1 : len(bare[k]), k]) + 1
            out[i] = np.insert(bare[k], cut, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        costs[taken] = cost
    return out, costs
