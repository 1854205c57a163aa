"""Cuts of batches of utterances by a frozen model of words and edges, in arrays of numbers."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

from .splits import NONE, Words

#: Letters that are cut together.
CELLS = 1 << 18


class Model:
    """Known words as a tree, and known edges as tables over the numbers of one or two letters; the last number stands for no letter.

    Only for windows of at most two units and edges that aren't empty: slices of wider windows may pass the ends of what is left of an utterance.
    """

    def __init__(self, words: Mapping[str, int], begins: Mapping[str, int], ends: Mapping[str, int], window: int, by_frequency: bool) -> None:
        self.window, self.by_frequency = window, by_frequency
        self.words = Words(dict(words), dict.fromkeys("".join([*begins, *ends]), 0), 0, 0)
        self.none = self.words.wide
        self.right, self.left = (np.zeros((self.none + 1, self.none + 1), dtype=bool) for _ in range(2))
        place = {chr(c): k for k, c in enumerate(self.words.known.tolist())}
        for table, edges in ((self.right, begins), (self.left, ends)):
            for edge in edges:
                if len(edge) == window:
                    table[place[edge[0]], place[edge[1]] if window == 2 else slice(None)] = True
                elif len(edge) < window:  # one letter that is the last of its utterance
                    table[place[edge], self.none] = True

    @staticmethod
    def fits(begins: Mapping[str, int], ends: Mapping[str, int], window: int) -> bool:
        return 1 <= window <= 2 and "" not in begins and "" not in ends

    def hits(self, letters: np.ndarray) -> np.ndarray:
        """For each place the end of the known word that is chosen there, 0 without one. Between utterances stand two that are no letter."""
        after = np.concatenate([letters, [self.none] * 2])
        right = np.append(self.right[after[:-2], after[1:-1]], False)
        found, height = np.zeros(len(letters), dtype=np.int64), np.zeros(len(letters), dtype=np.int64)
        spelled = np.minimum(letters, self.none - 1)  # no word has an unknown letter, nor a gap
        at = np.flatnonzero(letters < self.none - 1)
        node, here = np.ones(len(at), dtype=np.int64), at
        while len(at):
            node = self.words.step(node, spelled[here])
            at, here, node = at[node > 0], here[node > 0] + 1, node[node > 0]
            n = self.words.costs[node]
            whole, fit = n < NONE, right[here]
            if self.by_frequency:  # a longer word that is as frequent takes the place of the one before, whether its edge fits or not
                found[at[whole & (n >= height[at])]] = 0
                new = whole & fit & (found[at] == 0)
                found[at[new]], height[at[new]] = here[new], n[new]
            else:
                new = whole & fit
                found[at[new]] = here[new]
                at, here, node = at[~new], here[~new], node[~new]
            inside = here < len(letters)
            at, here, node = at[inside], here[inside], node[inside]
        return found

    def begun(self, letters: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether a word begins at each place, of utterances from ``starts`` to ``stops``; their own first places aside."""
        hit, w = self.hits(letters), self.window
        fits = np.zeros(len(letters), dtype=bool)
        fits[w:] = self.left[letters[:-w], letters[1 : len(letters) - 1] if w == 2 else 0]
        places = np.where(fits & (hit > 0), np.arange(len(letters)), len(letters))
        following = np.minimum.accumulate(places[::-1])[::-1]
        cut, at, stop = np.zeros(len(letters) + 1, dtype=bool), starts, stops
        while len(at):
            first = np.where(hit[at] > 0, at, following[at + w])
            open_ = first < stop
            at, first, stop = at[open_], first[open_], stop[open_]
            cut[first] = True
            at = hit[first]
            cut[at] = True
            at, stop = at[at < stop], stop[at < stop]
        cut[starts] = False
        return cut[:-1]

    def cut(self, texts: list[str]) -> list[str]:
        """Utterances of letters, without spaces, as words apart by spaces."""
        out: list[str] = []
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        done = 0
        for upto in [*np.flatnonzero(np.diff(np.cumsum(sizes) // CELLS)) + 1, len(texts)]:
            some, size = texts[done:upto], sizes[done:upto]
            done = upto
            if not some:
                continue
            codes = np.frombuffer("".join(t + "\0\0" for t in some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            starts = np.cumsum(size + 2) - size - 2
            stops = starts + size
            letters = self.words.numbers(codes)
            letters[stops] = letters[stops + 1] = self.none
            begun = np.flatnonzero(self.begun(letters, starts, stops))
            begun = begun[~np.isin(begun, stops)]
            spaced = np.insert(codes, begun, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            more = np.searchsorted(begun, starts), np.searchsorted(begun, stops)
            out += [spaced[a:b] for a, b in zip((starts + more[0]).tolist(), (stops + more[1]).tolist(), strict=True)]
        return out
