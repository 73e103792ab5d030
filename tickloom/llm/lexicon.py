"""A lexicon as a trie, searched with Levenshtein automata.

The trie holds whole words, and stems that words begin with. A word is looked
up exactly by walking the trie; misspelled, by walking it together with the
automaton that accepts all strings within one edit of the word (a swap of
neighbours is one): branches on which the automaton has no live state are never
entered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Shorter words have too many neighbours to be taken for misspelled terms.
FUZZY_LENGTH = 5
#: Sizes of words in bytes that are told apart; the last one stands for all above.
SIZES = 40


class Term(NamedTuple):
    text: str
    stem: bool        # words that go on count too
    weight: float     # evidence of the term as it stands
    misspelled: float  # evidence of a word one edit away


class Hit(NamedTuple):
    weight: float
    exact: bool
    term: str


class _Node:
    __slots__ = ("next", "word", "stem")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.word: Term | None = None
        self.stem: Term | None = None


class LevenshteinAutomaton:
    """Accepts what is at most ``edits`` insertions, deletions, changes and swaps of
    neighbours from ``word``.

    A state is a row of the edit table, cut off above ``edits``, with the row before it
    and the character between, which a swap looks back at.
    """

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits

    def start(self) -> tuple:
        return tuple(range(len(self.word) + 1)), None, ""

    def step(self, state: tuple, char: str) -> tuple:
        old, before, last = state
        most = self.edits + 1
        row = [most] * len(old)
        row[0] = min(old[0] + 1, most)
        # Only columns near a live one of the last row can be live.
        live = [i for i, d in enumerate(old) if d <= self.edits]
        swaps = [i for i, d in enumerate(before) if d < self.edits] if before else []
        first = min(live + swaps, default=len(old))
        end = max([i + 1 for i in live] + [i + 2 for i in swaps], default=-1) + self.edits
        for i in range(max(first, 1) - 1, min(end, len(old) - 1)):
            own = self.word[i]
            best = min(row[i] + 1, old[i + 1] + 1, old[i] + (own != char), most)
            if before and i and own == last and self.word[i - 1] == char:
                best = min(best, before[i - 1] + 1)
            row[i + 1] = best
        return tuple(row), old, char

    def alive(self, state: tuple) -> bool:
        row, before, _ = state
        # A swap can still end that begins in the row before.
        return min(row) <= self.edits or bool(before) and min(before) < self.edits

    def accepts(self, state: tuple) -> bool:
        return state[0][-1] <= self.edits


def _shortened(word: str) -> list[str]:
    """``word``, and all that it becomes without one letter."""
    return [word, *(word[:i] + word[i + 1:] for i in range(len(word)))]


class Lexicon:
    """``ordinary`` words are near a term, but words of their own, not misspellings."""

    def __init__(self, terms: list[Term], ordinary: frozenset[str] = frozenset()):
        self.terms, self.ordinary = terms, ordinary
        self._root = _Node()
        for term in terms:
            node = self._root
            for char in term.text:
                node = node.next.setdefault(char, _Node())
            if term.stem:
                node.stem = term
            else:
                node.word = term
        self._fuzzy = [t for t in terms if not t.stem and len(t.text) >= FUZZY_LENGTH]
        # First three bytes of terms; last two of those that may be misspelled, by size.
        self._first = np.zeros(1 << 24, bool)
        self._last = np.zeros((1 << 16, SIZES), bool)
        for t in terms:
            self._begins(t.text)
        for t in self._fuzzy:
            raw = t.text.encode()
            sizes = slice(min(max(len(raw) - 4, 0), SIZES - 1), min(len(raw) + 5, SIZES))
            self._last[int.from_bytes(raw[-2:], "big"), sizes] = True
            if len(t.text) == FUZZY_LENGTH:
                # A swap in the middle of so short a word reaches both ends.
                self._begins(t.text[:2] + t.text[3] + t.text[2])
        # What one edit can have in common with a term: both less a letter, or one of them.
        self._common = {c for t in self._fuzzy for c in _shortened(t.text)}
        self._known: dict[bytes, Hit | None] = {}

    def _begins(self, text: str) -> None:
        self._first[int.from_bytes(text.encode()[:3].ljust(3, b"\0"), "big")] = True

    def possible(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words (in lower case) worth looking up.

        One edit leaves either the first three or the last two letters of a term
        as they are, but for a swap in the middle of the shortest.
        """
        size = end - start
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        head = [np.where(size > k, padded[start + k], 0) for k in range(3)]
        tail = np.where(size >= 2, (padded[np.maximum(end - 2, 0)] << 8) | padded[end - 1], 0)
        return (self._first[(head[0] << 16) | (head[1] << 8) | head[2]]
                | self._last[tail, np.minimum(size, SIZES - 1)])

    def find(self, word: str) -> Hit | None:
        """The term that a word is, begins with, or misspells: the heaviest."""
        best, node = None, self._root
        for char in word:
            node = node.next.get(char)
            if node is None:
                break
            if node.stem and (best is None or node.stem.weight > best.weight):
                best = Hit(node.stem.weight, True, node.stem.text)
        if node is not None and node.word and (best is None or node.word.weight > best.weight):
            best = Hit(node.word.weight, True, node.word.text)
        if best is not None or len(word) < FUZZY_LENGTH - 1 or word in self.ordinary:
            return best
        # Most words are near no term; these need no walk.
        if self._common.isdisjoint(_shortened(word)):
            return None
        for term in self._near(word):
            if best is None or term.misspelled > best.weight:
                best = Hit(term.misspelled, False, term.text)
        return best

    def _near(self, word: str) -> Iterator[Term]:
        automaton = LevenshteinAutomaton(word)
        todo = [(self._root, automaton.start())]
        while todo:
            node, state = todo.pop()
            if (t := node.word) and len(t.text) >= FUZZY_LENGTH and automaton.accepts(state):
                yield t
            for char, child in node.next.items():
                after = automaton.step(state, char)
                if automaton.alive(after):
                    todo.append((child, after))

    def look_up(self, raw: bytes) -> Hit | None:
        """``find``, remembered: corpora repeat their words."""
        if raw not in self._known:
            if len(self._known) > 300_000:
                self._known.clear()
            self._known[raw] = self.find(raw.decode("utf-8", "ignore").lower())
        return self._known[raw]
