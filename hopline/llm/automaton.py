"""A generalised suffix automaton over word sequences."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """One state for all runs of words with the same end places; state 0 is the empty run."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: Iterable[Hashable]) -> list[int]:
        """Adds a sequence; returns the state of each of its prefixes."""
        last, states = 0, []
        for word in words:
            last = self._extend(last, word)
            states.append(last)
        return states

    def by_falling_length(self) -> list[int]:
        """All states but the first; a state comes before the one that its link names."""
        return sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)

    def _new(self, length: int, link: int, nxt: dict[Hashable, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.link) - 1

    def _split(self, state: int, word: Hashable, child: int) -> int:
        """The state for runs ending in ``word`` that are at most one word longer than those of ``state``."""
        clone = self._new(self.length[state] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = clone
        while state >= 0 and self.next[state].get(word) == child:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: Hashable) -> int:
        child = self.next[last].get(word)
        if child is not None:  # an earlier sequence has this run already
            return child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        new, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.next[at][word]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, word, child)
        return new
