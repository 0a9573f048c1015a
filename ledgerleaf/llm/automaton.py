"""Levenshtein automata intersected with a lexicon trie.

A state is the set of trie nodes that the letters read so far can reach, each with its
least number of edits. Nodes whose terms allow no more edits fall out, so most words end
after a few letters. States and steps are made when they are first met and then kept, so
a word costs one look-up a letter.
"""

from __future__ import annotations

#: Edits allowed by the length of a term: none below 5 letters, one below 10, else two.
SHORT, LONG = 5, 10
#: Steps kept; when there are more, all are dropped and made again.
STEPS = 400_000


def edits_of(term: str) -> int:
    return 0 if len(term) < SHORT else 1 if len(term) < LONG else 2


class Automaton:
    """Matches words against terms within the edits of each term."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.allowed: list[int] = [0]
        self.terms = sorted(set(terms))
        for i, term in enumerate(self.terms):
            node, k = 0, edits_of(term)
            self.allowed[0] = max(self.allowed[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], k)
            self.term[node] = i
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.final: list[tuple[int, int] | None] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Closes a set under skipped letters of a term and numbers it."""
        work = list(reached.items())
        while work:
            node, e = work.pop()
            if reached.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    work.append((child, e + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= edits_of(self.terms[self.term[n]])]
            self.final.append(min(ends)[::-1] if ends else None)
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)
            for c, child in self.children[node].items():
                reach(child, e if c == letter else e + 1)
        return self._state(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term and its edits; of equally near ones the first in order."""
        if len(self.steps) > STEPS:
            self._forget()
        state, steps = self.start, self.steps
        for c in word:
            to = steps.get((state, c))
            if to is None:
                to = steps[state, c] = self._step(state, c)
            if to == self.dead:
                return None
            state = to
        return self.final[state]
