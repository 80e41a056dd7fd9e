"""A generalised suffix automaton over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterable


class Automaton:
    """Generalised suffix automaton over symbol sequences, with flat transitions."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.step: dict[int, int] = {}
        self.link = [-1]
        self.length = [0]
        self._out: list[list[int]] = [[]]  # symbols that leave a state

    def _new(self, length: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        self._out.append([])
        return len(self.length) - 1

    def _set(self, state: int, symbol: int, to: int) -> None:
        key = state * self.width + symbol
        if key not in self.step:
            self._out[state].append(symbol)
        self.step[key] = to

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A copy of q for the strings that end in p's and the symbol."""
        w, clone = self.width, self._new(self.length[p] + 1)
        for s in self._out[q]:
            self._set(clone, s, self.step[q * w + s])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.step.get(p * w + symbol) == q:
            self.step[p * w + symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: Iterable[int]) -> None:
        w, last = self.width, 0
        for symbol in symbols:
            q = self.step.get(last * w + symbol)
            if q is not None:  # the string is known already
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
                continue
            new, p = self._new(self.length[last] + 1), last
            while p >= 0 and p * w + symbol not in self.step:
                self._set(p, symbol, new)
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.step[p * w + symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = new

    def walk(self, symbols: Iterable[int]) -> int:
        state = 0
        for symbol in symbols:
            state = self.step[state * self.width + symbol]
        return state

    def finish(self) -> Automaton:
        self._out = []
        return self
