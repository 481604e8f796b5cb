"""Probabilistic automata learned from strings by merging states of their prefix tree (ALERGIA)."""

from __future__ import annotations

import math
import os.path
from collections.abc import Iterable

END = ""  # the symbol of stopping
UNSEEN = 1e-4  # probability that stays for symbols of a kind a state has not shown, shared by 64
ALIKE = 0.1  # probability that is dealt evenly over the symbols of the kinds a state has shown


def kind(symbol: str) -> tuple[str, int]:
    """The kind of a symbol and how many symbols are of it."""
    if symbol.isdigit():
        return "digit", 10
    if "a" <= symbol <= "z":
        return "small", 26
    return ("capital", 26) if "A" <= symbol <= "Z" else (symbol, 1)


class Automaton:
    """States with counts of next symbols; ``score`` is a log-likelihood ratio against ordinary text."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        strings = list(strings)
        self.literal = os.path.commonprefix(strings)
        self.symbols = set("".join(strings))
        self.lengths = {len(s) for s in strings}
        self.steps: dict[tuple[int, str], tuple[float, int]] = {}
        self.counts: list[dict[str, int]] = [{}]
        self.next: list[dict[str, int]] = [{}]
        for string in strings:
            state = 0
            for symbol in string:
                self.counts[state][symbol] = self.counts[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.counts)
                    self.counts.append({})
                    self.next.append({})
                state = self.next[state][symbol]
            self.counts[state][END] = self.counts[state].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _merge_all(self) -> None:
        """Red states are final; every state one step away is merged into a compatible red state or becomes red."""
        red, at = [0], 0
        while at < len(red):
            state = red[at]
            at += 1
            for symbol in sorted(self.next[state]):
                blue = self.next[state][symbol]
                if blue in red:
                    continue
                target = next((r for r in red if self._compatible(r, blue)), None)
                if target is None:
                    red.append(blue)
                else:
                    self.next[state][symbol] = target
                    self._fold(target, blue)
                    at = 0  # a red state may have got new successors
        kept = {state: i for i, state in enumerate(red)}
        self.counts = [self.counts[s] for s in red]
        self.next = [{x: kept[t] for x, t in self.next[s].items()} for s in red]

    def _differ(self, a: dict[str, int], b: dict[str, int]) -> bool:
        n, m = sum(a.values()), sum(b.values())
        limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a.get(x, 0) / n - b.get(x, 0) / m) > limit for x in {*a, *b})

    def _compatible(self, a: int, b: int) -> bool:
        """Hoeffding tests on this pair of states and on all pairs below it."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.counts[a], self.counts[b]):
                return False
            todo += [(self.next[a][x], self.next[b][x]) for x in self.next[b] if x in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for x, n in self.counts[b].items():
                self.counts[a][x] = self.counts[a].get(x, 0) + n
            for x, child in self.next[b].items():
                if x in self.next[a]:
                    todo.append((self.next[a][x], child))
                else:
                    self.next[a][x] = child

    def score(self, string: str) -> float:
        """log P(string | automaton) - log P(string | ordinary text)."""
        state, total = 0, 0.0
        for symbol in [*string, END]:
            total += math.log(self._share(state, symbol)) - math.log(ordinary(symbol))
            if symbol != END and self.next[state]:
                usual = max(self.next[state], key=lambda x: (self.counts[state][x], x))
                state = self.next[state].get(symbol, self.next[state][usual])
            if total < -40:
                break
        return total

    def _step(self, state: int, symbol: str) -> tuple[float, int]:
        """What a symbol adds to the score, and the next state."""
        if (state, symbol) not in self.steps:
            after = state
            if symbol != END and self.next[state]:
                usual = max(self.next[state], key=lambda x: (self.counts[state][x], x))
                after = self.next[state].get(symbol, self.next[state][usual])
            self.steps[state, symbol] = math.log(self._share(state, symbol)) - math.log(ordinary(symbol)), after
        return self.steps[state, symbol]

    def scores(self, string: str) -> list[float]:
        """The scores of all beginnings of a string, from the empty one on."""
        state, total, out = 0, 0.0, []
        for symbol in string:
            out.append(total + self._step(state, END)[0])
            more, state = self._step(state, symbol)
            total += more
        return [*out, total + self._step(state, END)[0]]

    def _share(self, state: int, symbol: str) -> float:
        counts = self.counts[state]
        seen = sum(counts.values())
        name, size = kind(symbol)
        alike = sum(n for x, n in counts.items() if kind(x)[0] == name) / size
        return (1 - UNSEEN) * ((1 - ALIKE) * counts.get(symbol, 0) + ALIKE * alike) / seen + UNSEEN / 64


def ordinary(symbol: str) -> float:
    """Probability of a character of a word in ordinary text: mostly small letters."""
    if symbol == END:
        return 0.1
    if "a" <= symbol <= "z":
        return 0.9 / 26
    if "A" <= symbol <= "Z":
        return 0.05 / 26
    return 0.03 / 10 if symbol.isdigit() else 0.02 / 7
