"""Probabilistic automata inferred from example strings by state merging (ALERGIA)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

RARE = 1e-4     # probability of whatever an automaton has not seen at a state, shared by 100 characters


class Automaton:
    """A prefix tree of the examples whose statistically compatible states are merged, red and blue."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.moves: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        self.passes: list[int] = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for text in sorted(examples):
            self._add(text)
        self._merge_all()

    def _add(self, text: str) -> None:
        at = 0
        self.passes[0] += 1
        for c in text:
            self.moves[at][c] += 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.moves.append(Counter())
                self.ends.append(0)
                self.passes.append(0)
            at = self.next[at][c]
            self.passes[at] += 1
        self.ends[at] += 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, red: int, blue: int) -> bool:
        open_ = [(red, blue)]
        while open_:
            a, b = open_.pop()
            n, m = self.passes[a], self.passes[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                if self._differ(self.moves[a][c], n, self.moves[b][c], m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    open_.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to the automaton at ``red``."""
        open_ = [(red, blue)]
        while open_:
            a, b = open_.pop()
            self.ends[a] += self.ends[b]
            self.passes[a] += self.passes[b]
            self.moves[a].update(self.moves[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    open_.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_all(self) -> None:
        red = [0]
        known = {0}
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: (-self.passes[self.next[x[0]][x[1]]], x))
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in known:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                known.add(state)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in known]

    def walk(self, text: str) -> list[tuple[int, str]]:
        """The states that a string passes and the character that it takes at each, empty where it ends."""
        at, out = 0, []
        for c in text:
            out.append((at, c))
            at = self.next[at].get(c, at)
        return [*out, (at, "")]

    def recount(self, walked: dict[tuple[int, str], int]) -> None:
        """Take all counts from the walks of other strings; a move that is new stays at its state."""
        self.moves, self.ends = [Counter() for _ in self.next], [0] * len(self.next)
        for (state, c), n in walked.items():
            if c:
                self.moves[state][c] = n
                self.next[state].setdefault(c, state)
            else:
                self.ends[state] = n
        self.passes = [sum(m.values()) + e for m, e in zip(self.moves, self.ends)]

    def score(self, text: str) -> float:
        """Natural log of the string's probability; unseen moves stay where they are at a low probability."""
        return next(self.scores(text, 0, [len(text)]))[1]

    def scores(self, text: str, start: int, ends: list[int], least: float = -math.inf):
        """``(end, score of text[start:end])`` of ``ends``, ascending; stops where all that follow are below ``least``."""
        at, total, i = 0, 0.0, start
        for end in ends:
            for c in text[i:end]:
                seen = self.moves[at].get(c, 0)
                if seen and c in self.next[at]:
                    total += math.log((1 - RARE) * seen / self.passes[at])
                    at = self.next[at][c]
                else:
                    total += math.log(RARE / 100)
                if total < least:
                    return
            i = end
            yield end, total + math.log(max(RARE, self.ends[at] / max(1, self.passes[at])))


class Background:
    """Character pairs of ordinary words, smoothed; what a candidate would be if it were no credential."""

    def __init__(self, examples: Iterable[str] = (), counts: dict[tuple[str, str], int] | None = None):
        self.pairs: Counter = Counter(counts)
        for text in examples:
            self.pairs.update(zip("\n" + text, text))
        self.firsts: Counter = Counter()
        for (a, _), n in self.pairs.items():
            self.firsts[a] += n

    def score(self, text: str) -> float:
        return self.sums(text)[-1]

    def sums(self, text: str) -> list[float]:
        """Scores of the first 0, 1, 2, ... characters; however much was counted, none is rarer than RARE / 100."""
        return list(accumulate((
            math.log(max(RARE / 100, (self.pairs[a, b] + 0.01) / (self.firsts[a] + 1.0)))
            for a, b in zip("\n" + text, text)), initial=0.0))
