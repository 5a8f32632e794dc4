"""Suffix automata over sequences of words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class Automaton:
    """The suffix automaton of several sequences, with the number of places each factor ends at.

    State 0 is the empty factor. A state stands for the factors that end at the same places;
    ``length`` is that of the longest, ``link`` the state of the longest one that is shorter than
    all of them and ends at more places.
    """

    def __init__(self, sequences: Iterable[Sequence[int]] = ()):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        for sequence in sequences:
            state = 0
            for word in sequence:
                state = self._append(state, word)
                self.places[state] += 1
        # a factor also ends where any longer one ends that it is the end of
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]] += self.places[state]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.places.append(0)
        return len(self.length) - 1

    def _split(self, above: int, word: int, state: int) -> int:
        """A state of its own for the factors of ``state`` that continue ``above`` and shorter ones."""
        short = self._state(self.length[above] + 1, self.link[state], dict(self.step[state]))
        self.link[state] = short
        while above >= 0 and self.step[above].get(word) == state:
            self.step[above][word] = short
            above = self.link[above]
        return short

    def _append(self, last: int, word: int) -> int:
        """The state of the sequence read so far, one word longer."""
        there = self.step[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state(self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in self.step[above]:
            self.step[above][word] = new
            above = self.link[above]
        if above >= 0:
            there = self.step[above][word]
            whole = self.length[there] == self.length[above] + 1
            self.link[new] = there if whole else self._split(above, word, there)
        return new

    def repeated_ends(self, sequence: Sequence[int], least: int, times: int = 2) -> list[int]:
        """Places in ``sequence`` after which a factor of ``least`` words ends that the automaton
        holds at ``times`` places or more.

        The sequence is streamed for matching statistics: the state and length of the longest
        factor that ends at each place, cut down to ``least`` words.
        """
        step, link, length, places = self.step, self.link, self.length, self.places
        state, matched, ends = 0, 0, []
        for i, word in enumerate(sequence):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word not in step[state]:
                state = matched = 0
                continue
            state = step[state][word]
            matched += 1
            if matched < least:
                continue
            while length[link[state]] >= least:
                state = link[state]
            matched = min(matched, length[state])
            if places[state] >= times:
                ends.append(i + 1)
        return ends
