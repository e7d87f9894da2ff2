"""A bidirectional FM-index over delimited words, searched for many words at a time.

The words stand in one ring of letters, each after a delimiter. A pattern is an interval of the
sorted rotations of the ring and, at the same time, one of those of the reversed ring; from the
numbers of smaller letters before a place both follow when the pattern gets a letter more, on
its left by the first ring and on its right by the second."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DELIMITER = 0


def rotations(ring: np.ndarray) -> np.ndarray:
    """The places of a ring of small numbers in the order of the rotations that begin there."""
    bits = max(1, int(ring.max()).bit_length())
    held = max(1, 62 // bits)  # as many letters as fit into one number, then twice as many each time
    rank, size = np.zeros(len(ring), np.int64), held
    for i in range(held):
        rank = (rank << bits) | np.roll(ring, -i)
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
        if new[-1] == len(ring) - 1 or size >= len(ring):
            return order
        rank = np.empty(len(ring), np.int64)
        rank[order] = new
        rank = rank * len(ring) + np.roll(rank, -size)
        size *= 2


class Ring:
    """The letters before the sorted rotations of a ring, as counts."""

    def __init__(self, ring: np.ndarray, letters: int) -> None:
        self.order = rotations(ring)
        before = ring[self.order - 1]
        #: [i, c]: among the first i rotations, those before which stands a letter less than c.
        self.smaller = np.zeros((len(ring) + 1, letters + 1), np.int32)
        self.smaller[np.arange(1, len(ring) + 1), before + 1] = 1
        np.cumsum(self.smaller, axis=0, out=self.smaller)
        np.cumsum(self.smaller, axis=1, out=self.smaller)
        self.begins = self.smaller[-1, :-1].copy()  # where the rotations that begin with a letter begin

    def extended(self, near: np.ndarray, far: np.ndarray, size: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, ...]:
        """The intervals with ``letter`` before them: ``near`` in this ring, ``far`` in the other."""
        less, more = self.smaller[near, letter], self.smaller[near + size, letter]
        first = self.smaller[near, letter + 1] - less
        last = self.smaller[near + size, letter + 1] - more
        return self.begins[letter] + first, far + more - less, last - first

    def choices(self, near: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How often each letter stands before the rotations of each interval."""
        return np.diff(self.smaller[near + size] - self.smaller[near], axis=1)


@dataclass
class States:
    """Patterns in the making: the query, letters of it that are spent, errors, and the intervals."""

    query: np.ndarray
    spent: np.ndarray
    errors: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    def take(self, which: np.ndarray, **changed: np.ndarray) -> States:
        return States(**{name: changed.get(name, value[which]) for name, value in vars(self).items()})

    @staticmethod
    def together(parts: list[States]) -> States:
        return States(*[np.concatenate(values) for values in zip(*(vars(p).values() for p in parts), strict=True)])

    def __len__(self) -> int:
        return len(self.query)


class WordIndex:
    """The index of some distinct words."""

    def __init__(self, words: list[str]) -> None:
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ring = np.insert(codes, at, DELIMITER)
        self.codes = np.unique(ring)
        ring = np.searchsorted(self.codes, ring)
        self.left = Ring(ring, len(self.codes))
        self.right = Ring(ring[::-1].copy(), len(self.codes))
        self.starts = at + np.arange(len(words))

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters of other words, where each word begins, and lengths; -1 is a letter that is
        not in the index."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1), np.cumsum(lengths) - lengths, lengths

    def one_error(self, words: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a query, number of a word of the index): those whose first half, or whose
        second half, is that of the query and whose other half takes exactly one insertion,
        deletion or replacement.

        The half is matched from its inner end to its outer end and closed with the delimiter. The
        pattern then grows at the inner end, across the other half, with at most one error."""
        letters, begin, length = self.letters(words)
        half = length // 2
        if first_half:
            outer, inner, same, step = self.left, self.right, half, 1
        else:
            outer, inner, same, step = self.right, self.left, length - half, -1
        # Letter i of a query, counted from the end where the half that is to match begins.
        origin = begin if first_half else begin + length - 1

        def letter(query: np.ndarray, i: np.ndarray) -> np.ndarray:
            return letters[origin[query] + step * i]

        n = len(words)
        every = np.arange(n)
        zeros = np.zeros(n, np.int64)
        states = States(every, zeros, zeros, zeros, zeros, np.full(n, len(self.left.order)))

        def grown(states: States, ring: Ring, letter: np.ndarray, **changed: np.ndarray) -> States:
            known = letter >= 0
            states = states.take(known, **{k: v[known] for k, v in changed.items()})
            if ring is outer:
                near, far, size = ring.extended(states.near, states.far, states.size, letter[known])
            else:
                far, near, size = ring.extended(states.far, states.near, states.size, letter[known])
            alive = size > 0
            return states.take(alive, near=near[alive], far=far[alive], size=size[alive])

        for i in range(int(same.max(initial=0))):
            going = i < same[states.query]
            rest, ready = states.take(going), states.take(~going)
            at = same[rest.query] - 1 - i
            states = States.together([ready, grown(rest, outer, letter(rest.query, at))])
        states = grown(states, outer, np.full(len(states), DELIMITER))
        states.spent = same[states.query]
        found = []
        while len(states):
            ended = states.spent == length[states.query]
            wrong = states.errors == 1
            found.append(grown(states.take(ended & wrong), inner, np.full((ended & wrong).sum(), DELIMITER)))
            late = states.take(wrong & ~ended)
            right, open_ = states.take(~wrong), ~ended[~wrong]
            following = [grown(late, inner, letter(late.query, late.spent), spent=late.spent + 1)]
            lost = right.take(open_)
            following.append(lost.take(slice(None), spent=lost.spent + 1, errors=lost.errors + 1))
            wanted = np.full(len(right), -1)
            wanted[open_] = letter(right.query[open_], right.spent[open_])
            which, other = np.nonzero(inner.choices(right.far, right.size)[:, 1:])
            other += 1
            equal = other == wanted[which]
            step_on, err = right.spent[which] + 1, right.errors[which] + 1
            for kept, spent, errors in (
                (equal, step_on, err - 1),  # the same letter
                (~equal & open_[which], step_on, err),  # another one in its place
                (~equal, step_on - 1, err),  # one more
            ):
                following.append(
                    grown(right.take(which[kept]), inner, other[kept], spent=spent[kept], errors=errors[kept])
                )
            states = States.together(following)
        whole = States.together(found) if found else states
        ring_order = self.left.order[whole.near if first_half else whole.far]
        words_found = np.searchsorted(self.starts, ring_order)
        pairs = np.unique(whole.query * max(1, len(self.starts)) + words_found)
        return pairs // max(1, len(self.starts)), pairs % max(1, len(self.starts))
