"""All terms of a long list that a text contains, found by their first eight bytes.

A list that is too long for dense automata (``plans/automaton.py``) takes its
own bytes and one table of bits here.  Every position of a text is looked up
by the eight bytes that start there; the few positions at which some term may
start are compared with the rest of these terms.
"""

import numpy as np

from corpusq.plans.automaton import _distinct

WIDTH = 8
#: Bits of the table that positions are looked up in first, and pairs compared at once.
TABLE_BITS, PAIRS = 22, 1 << 20


def _windows(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    held = np.frombuffer(data + bytes(WIDTH - 1), dtype=np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        held = held[:-width] | held[width:] << np.uint64(8 * width)
    return held


def _mask(width):
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(WIDTH) - np.asarray(width, dtype=np.uint64)))


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class PrefixIndex:
    """Terms (distinct, not empty) filed under their first bytes, eight at most; numbered by position."""

    def __init__(self, terms: list[bytes]):
        self.length = np.array([len(t) for t in terms], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.windows = _windows(b"".join(terms))
        self.tables = []
        widths = np.minimum(self.length, WIDTH)
        for width in np.unique(widths).tolist():
            numbers = np.flatnonzero(widths == width)
            keys = self.windows[self.start[numbers]] & _mask(width)
            order = np.argsort(keys, kind="stable")
            known, first = np.unique(keys[order], return_index=True)
            bits = np.zeros(1 << TABLE_BITS, dtype=bool)
            bits[_places(known)] = True
            self.tables.append((width, known, np.append(first, len(numbers)), numbers[order], bits))

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text position, term number) of every term that a text contains, each pair once, in order."""
        ends = np.cumsum([len(t) for t in texts])
        windows, pairs = _windows(b"".join(texts)), [np.zeros(0, dtype=np.int64)]
        for width, known, first, numbers, bits in self.tables:
            keys = windows & _mask(width)
            at = np.flatnonzero(bits[_places(keys)])
            place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            same = known[place] == keys[at]
            at, place = at[same], place[same]
            total = np.cumsum(first[place + 1] - first[place])
            low = 0
            while low < len(at):
                done = total[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
                pairs.append(self._confirmed(at[low:high], first[place[low:high]], first[place[low:high] + 1], numbers, windows, ends))
                low = high
        both = _distinct(np.concatenate(pairs))
        return both // len(self.length), both % len(self.length)

    def _confirmed(self, at, low, high, numbers, windows, ends) -> np.ndarray:
        count = high - low
        row = np.repeat(np.arange(len(at)), count)
        term = numbers[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]]
        at = at[row]
        owner = np.searchsorted(ends, at, side="right")
        inside = at + self.length[term] <= ends[owner]
        at, term, owner = at[inside], term[inside], owner[inside]
        whole = np.ones(len(at), dtype=bool)
        for offset in range(WIDTH, int(self.length[term].max(initial=0)), WIDTH):
            more = np.flatnonzero(whole & (self.length[term] > offset))
            rest = _mask(np.minimum(self.length[term[more]] - offset, WIDTH))
            whole[more] = (windows[at[more] + offset] ^ self.windows[self.start[term[more]] + offset]) & rest == 0
        return _distinct(owner[whole] * len(self.length) + term[whole])
