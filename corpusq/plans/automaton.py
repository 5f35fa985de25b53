"""All terms of a list that a text contains, found in one walk over the text.

The terms become one finite automaton: a trie whose missing edges are filled
from the state of the longest proper suffix, so that every byte is one step in
a dense table.  Bytes that occur in no term share one column of the table.  A
task walks many pieces of its texts side by side, one numpy step for a byte of
each; pieces overlap by the longest term, so no occurrence is cut.  Long lists
give several automata, each under a byte limit; every text walks through all of them.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from corpusq.plans.batches import bound_batches
from corpusq.plans.bounded import TooLarge
from corpusq.plans.shipping import Held

#: Bytes of one transition table, and how many tables a task may hold.
TABLE_BYTES, MAX_TABLES = 32 << 20, 4
#: Bytes of text walked at once, and of one piece without its overlap.
BLOCK_BYTES, PIECE_BYTES = 2 << 20, 1024


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[:len(values)]]


class Automaton:
    """Goto, fail and output arrays of a list of distinct, non-empty byte strings."""

    def __init__(self, terms: list[bytes], numbers: list[int]):
        self.longest = max(map(len, terms))
        letters = sorted(set(b"".join(terms)))
        # column 0 is any byte outside the terms: it leads back to the root, as the end of a piece does
        self.column = np.zeros(256, dtype=np.int32)
        self.column[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        children, ends = [{}], [-1]
        for term, number in zip(terms, numbers):
            at = 0
            for c in self.column[np.frombuffer(term, dtype=np.uint8)].tolist():
                at = children[at].setdefault(c, len(children))
                if at == len(children):
                    children.append({})
                    ends.append(-1)
            ends[at] = number
        self.step = np.zeros((len(children), width), dtype=np.int32)
        self.term = np.array(ends, dtype=np.int32)
        #: The nearest suffix state in which a term ends, 0 for none.
        self.shorter = np.zeros(len(children), dtype=np.int32)
        fail = np.zeros(len(children), dtype=np.int32)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            self.step[at] = self.step[fail[at]]
            self.shorter[at] = fail[at] if self.term[fail[at]] >= 0 else self.shorter[fail[at]]
            for c, child in children[at].items():
                fail[child] = self.step[at, c] if at else 0
                self.step[at, c] = child
                queue.append(child)
        #: States in which at least one term ends.
        self.hit = (self.term >= 0) | (self.shorter > 0)

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text position, term number) of every term that a text contains, each pair once, in order."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = self.column[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        count = -(-sizes // PIECE_BYTES)
        owner = np.repeat(np.arange(len(texts)), count)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * PIECE_BYTES
        start = (ends - sizes)[owner] + np.maximum(first - self.longest + 1, 0)
        stop = np.minimum((ends - sizes)[owner] + first + PIECE_BYTES, ends[owner])
        # long pieces first: a step then works on a leading run of them
        order = np.argsort(start - stop, kind="stable")
        owner, start, stop = owner[order], start[order], stop[order]
        state, table, width = np.zeros(len(owner), dtype=np.int64), self.step.ravel(), self.step.shape[1]
        length, pairs, held = stop - start, [], 0
        for at in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -at, side="left"))
            state = table[state[:live] * width + data[start[:live] + at]].astype(np.int64)
            ended = np.flatnonzero(self.hit[state])
            if len(ended):
                pairs.append(owner[ended] * len(self.term) + state[ended])
                held += len(ended)
                if held > BLOCK_BYTES:
                    pairs = [_distinct(np.concatenate(pairs))]
                    held = len(pairs[0]) // 2  # pairs that stay count half, so that they are not sorted again at once
        met = _distinct(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        out, most = [], int(self.term.max()) + 1
        text, state = met // len(self.term), met % len(self.term)
        while len(state):
            ends_here = self.term[state] >= 0
            out.append(text[ends_here] * most + self.term[state[ends_here]])
            state = self.shorter[state]
            text, state = text[state > 0], state[state > 0]
        both = _distinct(np.concatenate(out)) if out else met
        return both // most, both % most


def build(terms: list[str], table_bytes: int = TABLE_BYTES, max_tables: int = MAX_TABLES) -> list[Automaton]:
    """Automata over the terms, numbered by position; raises TooLarge if they would need more tables."""
    data = [t.encode() for t in terms]
    letters = len(set(b"".join(data))) + 1
    order = sorted(range(len(terms)), key=lambda i: data[i])
    groups, room = [], 0
    for i in order:
        need = (len(data[i]) + 1) * letters * 4
        if not groups or need > room:
            if len(groups) == max_tables:
                raise TooLarge(f"terms need more than {max_tables} tables of {table_bytes} bytes")
            groups.append([])
            room = table_bytes
        groups[-1].append(i)
        room -= need
    return [Automaton([data[i] for i in g], g) for g in groups]


def term_numbers(spark: SparkSession, column: Column, terms: list[str], table_bytes: int = TABLE_BYTES) -> Column:
    """ARRAY<INT>: positions in ``terms`` (distinct, not empty) of those that the column contains, ascending; null for null."""
    return matched_numbers(spark, column, build(terms, table_bytes) if terms else [])


def matched_numbers(spark: SparkSession, column: Column, matchers: list) -> Column:
    """As ``term_numbers``, by any objects whose ``found`` gives the (text, term) pairs of a list of texts."""
    bound_batches(spark)
    held = Held(spark, matchers)

    def walk(texts):
        automata = held.get()
        for batch in texts:
            raw = batch.cast(pa.binary()).to_pylist()
            found = []
            for low, high in _blocks(raw):
                some = [t or b"" for t in raw[low:high]]
                hits = [a.found(some) for a in automata]
                text = np.concatenate([np.zeros(0, dtype=np.int64), *[h[0] for h in hits]])
                term = np.concatenate([np.zeros(0, dtype=np.int64), *[h[1] for h in hits]])
                order = np.lexsort((term, text))
                cuts = np.searchsorted(text[order], np.arange(1, len(some)))
                found.extend(np.split(term[order], cuts))
            yield pa.array([None if t is None else f for t, f in zip(raw, found)], pa.list_(pa.int32()))

    def numbers(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return walk(texts)
    return F.arrow_udf(numbers, "array<int>")(column)


def _blocks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most BLOCK_BYTES, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        here = len(text) if text else 0
        if size and size + here > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += here
    if start < len(texts):
        yield start, len(texts)
