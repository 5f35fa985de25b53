"""Fill-in-middle transformation with a piecewise-linear learned rank index.

A text is cut at token boundaries.  Instead of keeping the byte offset of every
boundary, a task fits line segments from boundary rank to offset: a segment
grows while one slope keeps every boundary within ERROR bytes of its line (a
shrinking cone of slopes), and each boundary leaves one byte, the distance to
its prediction.  A cut at rank r is predicted by the segment that holds r and
corrected by the stored residual, so it is exact.  Boundaries are found and
fitted block by block: a very long text costs its bytes, one byte per boundary
and its segments.

The cuts and the form of a document depend on its id alone (and on n), so the
result does not depend on partitions, batches or reruns.

Nulls: a null text counts as empty, an empty text is plain with n = 0; a null id
draws as the word "null".  Rows with one id draw the same numbers.  Texts that
hold a marker are plain whole.  An empty table gives an empty result.  Other
columns are kept; columns named like a result are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusq.llm.arrow import extend, pieces, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 documents so many stay plain, and of 100 others so many put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Largest distance in bytes between a boundary and its segment's line; a residual fits one signed byte.
ERROR = 120
#: Bytes whose boundaries are held at once; a segment never crosses a block.
BLOCK_BYTES = 2 << 20
#: Boundaries tried at first when a segment grows; doubled while all of them fit.
STEP = 512

RESULT = "n bigint, form string, cut_ranks array<bigint>, output string, prefix_chars bigint, middle_chars bigint"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[np.r_[65:91, 97:123]] = True


class RankIndex:
    """Offsets of ascending boundaries by rank, as line segments and one-byte residuals."""

    def __init__(self, error: int = ERROR):
        self.error, self.count = error, 0
        self._first, self._origin, self._slope, self._residuals = [], [], [], []

    def extend(self, offsets: np.ndarray) -> None:
        """Append boundaries; offsets ascend strictly and lie above all earlier ones."""
        at, n = 0, len(offsets)
        while at < n:
            stop, slope = self._grow(offsets, at)
            self._first.append(self.count + at)
            self._origin.append(int(offsets[at]))
            self._slope.append(slope)
            line = offsets[at] + np.rint(slope * np.arange(stop - at)).astype(np.int64)
            self._residuals.append((offsets[at:stop] - line).astype(np.int8))
            at = stop
        self.count += n

    def _grow(self, offsets: np.ndarray, at: int) -> tuple[int, float]:
        """End of the longest run from ``at`` that one slope fits, and the slope."""
        low, high, stop, step = 0.0, np.inf, at + 1, STEP
        while stop < len(offsets):
            run = np.arange(stop, min(stop + step, len(offsets)))
            rise, width = offsets[run] - offsets[at], run - at
            lows = np.maximum.accumulate(np.maximum((rise - self.error) / width, low))
            highs = np.minimum.accumulate(np.minimum((rise + self.error) / width, high))
            crossed = np.flatnonzero(lows > highs)
            fits = int(crossed[0]) if len(crossed) else len(run)
            if fits:
                low, high = float(lows[fits - 1]), float(highs[fits - 1])
            stop += fits
            if len(crossed):
                break
            step *= 2
        return stop, (low + high) / 2 if np.isfinite(high) else 0.0

    def freeze(self) -> "RankIndex":
        self.first = np.array(self._first, dtype=np.int64)
        self.origin = np.array(self._origin, dtype=np.int64)
        self.slope = np.array(self._slope)
        self.residuals = np.concatenate(self._residuals) if self._residuals else np.zeros(0, dtype=np.int8)
        return self

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries with these ranks."""
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        predicted = self.origin[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)
        return predicted + self.residuals[ranks]


def boundary_blocks(data: np.ndarray, starts: np.ndarray, block: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(end of block, offsets of token starts in it) over the UTF-8 bytes of texts that begin at ``starts``.

    A token is a run of ASCII letters or one other code point; a text begins a token.
    """
    for low in range(0, len(data), block):
        high = min(low + block, len(data))
        part = data[low:high]
        letter = _LETTER[part]
        begins = (part & 0xC0) != 0x80
        begins[1:] &= ~(letter[1:] & letter[:-1])
        if low and letter[0] and _LETTER[data[low - 1]]:
            begins[0] = False
        inside = starts[np.searchsorted(starts, low):np.searchsorted(starts, high)]
        begins[inside - low] = True
        yield high, np.flatnonzero(begins) + low


def index_texts(texts: list[bytes], error: int = ERROR, block: int = BLOCK_BYTES) -> tuple[RankIndex, np.ndarray, np.ndarray]:
    """(index over all boundaries of the texts in a row, first rank of each text and one more, byte start of each and one more)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    index, ranks, done = RankIndex(error), np.zeros(len(starts), dtype=np.int64), 0
    for high, offsets in boundary_blocks(data, starts[:-1], block):
        upto = int(np.searchsorted(starts, high))
        ranks[done:upto] = index.count + np.searchsorted(offsets, starts[done:upto])
        index.extend(offsets)
        done = upto
    ranks[done:] = index.count
    index.extend(starts[-1:])
    return index.freeze(), ranks, starts


def draws(seed: str = SEED, key: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
                   error: int = ERROR) -> DataFrame:
    """Documents with n, form (plain, psm, spm), cut_ranks, output, prefix_chars and middle_chars; a narrow stage.

    The two cuts are the boundaries of rank h1 mod (n + 1) and h2 mod (n + 1), in
    order.  A document is plain if its text is empty or holds a marker, or if
    h3 mod 100 lies in the last ``plain_percent``; of the others those with h4
    mod 100 below ``spm_percent`` put the suffix first.  plain rows have no cuts.
    """
    drawn = docs.withColumn("_fim_draws", F.array(*draws(seed)))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    first, second, third = marks

    def factory():
        def compute(batch):
            texts = [t or b"" for t in text_bytes(batch.column(batch.schema.get_field_index("text")))]
            column = batch.column(batch.schema.get_field_index("_fim_draws"))
            h = column.flatten().to_numpy().reshape(-1, 4)
            n, form, ranks, output, prefix, middle = [], [], [], [], [], []
            for low, high in pieces(texts):
                some = texts[low:high]
                index, firsts, starts = index_texts(some, error)
                size = firsts[1:] - firsts[:-1]
                cuts = np.sort(h[low:high, :2] % (size + 1)[:, None], axis=1)
                places = index.offset((cuts + firsts[:-1, None]).ravel()).reshape(-1, 2) - starts[:-1, None]
                for text, tokens, cut, (a, b), (plain, order) in zip(
                        some, size.tolist(), cuts.tolist(), places.tolist(), (h[low:high, 2:] % 100).tolist()):
                    n.append(tokens)
                    if not text or plain >= 100 - plain_percent or any(m in text for m in marks):
                        form.append("plain")
                        ranks.append(None)
                        output.append(text)
                        prefix.append(None)
                        middle.append(None)
                        continue
                    before, inner, after = text[:a], text[a:b], text[b:]
                    spm = order < spm_percent
                    form.append("spm" if spm else "psm")
                    ranks.append(cut)
                    output.append(b"".join([second, after, first, before, third, inner] if spm
                                           else [first, before, second, after, third, inner]))
                    prefix.append(len(before.decode()))
                    middle.append(len(inner.decode()))
            return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(ranks, pa.list_(pa.int64())),
                    pa.array(output, pa.binary()).cast(pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
        return compute
    return extend(drawn, RESULT, factory).drop("_fim_draws")


def restore(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made from, read back from its markers."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)

    def at(i):
        return F.get(part, F.lit(i))
    return (F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1)))
            .otherwise(output))
