"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics are computed where the texts lie.  Trees are fitted on a bounded
sample of labelled rows (SAMPLE_ROWS rows of FEATURES numbers) by histograms of
BINS quantile bins, and flattened into complete-tree arrays, so scoring walks
all rows of a batch one level at a time in numpy.

Nulls: a null text has the statistics of an empty one.  Ids without a label, or
with two different ones, are not learned from; without both labels in the
sample every score is the share of label 1 (0.5 without labels).  Repeated rows
are scored one by one.  An empty table gives an empty result.  Other columns
are kept; columns named like a result are replaced.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusq.llm.arrow import extend, text_bytes
from corpusq.llm.labelled import clean_labels, thin
from corpusq.plans.shipping import Held

#: Labelled rows that the trees are fitted on, at most (in expectation).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
LEAST_HESSIAN, RIDGE = 2.0, 1.0

FEATURES = (
    "log_chars", "log_words", "mean_word", "upper", "lower", "digit", "space", "line_ends", "pipe", "bang", "symbol", "stop",
    "other_ascii", "non_ascii", "distinct_words", "top_word", "repeated_pairs", "same_next", "capital_words", "symbol_words",
    "short_words", "long_words", "log_lines", "repeated_lines", "words_per_stop")

_CLASS = np.zeros(256, dtype=np.int64)
for _byte in range(256):
    _char = chr(_byte)
    _CLASS[_byte] = (
        9 if _byte >= 128 else 0 if _char.isupper() else 1 if _char.islower() else 2 if _char.isdigit() else
        4 if _char == "\n" else 3 if _char.isspace() else 5 if _char == "|" else 6 if _char == "!" else
        7 if _char in "#$%&*@^~<>{}[]\\=+_" else 8 if _char in ".,;:?" else 10)
_SYMBOL_ENDS = tuple(c.encode() for c in "#$%&*@^~<>{}[]\\=+_")


def statistics(data: bytes | None) -> list[float]:
    """FEATURES of one whole text."""
    data = data or b""
    n = len(data)
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=11) if n else np.zeros(11)
    share = kinds / max(n, 1)
    words = data.split()
    w = max(len(words), 1)
    counted = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct_lines = len(set(lines))
    return [
        np.log1p(n), np.log1p(len(words)), lengths.sum() / w, share[0], share[1], share[2], share[3], share[4], share[5], share[6],
        share[7], share[8], share[10], share[9], len(counted) / w, counted.most_common(1)[0][1] / w if words else 0.0,
        1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / w, sum(map(bytes.isupper, words)) / w,
        sum(x.endswith(_SYMBOL_ENDS) for x in words) / w, float((lengths <= 2).sum()) / w, float((lengths >= 12).sum()) / w,
        np.log1p(len(lines)), 1 - distinct_lines / max(len(lines), 1) if lines else 0.0, len(words) / (kinds[8] + 1)]


class Model(NamedTuple):
    """Complete trees in level order: split feature and threshold per inner node, value per leaf."""
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees on log loss; a node without a worthwhile split sends every row left."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        none = np.zeros((0, inner))
        return Model(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.zeros((0, leaves)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = bins + np.arange(width) * BINS
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        cut = np.full(inner, BINS)
        at = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, nodes = 2 ** level - 1, 2 ** level
            cell = ((at - first)[:, None] * width * BINS + flat).ravel()
            size = nodes * width * BINS
            left_g = np.bincount(cell, np.repeat(g, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
            left_h = np.bincount(cell, np.repeat(h, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
            gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), BINS)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + node], threshold[first + node], cut[first + node] = f, edges[f][b], b
            at = 2 * at + 1 + (bins[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Model(base, np.stack(features), np.stack(thresholds), np.stack(values))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Documents with their statistics; the text is dropped."""
    def factory():
        at = None

        def compute(batch):
            nonlocal at
            at = batch.schema.get_field_index("text") if at is None else at
            return [pa.array([statistics(t) for t in text_bytes(batch.column(at))], pa.list_(pa.float32()))]
        return compute
    return extend(docs, "statistics array<float>", factory).drop("text")


def fit_quality(stats: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trees from the labelled rows where ``learn`` holds, thinned by the hash of the id to ``sample_rows``."""
    rows = stats.filter(learn).select("doc_id", "statistics").join(clean_labels(labels, "quality"), "doc_id")
    n = rows.count()
    taken = thin(rows, sample_rows / max(n, 1), "quality").select("doc_id", "statistics", "label").collect()
    taken.sort(key=lambda r: r["doc_id"])
    x = np.array([r["statistics"] for r in taken], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in taken], dtype=np.float64))


def score_quality(stats: DataFrame, model: Model) -> DataFrame:
    """Rows with ``score``: the probability of label 1."""
    held = Held(stats.sparkSession, tuple(model))

    def factory():
        made = Model(*held.get())

        def compute(batch):
            values = batch.column(batch.schema.get_field_index("statistics"))
            x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            return [pa.array(made.score(x), pa.float64())]
        return compute
    return extend(stats, "score double", factory)
