"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are labelled from document labels: a token of a toxic document is toxic
when its word or the stem of its word (STEMS first letters) stands significantly
more often in toxic documents, in varied neighbourhoods (CONTEXTS different
ones, so that copies of one document count once).  The field has
two states; a token's score sums weights of the word, of its class and of its
neighbours' classes, and a 2 x 2 matrix scores transitions.  Forward-backward
gives the probability of every token; runs above one half are the offending
spans, and a logistic curve over their summed evidence, its largest term and its
density, fitted on the labelled documents, gives the document score.

Fitting takes a bounded sample of labelled rows: SAMPLE_TOXIC and SAMPLE_CLEAN
documents and SAMPLE_BYTES of text of each kind, all in expectation.

Nulls: a null or empty text has no tokens and takes the score of no toxic token.
Ids without a label, or with two different ones, are not learned from; without
toxic labels every score is near 0.  Repeated rows are scored one by one.  An
empty table gives an empty result.  Other columns are kept; columns named like
a result are replaced.
"""

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusq.llm.arrow import extend, pieces, text_bytes
from corpusq.llm.decontam import WORD_BYTES
from corpusq.llm.labelled import clean_labels, thin
from corpusq.plans.shipping import Held

#: Bounds of the sample that the field is fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 700, 1000, 3 << 20
CONTEXTS, LEAST_ODDS, LEAST_GAIN, MOST_PER_TEXT = 4, 2.0, 24.0, 5
STEMS = (4, 5, 6, 7, 8)
STEPS, STEP = 40, 0.9
CLASSES = 6  # of a word: unknown or beyond the text, unremarkable, then by log odds of its word or stem
_EDGES = np.array([2.5, 3.5, 4.5])
#: Words that a task remembers.
REMEMBERED = 200_000
_TOKEN = re.compile(rb"[^ ]+")


class Field(NamedTuple):
    words: dict           # word, or stem and a star, to number; other words are 0
    weight: np.ndarray    # per word number
    kind: np.ndarray      # class per word number
    classes: np.ndarray   # (3, CLASSES): weights of the own, previous and next class
    bias: float
    start: float
    moves: np.ndarray     # (2, 2) transition scores
    curve: np.ndarray     # document score, over the columns of _summary


def tokens(data: bytes | None) -> list[bytes]:
    return data.translate(WORD_BYTES).split() if data else []


class Numbers(dict):
    """Number of each word: its own, else that of its shortest known stem, else 0."""

    def __init__(self, words: dict):
        super().__init__()
        self.words = words

    def __missing__(self, word):
        made = self.words.get(word)
        if made is None:
            letters = word.decode("utf-8", "replace")
            made = next((n for k in STEMS if len(letters) >= k and (n := self.words.get(stem(letters, k))) is not None), 0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = made
        return made


def stem(letters: str, size: int) -> bytes:
    return letters[:size].encode() + b"*"


def numbered(texts: list, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts; tokens per text)."""
    flat, counts = [], []
    for data in texts:
        found = tokens(data)
        counts.append(len(found))
        flat.extend(map(numbers.__getitem__, found))
    return np.array(flat, dtype=np.int64), np.array(counts, dtype=np.int64)


def _borders(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is first, is last) token of its text."""
    n = int(counts.sum())
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    ends = np.cumsum(counts)[counts > 0]
    first[(ends - counts[counts > 0])] = True
    last[ends - 1] = True
    return first, last


def _around(kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the previous and next token, 0 beyond the text."""
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first], after[last] = 0, 0
    return before, after


def forward_backward(score: np.ndarray, start: float, moves: np.ndarray, first: np.ndarray, last: np.ndarray,
                     exact: float = 1e-8):
    """(toxic marginals, forward ratios, backward ratios times emission of the next token).

    Both recursions map one positive ratio to the next by a contraction, so
    sweeping all positions of all texts at once until nothing moves gives their
    solution; a chain of n tokens needs at most n sweeps, in practice a few.
    """
    emit, m = np.exp(np.clip(score, -30, 30)), np.exp(moves)

    def settle(step, value):
        for _ in range(len(emit) + 1):
            made = step(value)
            moved = np.abs(made - value)
            moved -= exact * made
            value = made
            if not len(moved) or moved.max() <= 0:
                break
        return value

    opening = emit * np.exp(start)

    def forward(ratio):
        was = np.empty_like(ratio)
        was[1:] = ratio[:-1]
        was[:1] = 0
        made = emit * (m[0, 1] + m[1, 1] * was) / (m[0, 0] + m[1, 0] * was)
        made[first] = opening[first]
        return made

    def onward_of(back):
        onward = np.empty_like(back)
        np.multiply(emit[1:], back[1:], out=onward[:-1])
        onward[-1:] = 0
        return onward

    def backward(back):
        onward = onward_of(back)
        made = (m[1, 0] + m[1, 1] * onward) / (m[0, 0] + m[0, 1] * onward)
        made[last] = 1.0
        return made
    ratio = settle(forward, emit * (m[0, 1] / m[0, 0]))
    back = settle(backward, np.ones(len(emit)))
    odds = ratio * back
    return odds / (1 + odds), ratio, onward_of(back)


def _emission(field: Field, ids, before, after):
    kind = field.kind[ids]
    return field.bias + field.weight[ids] + field.classes[0, kind] + field.classes[1, before] + field.classes[2, after]


def _summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1; evidence, the summed -log(1 - marginal); its largest term; evidence per hundred tokens; log of tokens."""
    out = np.zeros((len(counts), 5))
    out[:, 0] = 1
    out[:, 4] = np.log1p(counts) / 10
    some = counts > 0
    if some.any():
        at = (np.cumsum(counts) - counts)[some]
        evidence = -np.log1p(-np.minimum(p, 0.9999))
        total = np.add.reduceat(evidence, at)
        out[some, 1] = np.minimum(total, 20)
        out[some, 2] = np.maximum.reduceat(evidence, at)
        out[some, 3] = np.minimum(total * 100 / (counts[some] + 100), 20)
    return out


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    c = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge @ c
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        c -= np.clip(step, -4, 4)
        c[1:4] = np.maximum(c[1:4], 0)  # more evidence never lowers the score
    return c


def _marked(spelled: dict, spelling, doc, first, last, labels) -> dict:
    """Log odds of the words and stems (with a star) that mark toxic documents."""
    listed = list(spelled)
    forms, of_form = {}, []
    for n, w in enumerate(listed):
        letters = w.decode("utf-8", "replace")
        for form in [w, *[stem(letters, k) for k in STEMS if len(letters) >= k]]:
            of_form.append((n, forms.setdefault(form, len(forms))))
    if not of_form or not (labels > 0).any() or not (labels == 0).any():
        return {}
    pairs = np.array(of_form, dtype=np.int64)
    # occurrences per (text, form), at most MOST_PER_TEXT
    by_word, many = np.unique(doc * len(listed) + spelling, return_counts=True)
    word, text = by_word % len(listed), by_word // len(listed)
    start, n_forms = np.searchsorted(pairs[:, 0], word), np.bincount(pairs[:, 0], minlength=len(listed))[word]
    flat = np.repeat(start, n_forms) + np.arange(n_forms.sum()) - np.repeat(np.cumsum(n_forms) - n_forms, n_forms)
    key, at = np.unique(np.repeat(text, n_forms) * len(forms) + pairs[flat, 1], return_inverse=True)
    seen = np.minimum(np.bincount(at, np.repeat(many, n_forms)), MOST_PER_TEXT)
    form, text = key % len(forms), key // len(forms)
    toxic = labels[text] > 0
    a = np.bincount(form[toxic], seen[toxic], len(forms))
    b = np.bincount(form[~toxic], seen[~toxic], len(forms))
    n_toxic, n_clean = float((labels > 0).sum()), float((labels == 0).sum())
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean)
    rate = np.clip(a / np.maximum(a + b, 1e-9), 1e-9, 1 - 1e-9)
    gain = 2 * (a * np.log(rate / share) + b * np.log((1 - rate) / (1 - share)))
    likely = np.flatnonzero((odds >= LEAST_ODDS) & (gain >= LEAST_GAIN))
    # different neighbours on either side, over the tokens of toxic documents
    named, found = list(forms), {}
    before, after = _around(spelling + 1, first, last)
    place = np.flatnonzero(labels[doc] > 0)
    for f in likely.tolist():
        mine = place[np.isin(spelling[place], pairs[pairs[:, 1] == f, 0])]
        texts = len(np.unique(doc[mine]))
        if min(len(np.unique(before[mine])), len(np.unique(after[mine]))) >= max(CONTEXTS, texts // 2):
            found[named[f]] = float(odds[f])
    # the shortest stem speaks for the longer ones and the words it covers, unless they say clearly more
    kept = {}
    for form in sorted(found, key=lambda w: (not w.endswith(b"*"), len(w), w)):
        letters = form.rstrip(b"*").decode("utf-8", "replace")
        over = next((kept[stem(letters, k)] for k in STEMS if k <= len(letters) and stem(letters, k) in kept and stem(letters, k) != form), None)
        if over is None:
            kept[form] = found[form]
    return kept


def fit_field(texts: list, labels: np.ndarray, weight: np.ndarray) -> Field:
    """Field from whole texts with document labels; ``weight`` is how many labelled documents one stands for."""
    seen, kept = set(), []
    for i, text in enumerate(texts):  # copies teach once
        if (key := bytes(text or b"")) not in seen:
            seen.add(key)
            kept.append(i)
    texts, labels, weight = [texts[i] for i in kept], labels[kept], weight[kept]
    lists = [tokens(t) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    spelled = {w: n for n, w in enumerate(sorted({w for found in lists for w in found}))}
    spelling = np.array([n for found in lists for n in map(spelled.__getitem__, found)], dtype=np.int64)
    del lists
    doc = np.repeat(np.arange(len(texts)), counts)
    first, last = _borders(counts)
    marked = _marked(spelled, spelling, doc, first, last, labels)
    # a marked word or stem is a word of the field; so is every other word, as far as it repeats
    often = np.bincount(np.unique(doc * len(spelled) + spelling) % max(len(spelled), 1), minlength=len(spelled)) if len(spelling) else np.zeros(0)
    words = {w: n for n, w in enumerate(marked, 1)}
    for w, n in spelled.items():
        if often[n] >= 3 and Numbers(words)[w] == 0:
            words[w] = len(words) + 1
    size = len(words) + 1
    numbers = Numbers(words)
    number_of = np.array([numbers[w] for w in spelled], dtype=np.int64)
    ids = number_of[spelling] if len(spelling) else spelling
    kind = np.ones(size, dtype=np.int64)
    kind[0] = 0
    for w, odds in marked.items():
        kind[words[w]] = 2 + int(np.searchsorted(_EDGES, odds))
    y = ((kind[ids] >= 2) & (labels[doc] > 0)).astype(float)
    near_before, near_after = _around(kind[ids], first, last)

    bias, start = np.array([-4.0]), np.zeros(1)
    weights, classes, moves = np.zeros(size), np.zeros((3, CLASSES)), np.zeros((2, 2))
    params = [bias, start, weights, classes, moves]
    squares = [np.full_like(p, 1e-8) for p in params]
    own = kind[ids]
    follow = ~last
    shown = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            shown[i, j] = ((y[:-1] == i) & (y[1:] == j) & follow[:-1]).sum() if len(y) > 1 else 0
    for _ in range(STEPS if len(ids) else 0):
        field = Field(words, weights, kind, classes, float(bias[0]), float(start[0]), moves, np.zeros(5))
        score = _emission(field, ids, near_before, near_after)
        p, ratio, onward = forward_backward(score, float(start[0]), moves, first, last, 1e-4)
        wrong = p - y
        m = np.exp(moves)
        joint = np.stack([np.full(len(p), m[0, 0]), m[0, 1] * onward, ratio * m[1, 0], ratio * m[1, 1] * onward])
        joint = (joint / joint.sum(axis=0))[:, follow].sum(axis=1).reshape(2, 2)
        n = max(len(ids), 1) ** 0.5
        gradients = [
            np.array([wrong.sum()]) / n, np.array([wrong[first].sum()]) / n,
            np.bincount(ids, wrong, size) + 0.05 * weights,
            np.stack([np.bincount(k, wrong, CLASSES) for k in (own, near_before, near_after)]) / n + 1e-3 * classes,
            (joint - shown) / n + 1e-3 * moves]
        gradients[2][0] = 0
        for param, square, gradient in zip(params, squares, gradients):
            square += gradient ** 2
            param -= STEP * gradient / np.sqrt(square)
        moves -= moves[0, 0]  # only differences count
        np.clip(moves, -3, 3, out=moves)
    field = Field(words, weights, kind, classes, float(bias[0]), float(start[0]), moves, np.zeros(5))
    p, _, _ = forward_backward(_emission(field, ids, near_before, near_after), field.start, moves, first, last)
    x = _summary(p, counts)
    curve = _curve(x, (labels > 0).astype(float), weight) if len(texts) else np.array([-5.0, 0, 0, 0, 0])
    # words that say what every unremarkable word says need not travel
    useful = {w: n for w, n in words.items() if kind[n] >= 2 or abs(weights[n]) > 1e-3}
    keep = np.array([0, *useful.values()], dtype=np.int64)
    return Field({w: i for i, w in enumerate(useful, 1)}, weights[keep], kind[keep], classes, field.bias, field.start, moves, curve)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> Field:
    """Field from a bounded sample of the labelled documents where ``learn`` holds."""
    sizes = docs.filter(learn).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    rows = sizes.join(clean_labels(labels, "toxic"), "doc_id")
    totals = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    parts, share = [], {}
    for label, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)):
        if label in totals:
            share[label] = min(1.0, most / totals[label]["n"], SAMPLE_BYTES / max(totals[label]["bytes"], 1))
            parts.append(thin(rows.filter(F.col("label") == label), share[label], "toxicity").select("doc_id", "label").distinct())
    taken = []
    if parts:
        # the ids of the sample are bounded by it, so texts are picked where they lie; an id that repeats gives one text
        wanted = F.broadcast(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        taken = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id")
                 .groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect())
    taken.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in taken], dtype=np.int64)
    return fit_field([(r["text"] or "").encode() for r in taken], y, np.array([1 / share[v] for v in y.tolist()], dtype=np.float64))


def _code_points(data: bytes, spans: list) -> list:
    """Ascending byte spans as code point spans, in one run over the text."""
    out, at, seen = [], 0, 0
    for start, end in spans:
        first = seen + len(data[at:start].decode("utf-8", "replace"))
        seen = first + len(data[start:end].decode("utf-8", "replace"))
        at = end
        out.append({"start": first, "end": seen})
    return out


def _toxic_spans(data: bytes, p: np.ndarray) -> list:
    """Runs of tokens above one half as code point spans, end exclusive."""
    places = [m.span() for m in _TOKEN.finditer(data.translate(WORD_BYTES))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (p > 0.5).astype(np.int8), [0]])))
    return _code_points(data, [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])])


def score_toxicity(docs: DataFrame, field: Field) -> DataFrame:
    """Documents with ``score`` (probability of label 1) and ``toxic_spans`` (code points)."""
    held = Held(docs.sparkSession, tuple(field))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def factory():
        made = Field(*held.get())
        numbers = Numbers(made.words)

        def compute(batch):
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            scores, spans = [], []
            for low, high in pieces(texts):
                ids, counts = numbered(texts[low:high], numbers)
                first, last = _borders(counts)
                before, after = _around(made.kind[ids], first, last)
                p, _, _ = forward_backward(_emission(made, ids, before, after), made.start, made.moves, first, last)
                scores += (1 / (1 + np.exp(-np.clip(_summary(p, counts) @ made.curve, -30, 30)))).tolist()
                ends = np.cumsum(counts)
                hot = np.concatenate([[0], np.cumsum(p > 0.5)])
                for i, (end, n) in enumerate(zip(ends, counts)):
                    spans.append(_toxic_spans(texts[low + i], p[end - n:end]) if hot[end] > hot[end - n] else [])
            return [pa.array(scores, pa.float64()), pa.array(spans, span)]
        return compute
    return extend(docs, "score double, toxic_spans array<struct<start: bigint, end: bigint>>", factory)
