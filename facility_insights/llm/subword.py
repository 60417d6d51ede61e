"""Subword-bag classifier: hashed character n-gram vectors, averaged into a linear softmax.

The model is the one of bag-of-subwords text classification: a word is the mean of the vectors
of its character n-grams, a text the mean of its words, and a linear softmax over that mean
gives the classes. Vectors and softmax are trained together by Adagrad in numpy on a bounded
sample. A misspelt word shares most of its n-grams with the word it was made from, so it gets a
vector close to it although it never occurred in training.

After training the softmax is folded into the vectors: mean and softmax input are linear, so a run
of words has as logit the mean over its words of the mean over their n-grams of one number per bucket.
Scoring thus needs one float table of fixed size.

Unlike the plain model, a text is not scored by the mean over all its words, in which a few words of
a long text drown: it is learnt from runs of ``window`` words that carry the text's class, and scored by
the largest logit of all its runs of ``window`` words, one beginning at each word, and by the logarithm
of their number, since a maximum rises with the number of runs. A logistic over both gives the probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np

BUCKETS = 1 << 16
#: Shortest and longest n-gram of the marked word "<word>", which is an n-gram itself.
GRAMS = (3, 5)
_WORD = re.compile(rb"[0-9a-z'\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits, apostrophes and non-ASCII, in lower case."""
    return _WORD.findall((text or "").lower().encode("utf-8", "replace"))


def grams(word: bytes, buckets: int = BUCKETS, sizes: tuple[int, int] = GRAMS) -> list[int]:
    """Buckets of the character n-grams of one word; a word's bytes stand for its characters."""
    marked = b"<" + word + b">"
    n = len(marked)
    found = [crc32(marked) % buckets]
    for size in range(sizes[0], min(sizes[1], n - 1) + 1):
        found += [crc32(marked[i : i + size]) % buckets for i in range(n - size + 1)]
    return found


class Model(NamedTuple):
    """One number per bucket and the bias (window logit), window size, and the logistic over the largest window logit and the logarithm of the number of windows."""

    table: np.ndarray
    bias: float
    window: int
    slope: float
    length_slope: float
    offset: float


def windows(found: Sequence[bytes], size: int) -> list[Sequence[bytes]]:
    """A text's words cut into runs of ``size``; the last run may be shorter. No words: no run."""
    return [found[i : i + size] for i in range(0, len(found), size)]


def _descend(bags, y, flat, starts, vectors, softmax, bias, seen, *, rate, decay, batch, rng) -> None:
    """One epoch of Adagrad over bags (word ids, shares) with classes y, in place."""
    dim = vectors.shape[1]
    order = rng.permutation(len(y))
    for at in range(0, len(order), batch):
        rows = order[at : at + batch]
        ids = np.concatenate([bags[r][0] for r in rows])
        share = np.concatenate([bags[r][1] for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
        unique, where = np.unique(ids, return_inverse=True)
        sizes = starts[unique + 1] - starts[unique]
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        gram = flat[np.repeat(starts[unique] - begin, sizes) + np.arange(sizes.sum())]
        word = np.add.reduceat(vectors[gram], begin, axis=0) / sizes[:, None]
        mean = np.empty((len(rows), dim), np.float32)
        for k in range(dim):
            mean[:, k] = np.bincount(doc, share * word[where, k], len(rows))
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p /= len(rows)
        back = p @ softmax.T
        touched, slot = np.unique(gram, return_inverse=True)
        g_vectors = np.empty((len(touched), dim), np.float32)
        for k in range(dim):
            g_word = np.bincount(where, share * back[doc, k], len(unique)) / sizes
            g_vectors[:, k] = np.bincount(slot, np.repeat(g_word, sizes), len(touched))
        g_vectors += decay * vectors[touched]
        seen[0][touched] += g_vectors**2
        vectors[touched] -= rate * g_vectors / np.sqrt(seen[0][touched])
        for x, g, s in ((softmax, mean.T @ p + decay * softmax, seen[1]), (bias, p.sum(0), seen[2])):
            s += g**2
            x -= rate * g / np.sqrt(s)


def train(
    texts: Sequence[str | None],
    labels: Iterable[int],
    *,
    dim: int = 6,
    buckets: int = BUCKETS,
    window: int = 6,
    epochs: int = 5,
    steps: int = 400,
    rate: float = 0.2,
    decay: float = 1e-6,
    seed: int = 7,
) -> Model:
    """The folded two-class model of whole texts, learnt from their windows.

    A window gets its text's class. A logistic over a text's largest window logit and the logarithm of its
    number of windows then gives the probability that the whole text is of class 1: a few words
    decide, wherever they stand, and the length of the text is allowed for. A batch is such that an epoch has about ``steps`` updates, and 32 windows at least. With no text or one class only, the table is zero and every
    text scores the smoothed share of class 1.
    """
    y = np.asarray(list(labels), dtype=np.int64)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(buckets, np.float32), 0.0, window, 0.0, 0.0, prior)
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    bags, classes = [], []
    for text, label in zip(texts, y, strict=True):
        for run in windows(words(text), window):
            bag = Counter(run)
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in bag), np.int32, len(bag))
            bags.append((ids, np.fromiter(bag.values(), np.float32, len(bag)) / len(run)))
            classes.append(label)
    z = np.asarray(classes, np.int64)
    lists = [np.asarray(grams(w, buckets), np.int32) for w in vocabulary]
    starts = np.concatenate(([0], np.cumsum([len(g) for g in lists]))).astype(np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    del lists, vocabulary
    vectors = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    seen = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, softmax, bias)]
    batch = max(32, -(-len(z) // steps))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        _descend(bags, z, flat, starts, vectors, softmax, bias, seen, rate=step, decay=decay, batch=batch, rng=rng)
    table = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    model = Model(table, float(bias[1] - bias[0]), window, 1.0, 0.0, 0.0)
    scorer = Scorer(model)
    seen_by = np.array([scorer.peak(t) for t in texts])
    return Model(table, model.bias, window, *_logistic(seen_by, y))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> tuple[float, float, float]:
    """Slopes of (window logit, logarithm of the number of windows) and offset of a logistic regression.

    Newton's method with a small ridge. The first slope is 0 at least, and the second 0 at most:
    more windows are never a reason for class 1.
    """
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    design = np.concatenate([(x - middle) / spread, np.ones((len(x), 1))], axis=1)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    slopes = [0.0, 0.0]
    for used in ([0, 1, 2], [0, 2]):  # without the length, if its slope would be above 0
        part, w = design[:, used], np.array([0.0] * (len(used) - 1) + [start])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hessian = part.T @ (part * (p * (1 - p))[:, None]) + ridge * np.eye(len(used))
            w += np.clip(np.linalg.solve(hessian, part.T @ (y - p) - ridge * w), -1, 1)
        slopes = [max(0.0, float(w[0]) / float(spread[0])), float(w[1]) / float(spread[1]) if len(used) == 3 else 0.0]
        if slopes[1] <= 0:
            break
    return slopes[0], slopes[1], float(w[-1] - slopes[0] * middle[0] - slopes[1] * middle[1])


class Scorer:
    """Scores texts with a folded model; remembers words up to a fixed number."""

    def __init__(self, model: Model, remember: int = 700_000):
        self.model, self.remember, self.known, self.table = model, remember, {}, model.table.tolist()

    def _value(self, word: bytes) -> float:
        known = self.known
        value = known.get(word)
        if value is None:
            if len(known) >= self.remember:
                known.clear()
            table = self.table
            ids = grams(word, len(table))
            value = known[word] = sum([table[k] for k in ids]) / len(ids)
        return value

    def peak(self, text: str | None) -> tuple[float, float]:
        """Largest window logit of the whole text and the logarithm of the number of windows.

        A text of fewer words than a window is one window; a text without words has the bias alone.
        """
        values = [self._value(w) for w in words(text)]
        size, bias = self.model.window, self.model.bias
        if len(values) <= size:
            return bias + (sum(values) / len(values) if values else 0.0), 0.0
        upto = np.cumsum([0.0, *values])
        return bias + float((upto[size:] - upto[:-size]).max()) / size, float(np.log(len(values) - size + 1))

    def score(self, text: str | None) -> float:
        """Probability of class 1."""
        logit, windows = self.peak(text)
        at = self.model.slope * logit + self.model.length_slope * windows + self.model.offset
        return float(1 / (1 + np.exp(-np.clip(at, -40, 40))))
