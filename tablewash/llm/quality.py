"""Quality: a linear-chain conditional random field over the lines of a document.

Every line has measures of its own bytes and words (letters, digits, symbols,
streaks of one byte, word lengths, repeated neighbouring words, sentence ends and so
on); each falls into one of ``BINS`` quantile bins, and the field has a weight for each
bin of the line itself, of the line before and of the line after, besides weights
for the label changes along the chain. It is trained by maximum likelihood
(forward-backward, numpy) on a bounded sample of labelled documents, whose lines
take their document's label. A document's quality is the mean of its lines'
marginals weighted by their lengths, turned into a probability by a logistic fit
on sampled documents that the field didn't see.

Results: blank lines take no part; NULL, empty and blank texts have no line and
get the score of the mean label; texts of over 1 MB are measured in pieces cut at
line ends (or at white space in endless lines), and the chain runs over all lines;
repeated rows, NULL ids and other columns pass as in ``toxicity.score``; without
labels of both kinds every score is the share of label 1; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from tablewash.llm.common import segments, span_hashes, spans
from tablewash.llm.toxicity import logistic, sample_of

BINS = 8
ROUNDS, RATE, DECAY = 80, 0.08, 1e-3
#: Sampled labelled documents of each label, and the longest that is sampled (bytes).
SAMPLE, SAMPLE_BYTES = 1200, 1 << 15

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 capital, 3 digit, 4 white, 5 sentence mark, 6 symbol
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, *range(9, 14)]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~()[]"]] = 6


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line x measure), bytes per line, lines per text, over the lines that hold words."""
    rows, sizes, owners = [], [], []
    for ids, offsets, buf in segments(texts, at_lines=True):
        stop = buf == 10
        stop[offsets[1:] - 1] = True  # the joint of two pieces
        stop[-1] = True
        ends = np.flatnonzero(stop)
        starts = np.concatenate([[0], ends[:-1] + 1])
        a, b = spans(buf)
        line = np.searchsorted(ends, a)
        n = len(ends)
        words = np.bincount(line, minlength=n)
        kind = _CLASS[buf]
        share = []
        for k in (1, 2, 3, 5, 6):
            total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
            share.append(total[ends] - total[starts])
        same = np.concatenate([[False], (buf[1:] == buf[:-1]) & (kind[1:] != 4)])
        total = np.concatenate([[0], np.cumsum(same, dtype=np.int64)])
        share.append(total[ends] - total[starts])
        size = np.maximum(ends - starts, 1)
        h, length = span_hashes(buf, a, b), b - a
        w = np.maximum(words, 1)
        repeats = []
        for lag in (1, 2, 3):
            again = np.zeros(len(h))
            again[lag:] = (h[lag:] == h[:-lag]) & (line[lag:] == line[:-lag])
            repeats.append(np.bincount(line, again, n) / w)
        long_ = np.bincount(line, length, n) / w
        ends_mark = np.bincount(line, kind[b - 1] == 5, n) / w
        ends_sign = np.bincount(line, kind[b - 1] == 6, n) / w
        short = np.bincount(line, length <= 3, n) / w
        single = np.bincount(line, length == 1, n) / w
        wide = np.bincount(line, length > 12, n) / w
        capital = np.bincount(line, kind[a] == 2, n) / w
        keep = words > 0
        last = np.searchsorted(line, np.arange(n), side="right") - 1
        closed = kind[b[last] - 1] == 5 if len(b) else np.zeros(n)
        columns = [s / size for s in share] + repeats + [long_, ends_mark, ends_sign, short, single, wide, capital, closed, np.log1p(words), np.log1p(size)]
        rows.append(np.stack(columns, 1)[keep])
        sizes.append(size[keep])
        owners.append(ids[np.searchsorted(offsets, starts[keep], side="right") - 1])
    if not rows:
        return np.zeros((0, 19)), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    counts = np.bincount(np.concatenate(owners).astype(np.int64), minlength=len(texts))
    return np.concatenate(rows), np.concatenate(sizes), counts


def cells(x: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Weight numbers of each line: its own bins, the bins of the line before, of the line after
    (a bin of its own stands for the document's edge)."""
    n, k = x.shape
    own = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)], 1) if n else np.zeros((0, k), np.int64)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    filled = counts[counts > 0]
    last = np.cumsum(filled) - 1
    before[last - filled + 1] = BINS
    after[last] = BINS
    at = np.arange(k) * (BINS + 1)
    return np.concatenate([own + at, before + at + k * (BINS + 1), after + at + 2 * k * (BINS + 1)], 1)


def marginals(u: np.ndarray, counts: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of all chains in step. ``u``: (line x label) scores, ``change``: label-to-label
    scores. Returns P(label 1) of each line, expected changes (2 x 2) and observed-free chain begins."""
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    length, first = counts[order], begin[order]
    forward, back = np.zeros_like(u), np.zeros_like(u)
    longest = int(length[0]) if len(length) else 0
    live = [int(n) for n in np.searchsorted(-length, -np.arange(longest), side="left")]

    def join(s, t):  # log sum over the label that s ranges over
        z = s[:, :, None] + t[None]
        top = z.max(1)
        return top + np.log(np.exp(z - top[:, None, :]).sum(1))

    for t in range(longest):
        at = first[: live[t]] + t
        f = u[at] if t == 0 else u[at] + join(forward[at - 1], change)
        forward[at] = f - f.max(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        r = join(u[at + 1] + back[at + 1], change.T)
        back[at] = r - r.max(1, keepdims=True)
    z = forward + back
    p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
    pairs = np.ones(len(u), bool)
    pairs[first] = False
    at = np.flatnonzero(pairs)
    expected = np.zeros((2, 2))
    if len(at):
        q = forward[at - 1][:, :, None] + change[None] + (u[at] + back[at])[:, None, :]
        q = np.exp(q - q.max((1, 2), keepdims=True))
        expected = (q / q.sum((1, 2), keepdims=True)).sum(0)
    return p, expected, at


class Field:
    """Bins, weights of the bins towards label 1, label change scores, logistic fit."""

    def __init__(self, edges, weight, change, slope, shift, share):
        self.edges, self.weight, self.change, self.slope, self.shift, self.share = edges, weight, change, slope, shift, share

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, sizes, counts = measures(texts)
        u = np.zeros((len(x), 2))
        u[:, 1] = self.weight[cells(x, counts, self.edges)].sum(1)
        return marginals(u, counts, self.change)[0], sizes, counts

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of each text (NaN without lines)."""
        p, sizes, counts = self.line_marginals(texts)
        text = np.repeat(np.arange(len(counts)), counts)
        with np.errstate(invalid="ignore"):
            return np.bincount(text, p * sizes, len(counts)) / np.bincount(text, sizes, len(counts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        q = self.quality(texts)
        z = self.slope * (q - 0.5) + self.shift
        return np.where(np.isnan(q), self.share, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Field:
    held = np.arange(len(texts)) % 4 == 3
    x, _, counts = measures([t for t, h in zip(texts, held) if not h])
    truth = labels[~held]
    k = x.shape[1]
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.concatenate([np.quantile(c, at), np.quantile(c[c > c.min()], at[::3]) if (c > c.min()).any() else []]))[: BINS - 1] for c in x.T]
    cell = cells(x, counts, edges)
    y = np.repeat(truth, counts).astype(float)
    # both labels weigh alike, every document by its lines
    per_doc = np.repeat(1 / np.maximum(counts, 1), counts)
    weight, change = np.zeros(3 * k * (BINS + 1)), np.zeros((2, 2))
    m = [0.0, 0.0]
    v = [0.0, 0.0]
    scale = np.where(y == 1, 0.5 / max(per_doc[y == 1].sum(), 1e-9), 0.5 / max(per_doc[y == 0].sum(), 1e-9)) * per_doc
    for step in range(1, ROUNDS + 1):
        u = np.zeros((len(x), 2))
        u[:, 1] = weight[cell].sum(1)
        p, expected, at = marginals(u, counts, change)
        observed = np.zeros((2, 2))
        np.add.at(observed, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
        grads = [
            np.bincount(cell.ravel(), np.repeat(scale * (p - y), cell.shape[1]), len(weight)) + DECAY / 100 * weight,
            (expected - observed) / max(len(at), 1) + DECAY * change,
        ]
        for i, (value, grad) in enumerate(((weight, grads[0]), (change, grads[1]))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.98 * v[i] + 0.02 * grad * grad
            value -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.98**step)) + 1e-5)
    field = Field(edges, weight, change, 1.0, 0.0, share)
    late, y = [t for t, h in zip(texts, held) if h], labels[held].astype(float)
    q = field.quality(late)
    known = ~np.isnan(q)
    if len(set(y[known])) == 2:
        y, q = y[known], q[known]
        field.slope, field.shift = logistic(q - 0.5, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return field


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality") -> Field:
    texts, y, share = sample_of(docs, labels, label, allowed, SAMPLE, SAMPLE_BYTES)
    if len(set(y.tolist())) < 2:
        k = measures([])[0].shape[1]
        even = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Field([np.zeros(0)] * k, np.zeros(3 * k * (BINS + 1)), np.zeros((2, 2)), 0.0, even, share)
    return train(texts, y, share)
