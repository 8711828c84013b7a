"""Document quality from a linear-chain conditional random field over its lines.

Every ``\\n``-split line with a word is a node, labelled good (1) or bad (0). Node potentials are linear
in binned features of the line and of the lines before and after; edges have a 2 x 2 table. Labels mark
documents, so training takes two rounds: first every line has its document's label; then lines whose own
features say the contrary by ``MARGIN`` in log odds under the first fit take the other label (one line of
the document's label stays at least) and the field is fitted anew, so that the edges see labels change
inside documents. Lines of long documents come in chains of at most ``chain`` nodes; the two classes of
documents weigh alike. Scoring runs forward-backward over the whole document; the good marginals,
weighted by the lines' lengths in code points, average to the document's value, and a two-parameter
sigmoid fitted on the training documents turns its logit into the score.

Null and empty texts, or texts of white space, are one node with the feature "empty". Without training
rows of both classes the score is the smoothed share of good labels (:func:`keep_good` then keeps all rows
and warns). Labels, language, source and id are no inputs of the score; repeated rows are scored each on
its own.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import crc_fold, slices, texts
from siftwell.llm.quality_rules import CLOSERS
from siftwell.llm.sampling import labelled_sample, platt

SYMBOLS = "#*$%&|<>"
#: Upper bounds of the bins of each ratio; a value falls into the first bin that it does not exceed.
RATIO_BINS = (0.0, 0.05, 0.15, 0.3, 0.6)
LENGTH_BINS = (1, 3, 6, 12, 25, 50, 100, 200)
RATIOS = ("symbol words", "bangs", "upper words", "same neighbours", "repeats", "digits", "commas")
N_FEATURES = len(RATIOS) * (len(RATIO_BINS) + 1) + len(LENGTH_BINS) + 1 + 4
EMPTY = N_FEATURES - 1
MARGIN = 2.0


def line_features(line: str, words: list[str], seen: set[str]) -> list[int]:
    """Indices of the features that the line has."""
    n = len(words)
    ratios = (
        sum(map(line.count, SYMBOLS)) / n,
        line.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n if n > 7 else 0.0,
        sum(map(line.count, "0123456789")) / (4 * n),
        (line.count(",") + line.count(";")) / n,
    )
    out, at = [], 0
    for r in ratios:
        k = 0
        while k < len(RATIO_BINS) and r > RATIO_BINS[k]:
            k += 1
        out.append(at + k)
        at += len(RATIO_BINS) + 1
    k = 0
    while k < len(LENGTH_BINS) and n > LENGTH_BINS[k]:
        k += 1
    out.append(at + k)
    at += len(LENGTH_BINS) + 1
    if line.rstrip()[-1:] in CLOSERS:
        out.append(at)
    if line in seen:
        out.append(at + 1)
    if sum(map(len, words)) > 12 * n:
        out.append(at + 2)
    return out


def document_lines(text: str | None) -> tuple[list[bytes], list[int]]:
    """Features (one byte each) and lengths of the lines of one text."""
    feats, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        if words := line.split():
            feats.append(bytes(line_features(line, words, seen)))
            sizes.append(len(line))
            seen.add(line)
    return (feats, sizes) if feats else ([bytes([EMPTY])], [1])


def one_hot(feats: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(feats), N_FEATURES), np.float32)
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    x[rows, [i for f in feats for i in f]] = 1
    return x


@dataclass
class LineCRF:
    own: np.ndarray  # weights towards good: of the line, of the one before, of the one after
    before: np.ndarray
    after: np.ndarray
    bias: float
    first: np.ndarray  # start scores by label
    edge: np.ndarray  # 2 x 2: from, to
    a: float = 1.0
    b: float = 0.0
    prior: float | None = None  # set when nothing could be learned

    def potentials(self, feats: list[bytes], starts: np.ndarray) -> np.ndarray:
        """Good-against-bad node scores of lines stacked document after document."""
        flat = np.frombuffer(b"".join(feats), np.uint8)
        lens = np.fromiter(map(len, feats), np.int64, len(feats))
        at = np.cumsum(lens) - lens
        s, prev, nxt = (np.add.reduceat(w[flat], at).astype(np.float64) for w in (self.own, self.before, self.after))
        s += self.bias
        if len(feats) > 1:
            inner = np.ones(len(feats), bool)
            inner[starts] = False
            s[1:] += np.where(inner[1:], prev[:-1], 0)
            s[:-1] += np.where(inner[1:], nxt[1:], 0)
        return s

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 64):
            out[lo : lo + 64] = self.document_values([document_lines(t) for t in texts[lo : lo + 64]])
        return 1 / (1 + np.exp(-np.clip(self.a * out + self.b, -30, 30)))

    def document_values(self, part: list[tuple[list[bytes], list[int]]]) -> list[float]:
        """The :meth:`value` of each document, given as features and lengths of its lines."""
        counts = np.array([len(f) for f, _ in part])
        ends = np.cumsum(counts)
        s = self.potentials([f for fs, _ in part for f in fs], ends - counts).tolist()
        return [self.value(s[ends[i] - counts[i] : ends[i]], sizes) for i, (_, sizes) in enumerate(part)]

    def value(self, s: list[float], sizes: list[int]) -> float:
        """Logit of the length-weighted mean of the good marginals (forward-backward over log odds)."""
        e = self.edge
        lse = np.logaddexp
        n = len(s)
        # With two labels a message is one number: the log odds of good against bad.
        hop = _hopper(e)
        back = _hopper(e.T)
        f, g = [0.0] * n, [0.0] * n
        f[0] = s[0] + float(self.first[1] - self.first[0])
        for t in range(1, n):
            f[t] = s[t] + hop(f[t - 1])
        for t in range(n - 2, -1, -1):
            g[t] = back(s[t + 1] + g[t + 1])
        good = total = 0.0
        for t in range(n):
            z = f[t] + g[t]
            m = 1 / (1 + 2.718281828459045 ** -max(-40.0, min(40.0, z)))
            good += sizes[t] * m
            total += sizes[t]
        p = min(max(good / total, 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))


def _hopper(e: np.ndarray):
    """Log odds after one edge, from the log odds before it."""
    from math import exp, log

    w = np.exp(e - e.max())
    a00, a01, a10, a11 = (float(v) for v in w.ravel())

    def hop(z: float) -> float:
        if z > 0:
            k = exp(-min(z, 700.0))
            return log((a11 + a01 * k) / (a10 + a00 * k))
        k = exp(max(z, -700.0))
        return log((a11 * k + a01) / (a10 * k + a00))

    return hop


def fit(rows: list[tuple[int, list[bytes], list[int]]], counts: dict[int, int], chain: int = 64, rounds: int = 150, ridge: float = 1.0, rate: float = 0.15) -> LineCRF:
    """Fit on (label, features of lines, lengths of lines), by Adam on the class-weighted likelihood."""
    f = N_FEATURES
    total = sum(counts.values())
    zero = LineCRF(np.zeros(f), np.zeros(f), np.zeros(f), 0.0, np.zeros(2), np.zeros((2, 2)))
    if not rows or len({y for y, _, _ in rows}) < 2:
        zero.prior = (counts.get(1, 0) + 1) / (total + 2)
        return zero
    rows = [(y, [bytes(q) for q in feats], sizes) for y, feats, sizes in rows]
    per = {y: sum(1 for r in rows if r[0] == y) for y in (0, 1)}
    first = _fit_lines(rows, [np.full(len(r[1]), r[0]) for r in rows], per, chain, rounds, ridge, rate)
    model = _fit_lines(rows, [relabelled(first, y, feats) for y, feats, _ in rows], per, chain, rounds, ridge, rate)
    raw = [v for lo in range(0, len(rows), 512) for v in model.document_values([r[1:] for r in rows[lo : lo + 512]])]
    share = [counts.get(y, per[y]) / per[y] for y in (0, 1)]
    model.a, model.b = platt(raw, [r[0] for r in rows], [share[r[0]] for r in rows])
    return model


def relabelled(model: LineCRF, y: int, feats: list[bytes]) -> np.ndarray:
    """Labels of a document's lines: its own, but the other where a line's own features say so by MARGIN; the
    line that says so least keeps the document's label."""
    odds = np.array([model.own[list(q)].sum() for q in feats], np.float64) + model.bias
    against = -odds if y else odds
    out = np.where(against > MARGIN, 1 - y, y)
    out[int(np.argmin(against))] = y
    return out


def _fit_lines(rows, line_labels: list[np.ndarray], per: dict[int, int], chain: int, rounds: int, ridge: float, rate: float) -> LineCRF:
    """The field for given labels of all lines; a document's chains share its weight."""
    f = N_FEATURES
    chains, labels, weights = [], [], []
    for (y, feats, _), own in zip(rows, line_labels):
        for k in range(0, len(feats), chain):
            chains.append(feats[k : k + chain])
            labels.append(own[k : k + chain])
            weights.append(0.5 / per[y] / -(-len(feats) // chain))
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    batches = []
    for lo in range(0, len(order), 1024):  # chains of like length share a block
        idx = order[lo : lo + 1024]
        t = max(len(chains[i]) for i in idx)
        x = np.zeros((len(idx), t + 2, f), np.float32)  # padded by one line at both ends
        mask, y = np.zeros((len(idx), t), bool), np.zeros((len(idx), t), np.int64)
        for r, i in enumerate(idx):
            x[r, 1 : len(chains[i]) + 1] = one_hot(chains[i])
            mask[r, : len(chains[i])] = True
            y[r, : len(chains[i])] = labels[i]
        batches.append((x, mask, y, np.array([weights[i] for i in idx])))
    w = np.zeros(3 * f + 1 + 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = ridge * 1e-3 * w
        for x, mask, y, wt in batches:
            grad -= _gradient(w, x, mask, y, wt)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineCRF(w[:f].astype(np.float32), w[f : 2 * f].astype(np.float32), w[2 * f : 3 * f].astype(np.float32), float(w[3 * f]), w[3 * f + 1 : 3 * f + 3], w[3 * f + 3 :].reshape(2, 2))


def _gradient(w: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray, wt: np.ndarray) -> np.ndarray:
    """Gradient of the weighted log likelihood of one block of chains; ``y`` has a label a line, or a chain."""
    f = x.shape[2]
    n, t = mask.shape
    y = np.broadcast_to(y[:, None], mask.shape) if y.ndim == 1 else y
    s = x[:, 1:-1] @ w[:f] + x[:, :-2] @ w[f : 2 * f] + x[:, 2:] @ w[2 * f : 3 * f] + w[3 * f]
    first, e = w[3 * f + 1 : 3 * f + 3], w[3 * f + 3 :].reshape(2, 2)
    node = np.stack([np.zeros_like(s), s], axis=2)
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = node[:, 0] + first
    lens = mask.sum(axis=1)
    for k in range(1, t):
        alpha[:, k] = node[:, k] + np.logaddexp(alpha[:, k - 1, :1] + e[0], alpha[:, k - 1, 1:] + e[1])
    for k in range(t - 2, -1, -1):
        nxt = node[:, k + 1] + beta[:, k + 1]
        beta[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(nxt[:, :1] + e[:, 0], nxt[:, 1:] + e[:, 1]), 0)
    logz = np.logaddexp(*(alpha[np.arange(n), lens - 1].T))
    p = np.exp(alpha + beta - logz[:, None, None])
    d = np.where(mask, (y - p[:, :, 1]), 0) * wt[:, None]
    g = np.zeros_like(w)
    for k, part in enumerate((x[:, 1:-1], x[:, :-2], x[:, 2:])):
        g[k * f : (k + 1) * f] = np.tensordot(d, part, axes=([0, 1], [0, 1]))
    g[3 * f] = d.sum()
    for lab in (0, 1):
        g[3 * f + 1 + lab] = (wt * ((y[:, 0] == lab) - p[:, 0, lab])).sum()
    if t > 1:
        live = mask[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                q = np.exp(alpha[:, :-1, i] + e[i, j] + node[:, 1:, j] + beta[:, 1:, j] - logz[:, None])
                g[3 * f + 3 + 2 * i + j] = ((((y[:, :-1] == i) & (y[:, 1:] == j)) - q) * live * wt[:, None]).sum()
    return g


def sampled_lines(feats: list[bytes], sizes: list[int], most: int, chain: int = 64) -> tuple[list[bytes], list[int]]:
    """Of a document of more than ``most`` lines, the chains of least hash, in order; others whole."""
    if len(feats) <= most:
        return feats, sizes
    starts = sorted(range(0, len(feats), chain), key=lambda k: (zlib.crc32(b"|".join(feats[k : k + chain])), k))[: most // chain]
    at = [i for k in sorted(starts) for i in range(k, min(k + chain, len(feats)))]
    return [feats[i] for i in at], [sizes[i] for i in at]


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = 1500, per_text: int = 4096) -> LineCRF:
    """Fit on at most ``per_class`` labelled documents of each class outside the held-out fold, and on at most
    ``per_text`` lines of each (the bounds; features of these lines, a few bytes each, are all that reaches
    the driver)."""
    sample, counts = labelled_sample(docs, labels, "quality", modulus, held_out, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [sampled_lines(*document_lines(t), per_text) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in parts], pa.list_(pa.binary())), pa.array([s for _, s in parts], pa.list_(pa.int64()))],
                names=["doc_id", "y", "feats", "sizes"],
            )

    rows = sample.mapInArrow(run, "doc_id bigint, y int, feats array<binary>, sizes array<bigint>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y))
    return fit([(int(r.y), [bytes(q) for q in r.feats], list(r.sizes)) for r in rows], counts)


def score(docs: DataFrame, model: LineCRF, carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``carry`` columns of every row, its score and prediction."""
    slim = texts(docs).select(*[F.col(c) for c in carry], F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.scores(batch.column(len(carry)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*carry, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["score double", "predicted int"]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels)).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, threshold: float = 0.3) -> DataFrame:
    """The pipeline's form: documents predicted good, in the columns of ``documents``. The field is fitted on
    ``source`` (default: the documents themselves), which should be the table that was labelled: what an
    earlier filter left may hold one class only. Labels of one class give no verdict: all rows stay, with a
    warning. Text passes through the scorer with its row, so nothing is joined back."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    model = train(docs if source is None else source, labels)
    if model.prior is not None:
        warnings.warn("quality labels of two classes are needed to fit the classifier; all documents stay", stacklevel=2)
        return docs.select(*cols)
    return score(docs.select(*cols), model, carry=tuple(cols), threshold=threshold).where("predicted = 1").select(*cols)
