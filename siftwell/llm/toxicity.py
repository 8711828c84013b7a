"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, on sentences.

Segments: a sentence (cut into windows of at most ``WINDOW`` words) is a bag of distinct segments: its
words, lower-cased, without marks ("id.iot" is "idiot"); runs of three or more single characters
("i d i o t") add the joined run.

Kernel: k(v, w) of two segments is the cosine of their gap-weighted subsequence vectors: subsequences of
three characters, gaps allowed, a mark at the segment's start as one more character; an occurrence that
spans s characters (s <= ``SPAN``) weighs DECAY^s. An insult with an inserted or replaced character keeps
most of its subsequences. Two sentences compare by the set kernel K(S, T) = sum of k(v, w)^POWER over all
segments v of S and w of T: the power lets the near pairs count. Gaps never cross a blank, save in runs.

Training: the rows are sentences; each inherits the label of its text (one found in both classes is
clean). The sentence kernel is approximated by Nystroem landmarks, one-segment sentences: the segments of
toxic texts whose document counts speak most against clean texts, spread out, frequent clean segments, and
after each round those segments of clean texts (two at least) that the machine mistakes. A squared-hinge linear SVM is fitted on the Nystroem
features. As most sentences of a toxic text are harmless, it is refitted a few times (multiple-instance
SVM): a toxic text's best sentence, and any other of its sentences that scores above zero, stay positive,
the rest leave. Its best sentences are also shown with their worst segment disguised (a character inserted
or masked), so that the margin allows for disguise.

Score: a sentence's value is the sum of its segments' values, which are kept in a cache; a text's is a
logistic function, fitted on the training texts, of its three highest sentence values (between -``CLIP``
and ``CLIP``; missing ones count -``CLIP``) and the logarithm of the number of its sentences.

Null and empty texts, and those of marks only, have no segment: their value is ``LEAST``. With labels of
one class or none, or no segment in either class, the score is the smoothed share of toxic labels.
Repeated rows are scored each on its own; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import crc_fold, slices, texts
from siftwell.llm.sampling import labelled_sample

DECAY = 0.5
SPAN = 7
POWER = 3
WINDOW = 40
CLIP = 3.0
LETTERS = 42  # 0 ends a word, 1-26 a-z, 27 digits, 28-40 other letters by code point, 41 opens a word
OPEN = "\x01"
N_CODES = LETTERS**3
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
LEAST = -4.0  # the value of a text without segments

_MARKS = re.compile(r"[^\w\s]|_")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")


def segments(text: str) -> set[str]:
    """The distinct segments of a sentence."""
    return _bag(_MARKS.sub("", text.lower()).split())


def _bag(words: list[str]) -> set[str]:
    found = set(words)
    if sum(len(w) == 1 for w in words) > 2:
        run: list[str] = []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) > 2:
                    found.add("".join(run))
                run = []
    return found


def sentence_bags(text: str | None) -> list[set[str]]:
    """The segments of each sentence, window by window."""
    out = []
    for s in _SENTENCE.split(text or ""):
        words = _MARKS.sub("", s.lower()).split()
        for lo in range(0, len(words), WINDOW):
            out.append(_bag(words[lo : lo + WINDOW]))
    return out


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, each word followed by SPAN zeros; the words' lengths with the opening mark."""
    gap = "\0" * SPAN
    points = np.frombuffer((OPEN + (gap + OPEN).join(words) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points > 0, 28 + points % 13, 0)
    low = (points >= 97) & (points <= 122)
    out[low] = points[low] - 96
    out[(points >= 48) & (points <= 57)] = 27
    out[points == 1] = LETTERS - 1
    return out.astype(np.int64), np.array([len(w) + 1 for w in words])


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, weight) of the distinct subsequences of each word; each word's weights have length 1."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    c, lens = _letters(words)
    owner = np.repeat(np.arange(len(words)), lens + SPAN) * N_CODES
    n, keys, weights = len(c), [], []
    for i, j in OFFSETS:
        a, b, d = c[: n - j], c[i : n - j + i], c[j:]
        at = np.flatnonzero((a > 0) & (b > 0) & (d > 0))
        keys.append(owner[at] + (a[at] * LETTERS + b[at]) * LETTERS + d[at])
        weights.append(np.full(len(at), DECAY ** (j + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    if not len(key):
        return key, key, weight
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight, key = np.add.reduceat(weight, first), key[first]
    own = key // N_CODES
    norm = np.sqrt(np.bincount(own, weights=weight * weight, minlength=len(words)))
    return own, key % N_CODES, weight / norm[own]


class Landmarks:
    """Words with their subsequences listed by code, so that a kernel value costs the shared ones only."""

    def __init__(self, words: list[str]):
        self.words = words
        own, code, weight = subsequences(words)
        order = np.argsort(code, kind="stable")
        self.owner, self.weight = own[order], weight[order]
        self.first = np.searchsorted(code[order], np.arange(N_CODES + 1))

    def kernel(self, words: list[str], block: int = 4000) -> np.ndarray:
        """k(word, landmark), words by landmarks."""
        m = len(self.words)
        out = np.zeros((len(words), m), np.float32)
        for lo in range(0, len(words), block):
            part = words[lo : lo + block]
            own, code, weight = subsequences(part)
            n = self.first[code + 1] - self.first[code]
            hit = n > 0
            own, code, weight, n = own[hit], code[hit], weight[hit], n[hit]
            if not len(n):
                continue
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1])) + np.repeat(self.first[code] - (ends - n), n)
            cell = np.repeat(own * m, n) + self.owner[at]
            out[lo : lo + len(part)] = np.bincount(cell, weights=np.repeat(weight, n) * self.weight[at], minlength=len(part) * m).reshape(len(part), m)
        return out


def spread(ranked: Iterable[str], most: int, nearest: float = 0.9, block: int = 200) -> list[str]:
    """The first ``most`` words, in order, that are not as near as ``nearest`` to one picked before."""
    picked: list[str] = []
    ranked = iter(ranked)
    while len(picked) < most and (part := [w for _, w in zip(range(block), ranked)]):
        near = Landmarks(picked).kernel(part).max(axis=1) if picked else np.zeros(len(part))
        among = Landmarks(part).kernel(part)
        for i, w in enumerate(part):
            if near[i] < nearest and len(picked) < most:
                picked.append(w)
                near = np.maximum(near, among[:, i])
    return picked


def text_features(values: list[float]) -> list[float]:
    """The three highest sentence values, clipped, and log(1 + number of sentences)."""
    top = [max(-CLIP, min(CLIP, v)) for v in heapq.nlargest(3, values)]
    return [*top, *[-CLIP] * (3 - len(top)), float(np.log1p(len(values)))]


@dataclass
class ToxicModel:
    marks: Landmarks | None
    weights: np.ndarray  # one a landmark: the SVM behind the Nystroem map
    bias: float  # of a sentence
    slope: np.ndarray  # of text_features
    shift: float
    prior: float

    def learn(self, words: Iterable[str], cache: dict[str, float]) -> None:
        """Adds the values of words to the cache."""
        new = [w for w in words if w not in cache]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            cache.update(zip(part, (self.marks.kernel(part) ** POWER @ self.weights).tolist()))

    def values(self, texts: list[str | None], cache: dict[str, float], most: int = 300_000) -> np.ndarray:
        """The value of each text; at most ``most`` words stay in the cache."""
        out = np.full(len(texts), LEAST)
        for lo in range(0, len(texts), 128):
            docs = [sentence_bags(t) for t in texts[lo : lo + 128]]
            words = set().union(*(b for bags in docs for b in bags))
            if len(cache) + len(words) > most:
                cache.clear()
            self.learn(words, cache)
            get = cache.__getitem__
            for i, bags in enumerate(docs):
                if bags:
                    out[lo + i] = float(np.dot(self.slope, text_features([self.bias + sum(map(get, b)) for b in bags])) + self.shift)
        return out

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        if self.marks is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.values(texts, cache), -30, 30)))


def disguised(word: str, rng: np.random.Generator) -> str:
    """The word with one character inserted, or with one inner character masked by a digit."""
    if rng.random() < 0.5:
        i = int(rng.integers(1, len(word)))
        return word[:i] + chr(97 + int(rng.integers(26))) + word[i:]
    j = int(rng.integers(1, max(2, len(word) - 1)))
    return word[:j] + "0" + word[j + 1 :]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM with a bias (the last weight), by Newton steps on the active set."""
    n = z.shape[1]
    reg = np.eye(n + 1)
    reg[-1, -1] = 1e-3
    w = np.zeros(n + 1)
    for _ in range(rounds):
        active = np.flatnonzero(y * (z @ w[:-1].astype(z.dtype) + w[-1]) < 1)
        gram, side = reg.copy(), np.zeros(n + 1)
        for lo in range(0, len(active), 8192):
            at = active[lo : lo + 8192]
            xa = np.c_[z[at], np.ones(len(at))].astype(np.float64)
            xk = xa * weight[at][:, None]
            gram += xk.T @ xa
            side += xk.T @ y[at]
        new = np.linalg.solve(gram, side)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(slope, shift) of the weighted logistic fit, by Newton steps of bounded length."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


class Sentences:
    """Distinct training sentences (tuples of segments), and sums of word rows over them in blocks."""

    def __init__(self, bags: list[tuple[str, ...]]):
        self.bags = bags

    def features(self, row_of, width: int, block: int = 4000) -> np.ndarray:
        """Sum over each sentence of ``row_of(words)``, an array of one row a word."""
        out = np.empty((len(self.bags), width), np.float32)
        for lo in range(0, len(self.bags), block):
            part = self.bags[lo : lo + block]
            words = sorted({w for b in part for w in b})
            place = {w: i for i, w in enumerate(words)}
            lens = np.array([len(b) for b in part])
            out[lo : lo + block] = np.add.reduceat(row_of(words)[[place[w] for b in part for w in b]], np.cumsum(lens) - lens, axis=0)
        return out


def fit(rows: list[tuple[int, Iterable[str]]], counts: dict[int, int], toxic_marks: int = 96, common_marks: int = 16, hard_marks: int = 32, rounds: int = 5, cost: float = 0.1, most_rows: int = 50_000, seed: int = 7) -> ToxicModel:
    """Fit on (label, sentences of the text, each its segments joined by blanks) of sampled documents.

    Of more than ``most_rows`` distinct sentences of a class, those of the least hash are the training rows;
    ``toxic_marks`` + ``common_marks`` + ``hard_marks`` bounds the landmarks. Counts of words and the
    calibration see all sentences given."""
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2)
    none = ToxicModel(None, np.zeros(0), 0.0, np.zeros(4), 0.0, prior)
    names: dict[str, str] = {}  # one object a word
    docs = [(y, [tuple(names.setdefault(w, w) for w in sorted(set(s.split()))) for s in sentences if s.strip()]) for y, sentences in rows]
    per = {k: sum(1 for y, _ in docs if y == k) for k in (0, 1)}
    clean = {b for y, bags in docs if y == 0 for b in bags}
    toxic = {b for y, bags in docs if y == 1 for b in bags} - clean
    if not clean or not toxic:
        return none
    df: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for y, bags in docs:
        own = df[y]
        for w in {w for b in bags for w in b}:
            own[w] = own.get(w, 0) + 1

    def told(w: str) -> float:
        """How many standard errors lie between the word's shares of toxic and of clean documents."""
        a, b = df[1].get(w, 0), df[0].get(w, 0)
        p = (a + b) / (per[0] + per[1])
        return (a / per[1] - b / per[0]) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / per[1] + 1 / per[0]))

    usual = sorted((w for w in df[0] if len(w) > 1), key=lambda w: (-df[0][w], w))
    marks = spread(sorted((w for w in df[1] if len(w) > 2), key=lambda w: (-told(w), w)), toxic_marks)
    marks += [w for w in spread(usual, common_marks) if w not in marks]
    if not marks:
        return none
    twice = [w for w in usual if df[0][w] > 1]
    order = lambda bags: sorted(bags, key=lambda b: (zlib.crc32(" ".join(b).encode("utf-8", "surrogatepass")), b))[:most_rows]
    good, bad = order(clean), order(toxic)
    place = {b: len(good) + i for i, b in enumerate(bad)}
    owned = [sorted({place[b] for b in bags if b in place}) for y, bags in docs if y == 1]
    kept = Sentences(good + bad)
    label = np.r_[-np.ones(len(good)), np.ones(len(bad))]
    rng = np.random.default_rng(seed)
    model, known = none, set(marks)
    extra: list[tuple[str, ...]] = []
    use = np.ones(len(label), bool)
    land, raw, z, white = Landmarks([]), np.zeros((len(kept.bags), 0), np.float32), None, None
    for r in range(rounds):
        if len(land.words) < len(marks):
            more = Landmarks(marks[len(land.words) :])
            raw = np.c_[raw, kept.features(lambda words, more=more: more.kernel(words) ** POWER, len(more.words))]
            land = Landmarks(marks)
            val, vec = np.linalg.eigh(land.kernel(marks).astype(np.float64) ** POWER + 1e-3 * np.eye(len(marks)))
            white = (vec / np.sqrt(np.maximum(val, 1e-6))).astype(np.float32)
            z = raw @ white
        x, y = z[use], label[use]
        if extra:
            x, y = np.r_[x, Sentences(extra).features(lambda words: land.kernel(words) ** POWER, len(marks)) @ white], np.r_[y, np.ones(len(extra))]
        rare = np.sqrt(max(1.0, (y < 0).sum() / max((y > 0).sum(), 1)))  # halfway to classes weighed alike
        w = _svm(x, y, cost * np.where(y > 0, rare, 1.0))
        model = ToxicModel(land, white @ w[:-1].astype(np.float32), float(w[-1]), np.zeros(4), 0.0, prior)
        if r == rounds - 1:
            break
        value = z @ w[:-1].astype(np.float32) + w[-1]
        use = label < 0
        best = {own[int(np.argmax(value[own]))] for own in owned if own}
        use[sorted(best)] = True
        use |= (label > 0) & (value > 0)
        cache: dict[str, float] = {}
        model.learn({q for i in best for q in kept.bags[i]}, cache)
        extra = []
        for i in sorted(best):
            bag = kept.bags[i]
            worst = max(bag, key=lambda q: (cache[q], q))
            if len(worst) > 2:
                extra.append(tuple(disguised(q, rng) if q == worst else q for q in bag))
        # Clean segments that score high, the frequent ones first, become landmarks too.
        model.learn(twice, cache)
        hard = sorted((q for q in twice if cache[q] > 0.2 and df[1].get(q, 0) * per[0] < 2 * df[0][q] * per[1] and q not in known), key=lambda q: (-cache[q] * np.log1p(df[0][q]), q))
        marks = marks + spread(hard, hard_marks // (rounds - 1))
        known.update(marks)
    cache = {}
    got = []
    for y, bags in docs:
        model.learn({q for b in bags for q in b}, cache)
        got.append((y, text_features([model.bias + sum(cache[q] for q in b) for b in bags])) if bags else None)
    got = [g for g in got if g]
    y = np.array([g[0] for g in got])
    share = np.array([counts.get(k, per[k]) / max(per[k], 1) for k in (0, 1)])
    model.slope, model.shift = logistic(np.array([g[1] for g in got]), y, share[y])
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = 2000, per_text: int = 400) -> ToxicModel:
    """Fit on at most ``per_class`` labelled documents of each class outside the held-out fold, and on at most
    ``per_text`` sentences of each, those of the least hash: these bounds limit what reaches the driver."""
    sample, counts = labelled_sample(docs, labels, "toxic", modulus, held_out, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            kept = []
            for t in batch.column(2).to_pylist():
                own = [" ".join(sorted(b)) for b in sentence_bags(t)]
                if len(own) > per_text:
                    own = sorted(own, key=lambda s: (zlib.crc32(s.encode("utf-8", "surrogatepass")), s))[:per_text]
                kept.append("\n".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], names=["doc_id", "y", "bags"])

    rows = sample.mapInArrow(run, "doc_id bigint, y int, bags string").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["bags"]))
    return fit([(r["y"], r["bags"].split("\n")) for r in rows], counts)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in slices(batches, 128):
            s = model.scores(batch.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    slim = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels)).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
