"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of two inputs: the vector of its hashed self, and the
mean of the vectors of its hashed character n-grams (with its beginning and
end marked), so that unseen forms of known words are recognised. The network
reads a window of words in both directions, and attention pools its states.
A run of letters too long for a word enters as overlapping pieces, each a word.
All overlapping windows of a text are read, and a logistic function of its
worst windows and of their number gives the score. Labels are of documents:
training takes windows among the worst that the network itself finds in toxic
documents, against random and worst windows of others. It is written and
trained in numpy, on a bounded sample of labelled documents; the logistic
function is fitted on some held back from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import table
from passagemill.session import keep

WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 15
WORD_SIZE, GRAM_SIZE, HIDDEN, ATTENTION = 8, 16, 12, 8
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.5
#: Labelled documents of each kind that the network is trained on at most, and their longest text.
TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_CHARS = 1000, 2000, 200_000
STEPS, BATCH, RATE, WORD_DROP = 900, 160, 4e-3, 0.5
#: Negative documents whose worst windows are looked up each time, and worst windows of a document to choose from.
WORST_NEGATIVE, WORST = 600, 3
WORD = re.compile(r"\w+")
#: Characters of a word; longer runs (texts without spaces) are read as overlapping pieces, which share more than any n-gram holds.
PIECE, PIECE_STRIDE = 40, 30
#: Windows that are read at once.
BLOCK = 2048


def pieces(word: str) -> list[str]:
    """A word of up to PIECE characters, or all such pieces of a longer one, PIECE_STRIDE apart and the last at its end."""
    last = len(word) - PIECE
    return [word] if last <= 0 else [word[at:at + PIECE] for at in (*range(0, last, PIECE_STRIDE), last)]


def grams(word: str) -> list[int]:
    """Slots of a word's character trigrams and of its longer beginnings and ends."""
    marked = f"^{word}$"
    parts = [marked[i:i + 3] for i in range(len(marked) - 2)]
    parts += [marked[:n] for n in (4, 5, 6, 7)] + [marked[-n:] for n in (4, 5, 6)]
    return [xxhash.xxh64_intdigest(p) % GRAM_SLOTS for p in parts]


class Lexicon:
    """Words by number, with their inputs' slots; number 0 stands for no word."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.at.clear()
        self.new: list[str] = []

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if max(map(len, words), default=0) > PIECE:
            words = [p for w in words for p in pieces(w)]
        at = self.at
        try:
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        except KeyError:
            for word in words:
                if word not in at:
                    at[word] = len(at) + 1
                    self.new.append(word)
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def take_new(self) -> Inputs:
        """The inputs of the words since the last call."""
        words, self.new = self.new, []
        lists = [grams(w) for w in words]
        return Inputs(np.fromiter((xxhash.xxh64_intdigest(w) % WORD_SLOTS for w in words), np.int64, len(words)),
                      np.fromiter(map(len, lists), np.int64, len(words)), np.fromiter(chain.from_iterable(lists), np.int64))


@dataclass
class Inputs:
    """Words' own slots, and the slots of their n-grams one word after the other."""

    word: np.ndarray
    counts: np.ndarray
    flat: np.ndarray

    def take(self, at: np.ndarray) -> Inputs:
        counts = self.counts[at]
        starts = (np.cumsum(self.counts) - self.counts)[at]
        flat = self.flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        return Inputs(self.word[at], counts, flat)


def windows_of(words: np.ndarray) -> np.ndarray:
    """All windows of a text, STRIDE apart and the last at its end; zeros fill a short one."""
    n = len(words)
    if n <= WINDOW:
        return np.pad(words, (0, WINDOW - n))[None, :]
    starts = np.minimum(np.arange(0, n - WINDOW + STRIDE, STRIDE), n - WINDOW)
    return words[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, by name; a direction's input weights hold update, reset and candidate."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        size = WORD_SIZE + GRAM_SIZE
        self.p = {"word": normal(WORD_SLOTS, WORD_SIZE, scale=0.3), "gram": normal(GRAM_SLOTS, GRAM_SIZE, scale=0.5)}
        for d in "fb":
            self.p |= {f"W{d}": normal(size, 3 * HIDDEN, scale=size ** -0.5), f"U{d}": normal(HIDDEN, 2 * HIDDEN, scale=HIDDEN ** -0.5),
                       f"C{d}": normal(HIDDEN, HIDDEN, scale=HIDDEN ** -0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5), "a": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION, scale=0.5),
                   "o": normal(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}
        self.slope, self.offset = np.zeros(SUMMARY), 0.0

    def inputs(self, words: Inputs) -> np.ndarray:
        """Input vectors of words, after that of no word."""
        parts, at = [np.zeros((1, WORD_SIZE + GRAM_SIZE), np.float32)], 0
        for start in range(0, len(words.word), 20_000):
            counts = words.counts[start:start + 20_000]
            flat = words.flat[at:at + counts.sum()]
            at += len(flat)
            sums = np.add.reduceat(self.p["gram"][flat], np.cumsum(counts) - counts, axis=0)
            parts.append(np.concatenate([self.p["word"][words.word[start:start + 20_000]], sums / np.sqrt(counts)[:, None].astype(np.float32)], axis=1))
        return np.concatenate(parts)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each input adds to the gates of either direction."""
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def read(self, gates: dict[str, np.ndarray], index: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows; ``index`` (windows, WINDOW) are rows of ``gates``, row 0 being no word."""
        n, length = index.shape
        states = np.zeros((length, n, 2 * HIDDEN), np.float32)
        present = index.T > 0
        full = bool(present.all())
        for half, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            rows, U, C = gates[d], self.p[f"U{d}"], self.p[f"C{d}"]
            steps = range(length) if d == "f" else range(length - 1, -1, -1)
            kept = []
            for t in steps:
                g = rows[index[:, t]]
                zr = _sigmoid(g[:, :2 * HIDDEN] + h @ U)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                if not full:
                    z = z * present[t][:, None]
                rh = r * h
                candidate = np.tanh(g[:, 2 * HIDDEN:] + rh @ C)
                new = h + z * (candidate - h)
                if trace is not None:
                    kept.append((t, h, zr, z, r, rh, candidate))
                h = new
                states[t, :, half * HIDDEN:(half + 1) * HIDDEN] = h
            if trace is not None:
                trace[d] = kept
        hidden = np.tanh(states @ self.p["A"] + self.p["a"])
        weight = hidden @ self.p["v"]
        if not full:
            weight = np.where(present, weight, -30)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if trace is not None:
            trace.update(states=states, hidden=hidden, weight=weight, pooled=pooled, present=present)
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradients(self, gates: dict[str, np.ndarray], index: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss: by parameter (inputs aside), and by row of ``gates``, both directions side by side."""
        trace: dict = {}
        logits = self.read(gates, index, trace)
        off = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - target) / len(target)).astype(np.float32)
        states, hidden, weight, pooled, present = (trace[k] for k in ("states", "hidden", "weight", "pooled", "present"))
        grads = {"o": pooled.T @ off, "c": np.array([off.sum()])}
        to_pooled = off[:, None] * self.p["o"]
        to_states = weight[:, :, None] * to_pooled
        to_weight = np.einsum("tnh,nh->tn", states, to_pooled)
        to_weight = weight * (to_weight - (weight * to_weight).sum(axis=0))
        to_hidden = to_weight[:, :, None] * self.p["v"] * (1 - hidden ** 2)
        grads |= {"v": np.einsum("tn,tna->a", to_weight, hidden), "A": np.einsum("tnh,tna->ha", states, to_hidden), "a": to_hidden.sum(axis=(0, 1))}
        to_states += to_hidden @ self.p["A"].T
        to_gates = np.zeros((len(gates["f"]), 6 * HIDDEN), np.float32)
        for half, d in enumerate("fb"):
            U, C = self.p[f"U{d}"], self.p[f"C{d}"]
            gU, gC = np.zeros_like(U), np.zeros_like(C)
            back = np.zeros((len(target), HIDDEN), np.float32)
            for t, h, zr, z, r, rh, candidate in reversed(trace[d]):
                back = back + to_states[t, :, half * HIDDEN:(half + 1) * HIDDEN]
                to_c = back * z * (1 - candidate ** 2)
                to_rh = to_c @ C.T
                to_z = back * (candidate - h) * present[t][:, None]
                to_zr = np.concatenate([to_z, to_rh * h], axis=1) * zr * (1 - zr)
                gU += h.T @ to_zr
                gC += rh.T @ to_c
                np.add.at(to_gates[:, half * 3 * HIDDEN:(half + 1) * 3 * HIDDEN], index[:, t], np.concatenate([to_zr, to_c], axis=1))
                back = back * (1 - z) + to_rh * r + to_zr @ U.T
            grads |= {f"U{d}": gU, f"C{d}": gC}
        return grads, to_gates

    def train_step(self, adam: dict, words: Inputs, index: np.ndarray, target: np.ndarray, rng) -> None:
        """One step of Adam; ``words`` are the rows 1.. of ``index``."""
        x = self.inputs(words)
        drop = rng.random(len(x)) < WORD_DROP
        x[drop, :WORD_SIZE] = 0
        grads, to_gates = self.gradients(self.gates(x), index, target)
        to_x = np.zeros_like(x)
        for half, d in enumerate("fb"):
            part = to_gates[:, half * 3 * HIDDEN:(half + 1) * 3 * HIDDEN]
            grads |= {f"W{d}": x.T @ part, f"b{d}": part.sum(axis=0)}
            to_x += part @ self.p[f"W{d}"].T
        to_x[drop, :WORD_SIZE] = 0
        to_gram = to_x[1:, WORD_SIZE:] / np.sqrt(words.counts)[:, None]
        grads["word"] = np.stack([np.bincount(words.word, to_x[1:, k], WORD_SLOTS) for k in range(WORD_SIZE)], axis=1)
        grads["gram"] = np.stack([np.bincount(words.flat, np.repeat(to_gram[:, k], words.counts), GRAM_SLOTS) for k in range(GRAM_SIZE)], axis=1)
        adam["step"] = step = adam.get("step", 0) + 1
        for name, g in grads.items():
            g = g.astype(np.float32)
            m, v = adam.setdefault(name, (np.zeros_like(self.p[name]), np.zeros_like(self.p[name])))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[name] -= np.float32(RATE / (1 - 0.9 ** step)) * m / (np.sqrt(v / np.float32(1 - 0.999 ** step)) + np.float32(1e-7))

    def probability(self, logits: list[np.ndarray]) -> np.ndarray:
        """Of texts, by their windows' logits."""
        return 1 / (1 + np.exp(-np.clip(_summary(logits) @ self.slope + self.offset, -30, 30)))


SUMMARY = 4


def _summary(logits: list[np.ndarray]) -> np.ndarray:
    """Worst window, mean of the worst WORST, how much all windows hold, and their number."""
    out = np.zeros((len(logits), SUMMARY))
    for n, x in enumerate(logits):
        x = np.clip(x, -12, 12)
        worst = np.sort(x)[-WORST:]
        out[n] = worst[-1], worst.mean(), np.log1p(np.sum(1 / (1 + np.exp(-x)))), np.log(len(x))
    return out


def _read_all(net: Network, gates: dict[str, np.ndarray], windows: list[np.ndarray]) -> list[np.ndarray]:
    """Logits of each text's windows."""
    joined = np.concatenate(windows)
    logits = np.empty(len(joined), np.float32)
    # Windows with gaps are read apart, for the others need no mask.
    short = (joined == 0).any(axis=1)
    for some in (np.flatnonzero(~short), np.flatnonzero(short)):
        for at in range(0, len(some), BLOCK):
            logits[some[at:at + BLOCK]] = net.read(gates, joined[some[at:at + BLOCK]])
    return np.split(logits, np.cumsum([len(w) for w in windows])[:-1])


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Network:
    """A network for texts and their labels (0, 1), both in a fixed order."""
    net, rng, lexicon = Network(seed), np.random.default_rng(seed), Lexicon()
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(labels) < 12 or labels.min() == labels.max():
        net.offset = float(np.log(share / (1 - share)))
        return net
    windows = [windows_of(lexicon.of(t)) for t in texts]
    words = lexicon.take_new()
    held = rng.random(len(texts)) < 0.2
    if min(np.unique(labels[~held], return_counts=True)[1], default=0) == len(labels[~held]):
        held[:] = False
    positive, negative = (np.flatnonzero((labels == y) & ~held) for y in (1, 0))
    adam: dict = {}
    worst: dict[int, np.ndarray] = {}
    looked = negative
    for step in range(STEPS):
        if step and step % (STEPS // 4) == 0:
            gates = net.gates(net.inputs(words))
            looked = rng.choice(negative, min(WORST_NEGATIVE, len(negative)), replace=False)
            some = [*positive, *looked]
            worst = {n: np.argsort(x)[-WORST:] for n, x in zip(some, _read_all(net, gates, [windows[n] for n in some]))}
        rows, target = [], []
        for y, among in ((1, positive), (0, negative)):
            for k in range(BATCH // 2):
                hard = bool(worst) and (y == 1 or k % 2 == 0)
                n = rng.choice(looked if hard and y == 0 else among)
                rows.append(windows[n][rng.choice(worst[n]) if hard else rng.integers(len(windows[n]))])
                target.append(y)
        index = np.stack(rows)
        present, inverse = np.unique(index, return_inverse=True)
        if present[0] != 0:
            present, inverse = np.r_[0, present], inverse + 1
        net.train_step(adam, words.take(present[1:] - 1), inverse.reshape(index.shape), np.array(target, np.float32), rng)
    some = np.flatnonzero(held)
    if len(np.unique(labels[some])) < 2:
        some = np.arange(len(texts))
    gates = net.gates(net.inputs(words))
    net.slope, net.offset = _logistic(_summary(_read_all(net, gates, [windows[n] for n in some])), labels[some])
    return net


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.3] * x.shape[1] + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def score_texts(texts: Iterator[list[str]], net: Network) -> Iterator[np.ndarray]:
    """The probability of each text of each batch; all windows are read."""
    lexicon = Lexicon()
    gates, filled = {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}, 0
    for batch in texts:
        found: list[list[np.ndarray]] = [[] for _ in batch]
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal gates, filled
            new = net.gates(net.inputs(lexicon.take_new())[1 if filled else 0:])
            size = filled + len(new["f"])
            if size > len(gates["f"]):
                gates = {d: np.concatenate([gates[d][:filled], np.zeros((max(size, 20_000), 3 * HIDDEN), np.float32)]) for d in "fb"}
            for d in "fb":
                gates[d][filled:size] = new[d]
            filled = size
            for (n, _), logits in zip(waiting, _read_all(net, gates, [w for _, w in waiting])):
                found[n].append(logits)

        for n, text in enumerate(batch):
            windows = windows_of(lexicon.of(text))
            for at in range(0, len(windows), 4 * BLOCK):
                waiting.append((n, windows[at:at + 4 * BLOCK]))
                held += len(waiting[-1][1])
                if held >= 4 * BLOCK:
                    flush()
                    waiting, held = [], 0
            if len(lexicon.at) > 120_000:
                if waiting:
                    flush()
                    waiting, held = [], 0
                lexicon.clear()
                filled = 0
        if waiting:
            flush()
        yield net.probability([np.concatenate(x) for x in found]) if batch else np.zeros(0)


def is_held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels to train on, at most TRAIN_POSITIVE and TRAIN_NEGATIVE, chosen by hash."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out())
    known = keep(known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic")), "labels")
    many = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(min(1.0, TRAIN_POSITIVE / max(1, many.get(1, 0))) * (1 << 30))) \
        .otherwise(int(min(1.0, TRAIN_NEGATIVE / max(1, many.get(0, 0))) * (1 << 30)))
    short = F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS
    # The sample's labels are a bounded list, so the texts need no shuffle to meet it.
    rows = docs.where(short).join(F.broadcast(known.where(draw < limit)), "doc_id") \
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic").orderBy("doc_id").toArrow()
    return rows.column("text").to_pylist(), rows.column("toxic").to_numpy().astype(np.float64)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic (0 or 1). A null text is empty; a text
    without words is one window without words. Repeated rows are scored alike;
    a label of a null or unknown doc_id is not used, and of several labels of a
    doc_id the smallest is. Without labels of both kinds the score is their share.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = fit(*_sample(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []

        def texts() -> Iterator[list[str]]:
            for batch in batches:
                ids.append(batch.column(0))
                yield [t or "" for t in batch.column(1).to_pylist()]

        for scores in score_texts(texts(), net):
            yield pa.RecordBatch.from_arrays([ids.pop(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
