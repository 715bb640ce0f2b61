"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of two inputs projected for each direction: the embedding of the word (if the training sample
has it often enough) and the embeddings of its character 3- to 5-grams. A word of over PIECE characters, as texts without
blanks have, enters as overlapping pieces, each like a word. Two GRUs read a window of WINDOW words, attention
pools their states, and a logistic unit scores the window. All overlapping windows of a text are scored; the document
has the score of its worst one. Windows of training documents are chosen by the model itself: the worst window of a
document carries its label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, small_batches, table, utf8, with_schema
from .words import split_words

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 12, 1 << 16
GRAM_SIZES = (3, 4, 5)
#: A word gets an embedding of its own if so many documents of the sample have it.
MIN_DOCS = 8
#: Labelled rows to train on at most, and bytes of their texts: those with the least hash of their id.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE, WORD_DROP, GRAM_DROP, DECAY = 6, 128, 0.01, 0.5, 0.3, 3e-4
#: A text labelled 1 weighs p ** DOUBT in the loss's gradient, p being its present score (the generalized cross entropy of Zhang
#: and Sabuncu), against noisy labels. 0, plain cross entropy, had the best mean AUC over three inner folds of the training
#: rows (0.975; 0.25: 0.973, 0.5: 0.972).
DOUBT = 0.0
#: A small sample is seen in smaller batches and more epochs, so often that at least so many steps are made.
LEAST_BATCH, LEAST_STEPS = 32, 250
#: Shares of the epochs after which the worst windows of the training texts are chosen anew.
CHOOSE_AFTER = (0.34, 0.67)
#: Weight of the corpus rate, as so many documents, in the log-odds that choose the first windows.
SMOOTHING = 2.0
THRESHOLD = 0.3
#: Windows computed together; words looked up together; distinct words that a worker keeps projected, and projects together.
SCORE_BATCH, CHUNK_WORDS, CACHE_WORDS, PROJECT_WORDS = 2048, 1 << 16, 200_000, 4096
#: Characters of a time step at most, and those that neighbouring pieces of a longer word share.
PIECE, PIECE_OVERLAP = 64, 16
SEED = 7


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words' characters between < and >, word after word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = (b"<" + b"><".join(words) + b">").decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(codes == ord(">"))
    lengths = np.diff(ends, prepend=-1)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters of the word behind each one
    found, valid = np.zeros((len(codes), len(GRAM_SIZES)), np.int64), np.zeros((len(codes), len(GRAM_SIZES)), bool)
    h = codes.copy()
    for n in range(2, max(GRAM_SIZES) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAM_SIZES:
            mixed = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
            column = GRAM_SIZES.index(n)
            found[: len(h), column] = (mixed >> np.uint64(32)).astype(np.int64) % CHAR_BUCKETS
            valid[: len(h), column] = left[: len(h)] >= n - 1
    counts = np.add.reduceat(valid.sum(axis=1), ends - lengths + 1)
    return found[valid], counts


def time_steps(text: bytes) -> list[bytes]:
    """The words of a text; one of over PIECE characters as overlapping pieces, so that no 3-gram falls between two."""
    words = split_words(text)
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) <= PIECE or len(letters := word.decode("utf-8", "replace")) <= PIECE:
            out.append(word)
        else:
            out += [letters[i : i + PIECE].encode() for i in range(0, len(letters) - PIECE_OVERLAP, PIECE - PIECE_OVERLAP)]
    return out


def windows_of(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; the last ends with the text."""
    if n <= window:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - window, stride)
    return np.append(starts, n - window)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def by_gate(rows: np.ndarray) -> list[np.ndarray]:
    """Projected rows parted into those of both gates and of the new state, forth and back."""
    h = HIDDEN
    return [np.ascontiguousarray(rows[:, a:b]) for a, b in ((0, 2 * h), (2 * h, 3 * h), (3 * h, 5 * h), (5 * h, 6 * h))]


@dataclass
class Network:
    """Parameters p by name. Inputs of a window are rows of projected words, (time, batch, 6 * HIDDEN)."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], seed: int = SEED) -> "Network":
        r, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        return cls(vocabulary, {
            "word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.05),
            "in_word": normal(WORD_DIM, 6 * h, scale=0.5), "in_char": normal(CHAR_DIM, 6 * h, scale=0.5), "in_bias": np.zeros(6 * h, np.float32),
            "forth": normal(h, 3 * h, scale=0.3), "back": normal(h, 3 * h, scale=0.3),
            "attend": normal(2 * h, scale=0.3), "weigh": normal(2 * h, scale=0.3), "bias": np.full(1, -2.0, np.float32),
        })

    def project(self, words: list[bytes]) -> np.ndarray:
        """Input rows of distinct words."""
        rows = np.zeros((len(words), 6 * HIDDEN), np.float32)
        for at in range(0, len(words), PROJECT_WORDS):
            some = words[at : at + PROJECT_WORDS]
            ids = np.array([self.vocabulary.get(w, 0) for w in some], np.int64)
            flat, counts = char_grams(some)
            chars = np.add.reduceat(self.p["char"][flat], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts).astype(np.float32)[:, None]
            own = self.p["word"][ids] * (ids > 0).astype(np.float32)[:, None]
            rows[at : at + len(some)] = own @ self.p["in_word"] + chars @ self.p["in_char"] + self.p["in_bias"]
        return rows

    def logits(self, rows: list[np.ndarray], index: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Logits of windows: index (batch, time) into projected rows, as `by_gate` parts them; mask (batch, time) is 0
        behind a short text."""
        batch, time = index.shape
        columns = np.ascontiguousarray(index.T)
        attend, weigh = np.zeros((time, batch), np.float32), np.zeros((time, batch), np.float32)
        for side, (name, order) in enumerate((("forth", range(time)), ("back", range(time - 1, -1, -1)))):
            u = self.p[name]
            gates, fresh = rows[2 * side], rows[2 * side + 1]
            u_gates, u_fresh = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            a, w = self.p["attend"][side * HIDDEN : (side + 1) * HIDDEN], self.p["weigh"][side * HIDDEN : (side + 1) * HIDDEN]
            aw = np.stack([a, w], axis=1)
            h = np.zeros((batch, HIDDEN), np.float32)
            zr, n, x = (np.empty((batch, k * HIDDEN), np.float32) for k in (2, 1, 1))
            for t in order:
                at = columns[t]
                zr = gates.take(at, axis=0)
                zr += h @ u_gates
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                np.matmul(h, u_fresh, out=n)
                n *= zr[:, HIDDEN:]
                n += fresh.take(at, axis=0)
                np.tanh(n, out=n)
                np.subtract(h, n, out=x)
                x *= zr[:, :HIDDEN]
                x += n
                if mask is None:
                    h, x = x, h
                else:
                    h = np.where(mask[:, t : t + 1] > 0, x, h)
                s = h @ aw
                attend[t] += s[:, 0]
                weigh[t] += s[:, 1]
        if mask is not None:
            attend = np.where(mask.T > 0, attend, -1e9)
        share = np.exp(attend - attend.max(axis=0))
        if mask is not None:
            share = share * mask.T
        total = share.sum(axis=0)
        return (share * weigh).sum(axis=0) / np.maximum(total, 1e-9) + self.p["bias"][0]


def _gradients(net: Network, words: np.ndarray, grams: np.ndarray, counts: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, keep: np.ndarray, doubt: float) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of one batch. words: ids of the batch's distinct words; grams: their 3- to 5-grams, counts of
    them a word; index (batch, time) into the words; keep: 0 where a word's own embedding is left out this time."""
    p, h = net.p, HIDDEN
    own = p["word"][words] * keep[:, None]
    root = np.sqrt(np.maximum(counts, 1)).astype(rows_type := p["char"].dtype)[:, None]
    owner = np.repeat(np.arange(len(counts)), counts)
    chars = _sum_by(owner, p["char"][grams], len(counts)) / root
    rows = own @ p["in_word"] + chars @ p["in_char"] + p["in_bias"]
    batch, time = index.shape
    turned = lambda forth, back: np.stack([forth, back[::-1]], axis=1)  # noqa: E731  the back side runs from the end
    x = rows[index.T]
    x, m = turned(x[:, :, : 3 * h], x[:, :, 3 * h :]), turned(mask.T[:, :, None], mask.T[:, :, None])
    u = np.stack([p["forth"], p["back"]])
    state, saved, states = np.zeros((2, batch, h), rows_type), [], np.zeros((time, 2, batch, h), rows_type)
    for t in range(time):
        g = state @ u
        zr = _sigmoid(x[t, :, :, : 2 * h] + g[:, :, : 2 * h])
        n = np.tanh(x[t, :, :, 2 * h :] + zr[:, :, h:] * g[:, :, 2 * h :])
        saved.append((state, zr, n, g[:, :, 2 * h :]))
        state = state + m[t] * (1 - zr[:, :, :h]) * (n - state)
        states[t] = state
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    attend = np.where(mask.T > 0, both @ p["attend"], -1e9)
    share = np.exp(attend - attend.max(axis=0)) * mask.T
    share /= np.maximum(share.sum(axis=0), 1e-9)
    value = both @ p["weigh"]
    logit = (share * value).sum(axis=0) + p["bias"][0]
    prob = _sigmoid(logit)
    of_ones = (1 - prob**doubt) / doubt if doubt else -np.log(prob + 1e-7)
    loss = float(np.mean(y * of_ones - (1 - y) * np.log(1 - prob + 1e-7)))
    d = ((prob - y) * np.where(y > 0, prob**doubt, 1) / batch).astype(rows_type)
    pooled = (share * value).sum(axis=0)
    d_value, d_attend = share * d, share * (value - pooled) * d
    grad = {"bias": np.array([d.sum()]), "weigh": np.einsum("tbk,tb->k", both, d_value), "attend": np.einsum("tbk,tb->k", both, d_attend)}
    d_both = d_value[:, :, None] * p["weigh"] + d_attend[:, :, None] * p["attend"]
    d_states = turned(d_both[:, :, :h], d_both[:, :, h:])
    d_u, d_state, d_x = np.zeros_like(u), np.zeros((2, batch, h), rows_type), np.zeros((time, 2, batch, 3 * h), rows_type)
    u_back = u.transpose(0, 2, 1)
    for t in reversed(range(time)):
        before, zr, n, gn = saved[t]
        z, r = zr[:, :, :h], zr[:, :, h:]
        d_state = d_state + d_states[t]
        d_new = d_state * m[t]
        d_n = d_new * (1 - z) * (1 - n * n)
        d_x[t] = np.concatenate([d_new * (before - n) * z * (1 - z), d_n * gn * r * (1 - r), d_n], axis=2)
        d_g = np.concatenate([d_x[t, :, :, : 2 * h], d_n * r], axis=2)
        d_u += before.transpose(0, 2, 1) @ d_g
        d_state = d_state * (1 - m[t]) + d_new * z + d_g @ u_back
    grad["forth"], grad["back"] = d_u
    d_rows = _sum_by(index.T.ravel(), np.concatenate([d_x[:, 0], d_x[::-1, 1]], axis=2).reshape(-1, 6 * h), len(rows))
    grad["in_bias"] = d_rows.sum(axis=0)
    grad["in_word"], grad["in_char"] = own.T @ d_rows, chars.T @ d_rows
    d_own = (d_rows @ p["in_word"].T) * keep[:, None]
    d_chars = (d_rows @ p["in_char"].T) / root
    grad["word"] = _sum_rows(words[words > 0], d_own[words > 0])
    grad["char"] = _sum_rows(grams, d_chars[owner])
    return loss, grad


def _sum_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows of values."""
    order = np.argsort(index, kind="stable")
    places, starts = np.unique(index[order], return_index=True)
    return places, np.add.reduceat(values[order], starts, axis=0) if len(index) else values


def _sum_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by index."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    places, sums = _sum_rows(index, values)
    out[places] = sums
    return out


class _Adam:
    """Adam; of embeddings only the rows that a batch has are moved."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict[str, np.ndarray], grad: dict) -> None:
        self.step += 1
        norm = sum(float(np.square(g[1] if isinstance(g, tuple) else g).sum()) for g in grad.values()) ** 0.5
        for k, g in grad.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g / max(1.0, norm) + DECAY * p[k][at]
            m = self.m[k][at] + 0.1 * (g - self.m[k][at])
            v = self.v[k][at] + 0.002 * (g * g - self.v[k][at])
            self.m[k][at], self.v[k][at] = m, v
            p[k][at] -= (self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.998**self.step)) + 1e-8)).astype(np.float32)


def _log_odds(docs_with: np.ndarray, ones_with: np.ndarray, rate: float) -> np.ndarray:
    """Log-odds of label 1, above those of the sample, of features that MIN_DOCS documents have; else 0."""
    ones, zeros = ones_with + rate * SMOOTHING, docs_with - ones_with + (1 - rate) * SMOOTHING
    return np.where(docs_with >= MIN_DOCS, np.log(ones / zeros) - np.log(rate / (1 - rate)), 0.0)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network from texts (UTF-8) and labels 0 or 1. Without rows it scores every text alike."""
    split = [time_steps(t) for t in texts]
    y = np.array(labels, np.float32)
    every = sorted({w for words in split for w in words})
    place = {w: i for i, w in enumerate(every)}
    coded = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in split]
    distinct_of = [np.unique(c) for c in coded]
    with_word = np.bincount(np.concatenate(distinct_of), minlength=len(every)) if every else np.zeros(0)
    vocabulary = {every[w]: i + 1 for i, w in enumerate(np.flatnonzero(with_word >= MIN_DOCS))}
    net = Network.new(vocabulary, seed)
    if not every:
        return net
    ids = np.array([vocabulary.get(w, 0) for w in every], np.int64)
    parts = [char_grams(every[at : at + PROJECT_WORDS]) for at in range(0, len(every), PROJECT_WORDS)]
    grams, counts = np.concatenate([x[0] for x in parts]).astype(np.int32), np.concatenate([x[1] for x in parts])
    first = np.cumsum(counts) - counts

    def grams_of(words: np.ndarray) -> np.ndarray:
        own = counts[words]
        return grams[np.repeat(first[words] - (np.cumsum(own) - own), own) + np.arange(own.sum())]

    worst = _first_windows(coded, distinct_of, y, grams_of, counts, len(every))
    r, adam = np.random.default_rng(seed), _Adam(net.p, RATE)

    def words_of(doc: int, window: int) -> np.ndarray:
        start = windows_of(len(coded[doc]))[window]
        return coded[doc][start : start + WINDOW]

    batch_size = min(BATCH, max(LEAST_BATCH, len(coded) // 16))
    epochs = max(epochs, -(-LEAST_STEPS * batch_size // (2 * len(coded))))
    choose = {max(1, round(share * epochs)) for share in CHOOSE_AFTER}
    doubt = 0.0
    for epoch in range(epochs):
        adam.rate = RATE * (1 - 0.9 * epoch / max(1, epochs - 1))
        picked = [(d, worst[d]) for d in range(len(coded)) if len(coded[d])]
        picked += [(d, int(r.integers(len(windows_of(len(coded[d])))))) for d in range(len(coded)) if len(coded[d]) and not y[d]]
        order = r.permutation(len(picked))
        for at in range(0, len(order), batch_size):
            some = [picked[i] for i in order[at : at + batch_size]]
            index, mask = _padded([words_of(*x) for x in some])
            distinct, inverse = np.unique(index, return_inverse=True)
            keep = ((ids[distinct] > 0) & (r.random(len(distinct)) >= WORD_DROP)).astype(np.float32)
            own = grams_of(distinct)
            stay = r.random(len(own)) >= GRAM_DROP
            left = np.add.reduceat(stay.astype(np.int64), np.cumsum(counts[distinct]) - counts[distinct])
            _, grad = _gradients(net, ids[distinct], own[stay], left, inverse.reshape(index.shape), mask, y[[d for d, _ in some]], keep, doubt)
            adam.update(net.p, grad)
        if epoch + 1 in choose and epoch + 1 < epochs:
            worst, doubt = Scorer(net).worst(split)[1], DOUBT
    return net


def _first_windows(coded: list[np.ndarray], distinct_of: list[np.ndarray], y: np.ndarray, grams_of, counts: np.ndarray, n_words: int) -> list[int]:
    """For each text the window around the word that has, itself or in a gram, the largest log-odds."""
    with_word, ones_word = np.zeros(n_words), np.zeros(n_words)
    with_gram, ones_gram = np.zeros(CHAR_BUCKETS), np.zeros(CHAR_BUCKETS)
    for words, label in zip(distinct_of, y):
        own = np.unique(grams_of(words))
        with_word[words] += 1
        with_gram[own] += 1
        if label:
            ones_word[words] += 1
            ones_gram[own] += 1
    rate = float(y.sum() + 1) / (len(y) + 2)
    odds, gram_odds = _log_odds(with_word, ones_word, rate), _log_odds(with_gram, ones_gram, rate)
    every = np.arange(n_words)
    for at in range(0, n_words, PROJECT_WORDS):
        some = every[at : at + PROJECT_WORDS]
        best = np.maximum.reduceat(gram_odds[grams_of(some)], np.cumsum(counts[some]) - counts[some])
        odds[some] = np.maximum(odds[some], best)
    chosen = []
    for words in coded:
        starts = windows_of(len(words))
        at = int(np.argmax(odds[words])) if len(words) else 0
        chosen.append(int(np.searchsorted(starts, max(0, min(at - WINDOW // 2, starts[-1])), side="left")))
    return chosen


class Scorer:
    """Scores texts window by window; projected words are kept in a bounded cache."""

    def __init__(self, net: Network):
        self.net = net
        self.places: dict[bytes, int] = {}
        self.rows = by_gate(np.zeros((1 << 12, 6 * HIDDEN), np.float32))

    def _index(self, words: list[bytes]) -> np.ndarray:
        missing = set(words).difference(self.places)
        if missing:
            if len(self.places) + len(missing) > CACHE_WORDS:
                self.places.clear()
                missing = set(words)
            new, n = sorted(missing), len(self.places)
            while len(self.rows[0]) < n + len(new):
                self.rows = [np.concatenate([x, np.zeros_like(x)]) for x in self.rows]
            for held, made in zip(self.rows, by_gate(self.net.project(new))):
                held[n : n + len(new)] = made
            self.places.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def texts(self, texts: list[list[bytes]]) -> np.ndarray:
        """Scores of texts as words: windows of many texts are computed together, none is left out."""
        return _sigmoid(self.worst(texts)[0])

    def worst(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
        """The largest logit of each text and the number of its window; without words that of no evidence, and 0."""
        best, where = np.full(len(texts), -np.inf), [0] * len(texts)
        held: list[tuple] = []  # words, text, number of the first window, places of the windows
        n = 0

        def flush() -> None:
            coded = self._index([w for words, *_ in held for w in words])
            cuts = np.cumsum([len(words) for words, *_ in held])
            parts = [(own, *x[1:]) for own, x in zip(np.split(coded, cuts[:-1]), held)]
            for short in (False, True):
                group = [x for x in parts if (len(x[0]) < WINDOW) == short]
                if not group:
                    continue
                index, mask = _padded([x[0] for x in group]) if short else (np.concatenate([_views(own, at - at[0]) for own, _, _, at in group]), None)
                found = np.concatenate([self.net.logits(self.rows, index[i : i + SCORE_BATCH], mask if mask is None else mask[i : i + SCORE_BATCH]) for i in range(0, len(index), SCORE_BATCH)])
                start = 0
                for _, text, first, at in group:
                    own = found[start : start + len(at)]
                    start += len(at)
                    top = int(np.argmax(own))
                    if own[top] > best[text]:
                        best[text], where[text] = own[top], first + top
            held.clear()

        for i, words in enumerate(texts):
            starts = windows_of(len(words)) if words else []
            for first in range(0, len(starts), CHUNK_WORDS // STRIDE):
                at = starts[first : first + CHUNK_WORDS // STRIDE]
                held.append((words[at[0] : at[-1] + WINDOW], i, first, at))
                n += len(held[-1][0])
                if n >= CHUNK_WORDS:
                    flush()
                    n = 0
        if held:
            flush()
        return np.where(np.isneginf(best), self.net.p["bias"][0], best), where


def _views(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(words, WINDOW)[starts]


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of at most WINDOW words as one window each, and its mask."""
    index, mask = np.zeros((len(texts), WINDOW), np.int64), np.zeros((len(texts), WINDOW), np.float32)
    for k, own in enumerate(texts):
        index[k, : len(own)], mask[k, : len(own)] = own, 1
    return index, mask


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Texts and toxic labels of at most `rows` labelled documents with `size` bytes of text, none held out, by the least hash of their
    id; a text that would pass the bound is left out. Of several labels or texts of one id the greatest counts; null ids,
    labels and documents without a row are left out."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = with_schema(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    joined, path = materialize(joined, "training-sample")
    kept, total = [], 0
    for r in joined.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r["n"] <= size:
            kept.append((r["doc_id"],))
            total += r["n"]
    few = docs.sparkSession.createDataFrame(kept, "doc_id long")
    found = sorted(joined.join(F.broadcast(few), "doc_id").collect(), key=lambda r: r["doc_id"])
    drop_path(docs.sparkSession, path)
    return [(r["text"].encode(), int(r["toxic"])) for r in found]


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); a text without words has the score of no
    evidence."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.texts([time_steps(t) for t in utf8(batch, "text")]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = with_schema(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, repeated rows and null ids included; null, empty and
    blank texts have the score of no evidence, long ones that of their worst window; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    sample = training_sample(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, train([t for t, _ in sample], [y for _, y in sample]))
