"""Quality by supervised subword embeddings.

Every word, every pair of neighbouring words, every character 3- to 5-gram of a word (with its ends
marked by the space beside it) has a learned vector, found by hashing; so has, beyond the usual
features of such models, every skip-gram of characters over two neighbouring words (the first one,
two and three bytes of each): a text that repeats one word has the n-grams of a good one, and only
what stands beside what tells them apart. A text is the average of its vectors, and a softmax layer
reads it. Vectors and layer are trained together by stochastic gradient descent in numpy on at most
`sample_rows` labelled texts of at most `sample_bytes` in all. The learning rate is the one of RATES
with the least loss on a fifth of that same sample, after training on the other four fifths.
As averaging and the layer are linear, a trained model needs one number for each hash bucket: how
far its vector moves the log odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.llm.bpe import _field, _with
from posegrid.llm.labelled import labelled_sample
from posegrid.session import ship

SAMPLE_ROWS, SAMPLE_BYTES, BITS, DIM, EPOCHS = 4_000, 64 << 20, 16, 8, 6
RATES = (0.3, 1.0, 3.0)
_MIX = (K.mix64(np.arange(5 * 256, dtype=np.uint64) + np.uint64(991)) >> np.uint64(32)).astype(np.uint32).reshape(5, 256)
_SPACE = ~K._WORD


def buckets(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every feature of some texts, kind by kind."""
    starts, ends, row = K.split_words(data, offs)
    top = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int32)
    if len(starts):
        h = K.word_hashes(data, starts, ends)
        yield top(h), row
        pair = np.flatnonzero(row[1:] == row[:-1])
        yield top(K.mix64(h[pair] * K.MULT + h[pair + 1])), row[pair]
        head = np.zeros(len(starts), np.uint64)
        for n in range(3):  # the first n + 1 bytes of each word, zeros behind a shorter one
            more = data[np.minimum(starts + n, len(data) - 1)].astype(np.uint64)
            head = head << np.uint64(8) | np.where(starts + n < ends, more, np.uint64(0))
            yield top(K.mix64(head[pair] * K.MULT + (head[pair + 1] << np.uint64(2)) + np.uint64(n))), row[pair]
    if not len(data):
        return
    space = _SPACE[data]
    spaces = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    place = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    mix = _MIX[0][data[: len(data) - 2]] ^ _MIX[1][data[1 : len(data) - 1]] if len(data) > 2 else data[:0].astype(np.uint32)
    for n in (3, 4, 5):
        m = len(data) - n + 1
        if m <= 0:
            return
        mix = mix[:m] ^ _MIX[n - 1][data[n - 1 :]]
        # within one text, no space but at its ends, and a word byte in it
        good = (spaces[n - 1 : n - 1 + m] == spaces[1 : m + 1]) & (place[:m] == place[n - 1 :])
        k = np.flatnonzero(good)
        yield ((mix[k] * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int32), place[k]


class Model:
    """bias and shift: log odds of label 1 for no feature, and what each bucket adds."""

    def __init__(self, texts: list[bytes], y: np.ndarray, seed: int = 1, rates: tuple[float, ...] = RATES):
        self.bias, self.shift, self.rate = 0.0, np.zeros(1 << BITS, np.float32), rates[0]
        n1 = float((y > 0).sum())
        if not 0 < n1 < len(y):
            self.bias = float(np.log((n1 + 1) / (len(y) - n1 + 1)))
            return
        rows = []
        for t in texts:
            found = list(buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
            ids, counts = np.unique(np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int32), return_counts=True)
            rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
        aside = np.arange(len(y)) % 5 == 4
        if len(rates) > 1 and aside.any():
            self.rate = min(rates, key=lambda rate: self._loss(rows, y, aside, *self._trained(rows, y, ~aside, rate, seed)))
        self.bias, self.shift = self._trained(rows, y, np.ones(len(y), bool), self.rate, seed)

    @staticmethod
    def _loss(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, at: np.ndarray, bias: float, shift: np.ndarray) -> float:
        """Mean log loss over the rows in at."""
        odds = np.array([bias + w @ shift[ids] for ids, w in (rows[k] for k in np.flatnonzero(at))])
        return float(np.logaddexp(0, np.where(y[at] > 0, -odds, odds)).mean())

    @staticmethod
    def _trained(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, at: np.ndarray, top_rate: float, seed: int) -> tuple[float, np.ndarray]:
        """bias and shift after EPOCHS rounds over the rows in at; the rate falls to 0 from top_rate."""
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        at = np.flatnonzero(at)
        steps, step = EPOCHS * len(at), 0
        for _ in range(EPOCHS):
            for k in at[rng.permutation(len(at))].tolist():
                ids, w = rows[k]
                mean = w @ vectors[ids]
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[int(y[k] > 0)] -= 1  # gradient of the loss by z
                rate = np.float32(top_rate * (1 - step / steps))
                back = layer @ p
                layer -= rate * np.outer(mean, p).astype(np.float32)
                bias -= rate * np.float32(0.1) * p
                # a mean has small weights: a row's step is scaled up by its number of features' share
                vectors[ids] -= (rate * 20 * w)[:, None] * back[None, :]
                step += 1
        return float(bias[1] - bias[0]), (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        total, count = np.zeros(n), np.zeros(n)
        for bucket, row in buckets(data, offs):
            total += np.bincount(row, self.shift[bucket], n)
            count += np.bincount(row, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -40, 40)))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on the whole texts of at most sample_rows labelled rows outside the held-out fifth, in
    the order of a hash of the id (rows of one id by text): a text that would exceed sample_bytes is
    passed over. The held-out rows have no part in the choice of the rate.
    With no labelled rows, or rows of one class only, every score is the smoothed share of label 1."""
    ship(docs.sparkSession)
    texts, y, size = [], [], 0
    for r in labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col).orderBy(F.xxhash64("id"), "id", "text").toLocalIterator():
        text = r.text.encode()
        if size + len(text) > sample_bytes:
            continue
        size += len(text)
        texts.append(text)
        y.append(r.label)
    return Model(texts, np.array(y))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows of docs with out_col, the probability of label 1 for the whole text. Null texts
    are read as empty, which have the bias alone; a column called out_col is replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, text=text_col):
            yield from _with(part, out_col, pa.array(shared.value.score(*K.bytes_of(part[text_col])))).combine_chunks().to_batches()

    return docs.mapInArrow(run, _field(docs, out_col, "double"))
