"""Quality classifier: a byte-level convolutional network in numpy.

Each byte becomes a vector; learned filters run over windows of bytes; their outputs are
max-pooled over overlapping chunks that cover the whole text; over a text's chunks the largest and
the mean output of each filter go into one probability. Fitted on the driver on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, residue, texts_of
from .labelled import training_rows

#: Labelled rows that the network is fitted on, at most; their texts are used whole.
TRAIN_ROWS = 2500
FOLD, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: A window has WIDTH bytes, every STRIDE bytes. A chunk has 2 * BLOCK windows and overlaps the next one by half.
WIDTH, STRIDE, BLOCK, FILTERS = 12, 2, 64, 20
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 32, 0.01, 1e-4, 7
#: Bytes that are convolved at once.
PIECE = 1 << 19


def _byte_vectors() -> np.ndarray:
    """Fixed: what kind of character a byte belongs to, and three random numbers that tell bytes of a kind apart."""
    e = np.zeros((256, 12), np.float32)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,", b"!?", b"aeiouAEIOU")):
        e[list(chars), k] = 1
    e[128:, 0] = e[128:, 8] = 1
    e[:128, 9] = 1 - e[:128, :7].sum(1).clip(0, 1)
    e[:, 10:] = np.random.default_rng(SEED).normal(0, 0.7, (256, 2))
    e[0] = 0
    return e


VECTORS = _byte_vectors()
_DIM = VECTORS.shape[1] * STRIDE
_PARTS = WIDTH // STRIDE


def pairs_of(text: bytes) -> np.ndarray:
    """Vectors of each STRIDE bytes, padded by zero bytes so that the last window starts at the text's last bytes; one window at least."""
    n = max(1, -(-len(text) // STRIDE)) + _PARTS - 1
    raw = np.zeros(n * STRIDE, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return VECTORS[raw].reshape(n, _DIM)


def windows_at(text: bytes, spots: np.ndarray) -> list[np.ndarray]:
    """The vectors of each STRIDE bytes of the windows at spots, as in pairs_of."""
    raw = np.frombuffer(text, np.uint8)
    at = spots[:, None] * STRIDE + np.arange(WIDTH)
    found = np.where(at < raw.size, raw[np.minimum(at, max(0, raw.size - 1))] if raw.size else 0, 0)
    return [VECTORS[found[:, j * STRIDE : (j + 1) * STRIDE]].reshape(spots.size, _DIM) for j in range(_PARTS)]


class Network:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(0, (2 / (_DIM * _PARTS)) ** 0.5, (_PARTS, _DIM, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.constant: float | None = None

    def outputs(self, pairs: np.ndarray) -> np.ndarray:
        """Each window's output of each filter."""
        n = pairs.shape[0] - _PARTS + 1
        z = pairs[:n] @ self.w[0]
        for j in range(1, _PARTS):
            z += pairs[j : j + n] @ self.w[j]
        return z + self.b

    def blocks(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, FILTERS): the largest output in each block of windows, and the window that has it; by pieces, so that long texts take bounded memory."""
        size, overlap = PIECE // (STRIDE * BLOCK) * (STRIDE * BLOCK), WIDTH - STRIDE
        tops, spots = [], []
        for lo in range(0, max(1, len(text)), size):
            last = lo + size >= len(text)
            p = pairs_of(text[lo : lo + size + overlap])
            z = self.outputs(p if last else p[: size // STRIDE + _PARTS - 1])
            n = -(-z.shape[0] // BLOCK)
            whole = z.shape[0] // BLOCK
            best = np.empty((n, FILTERS), np.int64)
            best[:whole] = z[: whole * BLOCK].reshape(whole, BLOCK, FILTERS).argmax(1)
            if whole < n:
                best[whole:] = z[whole * BLOCK :].argmax(0)
            best += np.arange(0, n * BLOCK, BLOCK)[:, None]
            tops.append(np.take_along_axis(z, best, 0))
            spots.append(best + lo // STRIDE)
        return np.concatenate(tops), np.concatenate(spots)

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS): the largest output in each chunk, and its window."""
        top, best = self.blocks(text)
        if top.shape[0] < 2:
            return top, best
        later = top[1:] > top[:-1]
        return np.maximum(top[1:], top[:-1]), np.where(later, best[1:], best[:-1])

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        m = np.maximum(self.pooled(text)[0], 0)
        x = np.concatenate([m.max(0), m.mean(0)])
        return float(1 / (1 + np.exp(-np.clip(x @ self.v + self.c[0], -30, 30))))

    def fit(self, texts: list[bytes], y: np.ndarray) -> "Network":
        """Adam on the cross entropy. A window's gradient reaches only the filters for which it is its chunk's largest. With no rows or one class the score is the mean label, or 0.5."""
        if y.size == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if y.size else 0.5
            return self
        rng = np.random.default_rng(SEED)
        params = [self.w, self.b, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.c[0] = np.log(y.mean() / (1 - y.mean()))
        filters, step = np.arange(FILTERS), 0
        steps = EPOCHS * -(-y.size // BATCH)
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(y.size), -(-y.size // BATCH)):
                grads = [np.zeros_like(p) for p in params]
                for r in rows:
                    top, best = self.pooled(texts[r])
                    act = np.maximum(top, 0)
                    k = act.argmax(0)
                    x = np.concatenate([act[k, filters], act.mean(0)])
                    p = 1 / (1 + np.exp(-np.clip(x @ self.v + self.c[0], -30, 30)))
                    d = np.float32((p - y[r]) / rows.size)
                    grads[2] += d * x
                    grads[3][0] += d
                    g = np.broadcast_to(d * self.v[FILTERS:] / act.shape[0], act.shape).copy()
                    g[k, filters] += d * self.v[:FILTERS]
                    g *= top > 0
                    grads[1] += g.sum(0)
                    # windows that are the best of some filter, once each
                    spots, where = np.unique(best, return_inverse=True)
                    dense = np.zeros((spots.size, FILTERS), np.float32)
                    np.add.at(dense, (where.reshape(best.shape), np.broadcast_to(filters, best.shape)), g)
                    for j, pairs in enumerate(windows_at(texts[r], spots)):
                        grads[0][j] += pairs.T @ dense
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for q, (p, gr) in enumerate(zip(params, grads)):
                    if q in (0, 2):
                        gr += DECAY * p
                    first[q] = 0.9 * first[q] + 0.1 * gr
                    second[q] = 0.99 * second[q] + 0.01 * gr * gr
                    p -= rate * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-7)
        return self


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """A network for labels(doc_id, quality). The driver gathers the whole texts of rows documents at most; a null text is an empty one."""
    sample = training_rows(docs, labels, "quality", FOLD, HELD_OUT, rows)
    got = sample.select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return Network().fit(got["text"].to_pylist(), got["label"].to_numpy().astype(np.float32))


def score_quality(docs: DataFrame, network: Network, column: str = "quality_score") -> DataFrame:
    """docs with one more column, the probability that a text is good. Other columns stay as they are; where docs has one of that name the new one has an underscore more.

    A null text is an empty one and has a score too; texts of any length are scored whole, by
    pieces; rows that repeat come back as often; no rows give no rows.
    """
    column = fresh(column, docs.columns)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = pa.array([network.score(t) for t in texts_of(b.column("text"))], pa.float64())
            return pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, column])

        return run

    return by_batch(docs, make, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{column}` double"]))


def classify_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; a null id counts as the empty text in the fold; rows as in score_quality. Without labels of both classes every score is the mean label, or 0.5 without any. Other columns are not looked at."""
    scored = score_quality(docs.select("doc_id", "text"), fit(docs, labels, rows), "score")
    return scored.select("doc_id", (residue(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of docs that the network doesn't reject, with the columns of docs; rows as in score_quality."""
    column = fresh("quality_score", docs.columns)
    return score_quality(docs, network).filter(F.col(column) >= THRESHOLD).drop(column)
