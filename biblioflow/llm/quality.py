"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import spans, text_chunks, word_hashes

#: At most so many labelled rows are learned from, those of smallest hash; all others only need a score.
TRAIN_ROWS = 20_000
FEATURES = (
    "log_words", "log_bytes", "mean_word", "long_word", "upper", "digit", "symbol", "other_ascii_mark", "comma_stop", "exclaim", "pipe", "non_ascii",
    "line_breaks", "same_as_last", "distinct_words", "distinct_pairs", "top_byte", "edge_marks",
)

_CLASS = np.zeros(256, np.uint8)  # 0: lower letters, space and the rest
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~+=<>", b"-_/\\:;\"'()[]{}`", b".,", b"!?", b"|", bytes(range(128, 256)), b"\n"), 1):
    _CLASS[list(_set)] = _k


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text of a chunk; all are shares or logarithms, so that length alone doesn't move them."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, rows = spans(data, offsets)
    words = np.diff(rows)
    row = np.repeat(np.arange(n), words)
    at_least = lambda x: np.maximum(x, 1)
    total = lambda values: np.bincount(row, values, n)
    byte_row = np.repeat(np.arange(n), size)
    kinds = np.bincount(byte_row * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10)
    length = (ends - starts).astype(float)
    h = word_hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, of))
        k, r = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n)

    pair = (h[1:] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-1])[row[1:] == row[:-1]]
    pair_row = row[1:][row[1:] == row[:-1]]
    last = _CLASS[data[ends - 1]]
    counts = np.zeros((n, 256), np.int32)
    for i in range(n):
        counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    counts[:, [32, 101]] = 0
    k = kinds / at_least(size)[:, None]
    return np.stack(
        [
            np.log1p(words), np.log1p(size), total(length) / at_least(words), total(length > 14) / at_least(words),
            *(k[:, i] for i in range(1, 9)),
            k[:, 9], total(same) / at_least(words), distinct(h, row) / at_least(words), distinct(pair, pair_row) / at_least(words - 1),
            counts.max(axis=1, initial=0) / at_least(size), total((last == 3) | (last == 6)) / at_least(words),
        ], axis=1,
    )


class Model:
    """Lookup tables over bins: one per feature, one per chosen pair of features, and a constant.

    Training goes round the features; at each, a tree of at most four leaves is fitted to the gradient over the feature's bins (Newton steps
    with shrinkage) and added to its table. With the main effects frozen, pairs are ranked by what a two-by-two split of the remaining gradient
    gains, and the best get tables of their own by trees that split one axis and then the other. All steps work on histograms of bins.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, pairs: int = 6, ridge: float = 2.0):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
        self.rate, self.ridge = rate, ridge
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.constant = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return
        b = self.binned(x)
        f = np.full(len(y), self.constant)
        for _ in range(rounds):
            for j, table in enumerate(self.tables):
                g, h = self._gradient(f, y)
                step = self._line(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
                table += step
                f += step[b[:, j]]
        g, h = self._gradient(f, y)
        gains = []
        for i in range(len(self.tables)):
            for j in range(i):
                gg, hh = self._histograms(b, g, h, i, j)
                gains.append((self._pair_gain(gg, hh), i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0]
        self.grids = [np.zeros((len(self.tables[i]), len(self.tables[j]))) for i, j in self.pairs]
        for _ in range(rounds // 3):
            for (i, j), grid in zip(self.pairs, self.grids, strict=True):
                g, h = self._gradient(f, y)
                step = self._plane(*self._histograms(b, g, h, i, j))
                grid += step
                f += step[b[:, i], b[:, j]]

    @staticmethod
    def _gradient(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    def _histograms(self, b, g, h, i, j):
        shape = (len(self.tables[i]), len(self.tables[j]))
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    def _split(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Best cut of a run of bins: gain and number of bins on the left."""
        if len(g) < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
        k = int(gain.argmax())
        return float(gain[k]), k + 1

    def _line(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A step for every bin: two levels of cuts, a value for each leaf."""
        cuts = {0, len(g)}
        for _ in range(2):
            for a, b in zip(sorted(cuts)[:-1], sorted(cuts)[1:], strict=True):
                gain, k = self._split(g[a:b], h[a:b])
                if gain > 0:
                    cuts.add(a + k)
        out = np.zeros(len(g))
        for a, b in zip(sorted(cuts)[:-1], sorted(cuts)[1:], strict=True):
            out[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + self.ridge)
        return out

    def _plane(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A step for every cell: the better axis is cut first, each half then along the other."""
        turned = self._split(g.sum(axis=1), h.sum(axis=1))[0] < self._split(g.sum(axis=0), h.sum(axis=0))[0]
        if turned:
            g, h = g.T, h.T
        out = np.zeros(g.shape)
        _, cut = self._split(g.sum(axis=1), h.sum(axis=1))
        for rows in (slice(0, cut), slice(cut, None)):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            _, k = self._split(gs, hs)
            for cols in (slice(0, k), slice(k, None)):
                out[rows, cols] = self.rate * gs[cols].sum() / (hs[cols].sum() + self.ridge)
        return out.T if turned else out

    def _pair_gain(self, g: np.ndarray, h: np.ndarray) -> float:
        step = self._plane(g, h) / self.rate
        return float((step * g - 0.5 * step**2 * h).sum())

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f = np.full(len(x), self.constant)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            f += grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-f))


def _column_features(column: pa.Array) -> np.ndarray:
    parts = [features(data, offsets) for _, data, offsets in text_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from at most `train_rows` labelled rows (a bounded, so broadcast, list of ids) where `usable`, a condition on the id column, holds.

    Labels are joined to their documents only here; a score reads nothing but the text. Null labels and null ids are left out. Of several
    labels of an id the smallest counts; of several texts of an id, the one of smallest hash, so one row at most is learned for each id.
    Without labels, or with one class only, every score is that share. Other columns are not read.
    """
    picked = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).cast("double").alias("y"))
    picked = picked.where("id_ is not null").groupBy("id_").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id_"), "id_").limit(train_rows)

    def run(batches):
        for batch in batches:
            x = _column_features(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], ["id", "h", "y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("id_"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", F.xxhash64("text").alias("h"), "y", "text").mapInArrow(run, f"id {kind}, h bigint, y double, x array<double>")
    one = rows.groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("r.y", "r.x")
    got = sorted((r["y"], *r["x"]) for r in one.collect())
    table = np.array(got, float).reshape(len(got), len(FEATURES) + 1)
    return Model(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score column, 0 to 1, of whole texts. Null and empty texts are scored as texts of no words; repeated rows score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(column):
        return pa.array(sent.value.score(_column_features(column)), pa.float64())

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR)(F.col(text_col))
