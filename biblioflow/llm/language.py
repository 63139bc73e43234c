"""Language identification by partial matching: per-language byte context trees with escapes, and exact code lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import table
from ._words import text_chunks

#: Training texts of each language: those of smallest hash among the different texts of the labelled rows.
TRAIN_DOCS = 400
ORDER = 3
#: A table of all contexts, symbols and languages is held while it has no more cells than this; beyond, only what each language has seen is.
DENSE_CELLS = 1 << 26
#: Cells of costs that are worked out at once from the latter.
PIECE_CELLS = 1 << 22
#: Contexts of full order seen so often, in any language, have a node of their own.
MIN_COUNT = 2


class Model:
    """Frozen statistics of all languages: costs in bits by context node, next symbol and language, as one table where it is small.

    Else as trees, order by order: the languages that know a context with their escapes, and those that know a symbol after it with their costs. Their size
    follows the training texts, however many languages there are. Both forms give the same costs.

    Method C: a context with t symbols seen, d of them distinct, gives a seen symbol c / (t + d) and escapes to the next
    shorter context with d / (t + d); below order 0 all 256 bytes are alike. A node is the longest context that any language knows; a language without it has the shorter context's cost.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs = sorted(texts)
        used = np.zeros(256, bool)
        for group in texts.values():
            for t in group:
                used[np.frombuffer(t, np.uint8)] = True
        used[10] = True
        self.symbol = np.zeros(256, np.int64)  # 0: a byte never seen
        self.symbol[used] = np.arange(1, used.sum() + 1)
        self.size = s = int(used.sum()) + 1
        self.pad = int(self.symbol[10])
        grams = {lang: self._counts(group, order) for lang, group in texts.items()}
        self.order = order if self.langs else 0
        nodes = [self._nodes(grams, k) for k in range(self.order + 1)]
        self.trees = None
        if sum(map(len, nodes)) * s * len(self.langs) > DENSE_CELLS:
            self.trees = [self._tree(grams, k, own) for k, own in enumerate(nodes)]
            return
        cost = np.full((1, s, len(self.langs)), np.log2(256.0))  # below order 0
        cost = self._extend(cost, np.zeros(1, np.int64), grams, 0)
        index = np.zeros(1, np.int64)  # node of each context number
        for k in range(1, self.order + 1):
            own = nodes[k]
            shorter = index[own % s ** (k - 1)]
            grown = self._extend(cost[shorter], own, grams, k)
            index = index[np.arange(s**k) % s ** (k - 1)]  # contexts without a node keep the shorter one's
            index[own] = len(cost) + np.arange(len(own))
            cost = np.concatenate([cost, grown])
        self.index = index.astype(np.int32)
        self.cost = np.ascontiguousarray(cost.reshape(len(cost) * s, len(self.langs)).astype(np.float32))

    def _nodes(self, grams: dict, k: int) -> np.ndarray:
        """Contexts of order k that any language knows; those of full order only where seen often enough."""
        seen = np.concatenate([grams[x][k][0] // self.size for x in self.langs] or [np.zeros(0, np.int64)])
        times = np.concatenate([grams[x][k][1] for x in self.langs] or [np.zeros(0, np.int64)])
        contexts, where = np.unique(seen, return_inverse=True)
        return contexts[np.bincount(where, times) >= MIN_COUNT] if k == self.order and k else contexts

    def _tree(self, grams: dict, k: int, own: np.ndarray) -> tuple:
        """Of order k: contexts and their languages' escapes, grams and their languages' costs; each as keys, offsets, languages, bits."""
        escapes, costs = [], []
        for i, lang in enumerate(self.langs):
            g, c = grams[lang][k]
            known = np.isin(g // self.size, own)
            g, c = g[known], c[known]
            contexts, where = np.unique(g // self.size, return_inverse=True)
            t, d = np.bincount(where, c, len(contexts)), np.bincount(where, minlength=len(contexts))
            escapes.append((contexts, np.full(len(contexts), i), np.log2((t + d) / d)))
            costs.append((g, np.full(len(g), i), np.log2((t + d)[where] / c)))

        def rows(parts: list) -> tuple:
            key, lang, bits = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            return keys, np.append(first, len(key)), lang[order].astype(np.int32), bits[order].astype(np.float32)

        return rows(escapes), rows(costs)

    def _counts(self, group: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct grams of each order (context and next symbol, as a number) and how often each occurs."""
        ids = [np.concatenate([np.full(order, self.pad), self.symbol[np.frombuffer(t, np.uint8)]]) for t in group if t]
        out = []
        for k in range(order + 1):
            parts = []
            for x in ids:
                g = np.zeros(len(x) - order, np.int64)
                for j in range(k, -1, -1):
                    g = g * self.size + x[order - j : len(x) - j]
                parts.append(g)
            out.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True))
        return out

    def _extend(self, shorter: np.ndarray, own: np.ndarray, grams: dict, k: int) -> np.ndarray:
        """Costs of contexts `own` of order k, given their shorter contexts' costs."""
        s = self.size
        cost = shorter.copy()
        for i, lang in enumerate(self.langs):
            g, c = grams[lang][k]
            place = np.searchsorted(own, g // s)
            place[place == len(own)] = 0
            hit = own[place] == g // s if len(own) else np.zeros(len(g), bool)
            place, symbol, c = place[hit], (g % s)[hit], c[hit]
            t, d = np.bincount(place, c, len(own)), np.bincount(place, minlength=len(own))
            known = t > 0
            cost[known, :, i] += np.log2((t + d)[known] / d[known])[:, None]
            cost[place, symbol, i] = np.log2((t + d)[place] / c)
        return cost

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        step = 1 << 19 if self.trees is None else max(1_024, PIECE_CELLS // len(self.langs))
        ids = self.symbol[data] if len(data) <= step else None
        filled = np.flatnonzero(np.diff(offsets))
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if ids is not None else None
        if ids is None:  # one long text, or a full chunk: pieces with the context before them
            for at in range(0, len(data), step):
                lo = max(0, at - ORDER)
                piece = self.symbol[data[lo : at + step]]
                starts = offsets[(offsets >= lo) & (offsets < at + step)] - lo
                bits = self._bits(piece, starts)[at - lo :]
                rows = np.searchsorted(offsets, np.arange(at, at + len(bits)), side="right") - 1
                self._add(out, bits, rows)
            return out
        if len(filled):
            self._add(out, self._bits(ids, offsets[:-1][filled]), row_of)
        return out

    @staticmethod
    def _add(out: np.ndarray, bits: np.ndarray, rows: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)

    def _found(self, rows: tuple, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `asked`, languages and bits of all entries of the keys asked for."""
        keys, first, langs, bits = rows
        if not len(keys):
            return np.zeros(0, np.int64), langs, bits
        row = np.searchsorted(keys, asked)
        row[row == len(keys)] = 0
        at = np.flatnonzero(keys[row] == asked)
        n = first[row[at] + 1] - first[row[at]]
        entry = np.repeat(first[row[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), langs[entry], bits[entry]

    def _walk(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Costs from the trees: from the shortest context on, a language that knows a context pays its escape, and one that knows the symbol too its cost."""
        cost = np.full((len(ids), len(self.langs)), np.float32(8))
        for k, (escapes, costs) in enumerate(self.trees):
            own = context % self.size**k
            at, lang, bits = self._found(escapes, own)
            cost[at, lang] += bits
            at, lang, bits = self._found(costs, own * self.size + ids)
            cost[at, lang] = bits
        return cost

    def _bits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        context = np.zeros(len(ids), np.int64)
        for j in range(ORDER, 0, -1):
            back = np.full(len(ids), self.pad)
            back[j:] = ids[:-j] if j else ids
            for k in range(j):
                at = starts + k
                back[at[at < len(ids)]] = self.pad
            context = context * self.size + back
        if self.trees is not None:
            return self._walk(context, ids)
        return self.cost[self.index[context] * np.int64(self.size) + ids]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language with the shortest code (first of equals), and its share when each language is as likely as its code is short."""
        bits = self.lengths(data, offsets)
        best = bits.argmin(axis=1)
        odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1_000))
        return best, 1 / odds.sum(axis=1)


def fit(docs: DataFrame, usable: Column, train_docs: int = TRAIN_DOCS, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most `train_docs` whole, different texts of each language, of the rows where `usable` holds: those of smallest hash.

    Copies count once, so every language with a usable text is learned, however often its texts repeat.
    """
    low = F.pmod("x", F.lit(1 << 30))
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("x"))
    hashes = table(labelled.select("lang", "x").distinct())
    # a share of the hash range that holds somewhat more than train_docs of the language's different texts, so that no task ranks all of them
    share = F.broadcast(hashes.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.5 * train_docs + 50) / F.count("*")).alias("share")))
    near = hashes.join(share, "lang").where(low < F.col("share") * (1 << 30)).withColumn("low", low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("low", "x"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= train_docs).select("lang", "x")
    texts: dict[str, list] = {}
    for lang, text, x in labelled.join(F.broadcast(picked), ["lang", "x"], "left_semi").select("lang", "text", "x").distinct().collect():
        texts.setdefault(lang, []).append((x % (1 << 30), text.encode()))
    return Model({lang: [t for _, t in sorted(rows)[:train_docs]] for lang, rows in texts.items()})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column struct(lang_pred, score). `und` with score 0 for a null text, one without letters, or where no language was learned.

    Empty, very long and repeated texts need no special care: a code length is a sum over bytes. Invalid or unseen bytes cost eight bits and
    the escapes in every language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(column):
        m = sent.value
        langs, scores = [], []
        for _, data, offsets in text_chunks(column):
            best, score = m.predict(data, offsets)
            langs += [m.langs[i] for i in best]
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.langs:
        return none
    guess = F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR)(F.col(text_col))
    return F.when(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)), guess).otherwise(none)
