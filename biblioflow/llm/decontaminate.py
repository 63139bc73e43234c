"""Benchmark decontamination: prefix-filtered containment join of item windows and documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._shared import quoted, table
from ._words import windows

#: A word: digits, ASCII letters and everything beyond ASCII; texts are lower-cased in A-Z only.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE = 5
#: Items are handled in blocks of about so many words, each a bounded broadcast and one pass over the documents.
BLOCK_WORDS = 1_000_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Index:
    """Windows of a block of items, under the rarest of their shingles.

    A document that contains a window contains every shingle of it, so at containment 1 the necessary prefix of a window, in
    order of rarity, is one shingle. Windows of fewer words than a shingle are their own shingle.
    """

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.windows = [], []  # windows: (item number, first word, words as numbers)
        number = self.vocabulary.setdefault
        self.item_words = []
        for name, text in items:
            w = np.array([number(x, len(self.vocabulary) + 1) for x in words(text)], np.int64)
            self.names.append(name)
            self.item_words.append(w)
        self.window = window
        self.lengths = sorted({min(SHINGLE, len(w)) for w in self.item_words if len(w)})
        # shingles as keys of 64 bits, over word numbers of this block; a candidate is verified word by word
        self.keys = {n: np.unique(np.concatenate([self.hashed(w, n) for w in self.item_words if min(SHINGLE, len(w)) == n])) for n in self.lengths}

    @staticmethod
    def hashed(numbers: np.ndarray, n: int) -> np.ndarray:
        if len(numbers) < n:
            return np.zeros(0, np.uint64)
        return windows(numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n), n)

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(x, 0) for x in words(text)], np.int64)

    def found(self, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a document's shingles of n words that items have, and their places among the keys."""
        h, keys = self.hashed(numbers, n), self.keys[n]
        # shingles with a word that no item has can't match
        known = np.concatenate([[0], np.cumsum(numbers == 0)])
        at = np.flatnonzero(known[n:] == known[:-n]) if len(numbers) >= n else np.zeros(0, np.int64)
        place = np.searchsorted(keys, h[at])
        place[place == len(keys)] = 0
        hit = keys[place] == h[at]
        return at[hit], place[hit]

    def finish(self, counts: dict[tuple[int, int], int]) -> None:
        """Chooses each window's rarest shingle by the documents' counts (ties: by key), and groups windows under it."""
        self.under: dict[int, dict[int, list]] = {n: {} for n in self.lengths}
        for i, w in enumerate(self.item_words):
            if not len(w):
                continue
            n, size = min(SHINGLE, len(w)), min(self.window, len(w))
            place = np.searchsorted(self.keys[n], self.hashed(w, n)).tolist()
            for s in range(len(w) - size + 1):
                offset, key = min(enumerate(place[s : s + size - n + 1]), key=lambda x: (counts.get((n, x[1]), 0), x[1]))
                if counts.get((n, key), 0):  # else no document has it
                    self.under[n].setdefault(key, []).append((offset, size, w[s : s + size], i))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, list]:
        """Marks of the words inside any occurrence of a window, and the numbers of the items found."""
        marks, items = np.zeros(len(numbers) + 1, np.int64), set()
        for n in self.lengths:
            under = self.under[n]
            for p, key in zip(*(x.tolist() for x in self.found(numbers, n)), strict=True):
                for offset, size, w, i in under.get(key, ()):
                    start = p - offset
                    # positional and length bounds, then the words themselves
                    if start >= 0 and start + size <= len(numbers) and np.array_equal(numbers[start : start + size], w):
                        marks[start] += 1
                        marks[start + size] -= 1
                        items.add(i)
        return np.cumsum(marks)[:-1] > 0, sorted(items)


def _count(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        totals = {n: np.zeros(len(x.keys[n]), np.int64) for n in x.lengths}
        for batch in batches:
            for text in batch.column(0):
                numbers = x.numbers(text.as_py())
                for n in x.lengths:
                    np.add.at(totals[n], x.found(numbers, n)[1], 1)
        for n, t in totals.items():
            k = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k), pa.array(t[k])], ["n", "k", "c"])

    return run


def _ranges(mark: np.ndarray) -> list[int]:
    """Starts and ends of the marked runs, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8))).tolist()


def _match(index, last: bool):  # columns id, text, items, spans, rest
    """Adds a block's marks to those of the blocks before; the last one drops the text and sums up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            rows = []
            for text, items, spans in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                numbers = x.numbers(text.as_py())
                mark, found = x.hits(numbers)
                items, spans = sorted({*items.as_py(), *(x.names[i] for i in found if x.names[i] is not None)}), spans.as_py()
                rows.append((items, _merged([spans, _ranges(mark)]) if spans else _ranges(mark), len(numbers)))
            items, spans = pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), items, spans, batch.column(4)], ["id", "text", "items", "spans", "rest"])
                continue
            n_hit = [sum(r[1][1::2]) - sum(r[1][::2]) for r in rows]
            digests = [hashlib.sha256(",".join(r[0]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[2] for r in rows], pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array(digests, pa.string()), spans, batch.column(4)], ["id", "n_words", "n_hit", "items", "items_sha256", "spans", "rest"])

    return run


def _merged(spans) -> list[int]:
    """Union of runs given as starts and ends in turn."""
    out: list[int] = []
    for a, b in sorted(tuple(s[i : i + 2]) for s in spans for i in range(0, len(s), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of documents inside occurrences of benchmark windows.

    A window is `window` consecutive words of an item (all of a shorter item). Windows are sets of five-word shingles, ordered by
    rarity over all documents (first pass); documents are joined with each window's rarest shingle, candidates pass
    positional and length bounds, and the words themselves decide (second pass).

    The benchmark is held in blocks of at most about BLOCK_WORDS words, the size that is broadcast; a larger one takes more
    passes over the documents, each adding its marks to the rows. Documents are never shuffled.

    Null and empty texts have no words and hit nothing; items without words have no window; equal items are all named. An item id on several
    rows is one item with the windows of all; the windows of rows without an id hit words, but name nothing. Repeated document rows are
    judged each. Empty tables give no rows, or no hits. Only the named columns are read, whatever else there is and is called.
    Returns (id, n_words, n_hit, items, items_sha256, spans, rest): spans are starts and ends of the runs of words hit, in turn; rest is a
    struct of the columns named in `carry`, which ride along.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")).where("t is not null")
    total = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * (block_words or BLOCK_WORDS))))
    block_of = F.pmod(F.xxhash64("item", "t"), F.lit(blocks))
    rest = F.struct(*[quoted(c) for c in carry]) if carry else F.lit(None).cast("int")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    own = [StructField(c, base.schema[c].dataType) for c in ("id", "text", "rest")]
    listed = [StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(LongType()))]
    counts = [StructField(c, LongType()) for c in ("n_words", "n_hit")]
    each = StructType([*own[:2], *listed, own[2]])
    summed = StructType([own[0], *counts, listed[0], StructField("items_sha256", StringType()), listed[1], own[2]])
    rows = base.select("id", "text", F.array().cast("array<string>").alias("items"), F.array().cast("array<bigint>").alias("spans"), "rest")
    for k in range(blocks):
        index = Index([tuple(r) for r in bench.where(block_of == k).collect()], window)
        sent = spark.sparkContext.broadcast(index)
        counted = base.select("text").mapInArrow(_count(sent), "n int, k bigint, c bigint").groupBy("n", "k").agg(F.sum("c")).collect() if index.lengths else []
        index.finish({(n, key): c for n, key, c in counted})
        last = k == blocks - 1
        rows = rows.mapInArrow(_match(spark.sparkContext.broadcast(index), last), summed if last else each)
        rows = rows if last else table(rows)
    return rows.withColumnRenamed("id", id_col)


def report(found: DataFrame) -> DataFrame:
    """The columns n_items and contaminated (at least a twentieth of the words hit) added."""
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
