"""Substring dedup: windows of words that repeat across documents, found by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._shared import quoted
from ._words import A, B, mix, spans, windows, word_hashes

#: Shortest length of the first level: shorter runs of words repeat by chance.
SHORTEST = 5
#: About so many bytes of text are read as one chunk of documents, and the windows of about so many are compared in one bucket.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: A level's questions and the marks kept between levels; its answers.
ASKED = "dest bigint, chunk bigint, h binary, span binary, flags binary, ids array<{kind}>"
TOLD = "chunk bigint, state boolean, h binary, span binary, flags binary, ids array<{kind}>"
SEVERAL, MIXED = 1, 2


def levels(window: int) -> list[int]:
    """Lengths of the levels: the window's, before it half of that, and so on."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= SHORTEST:
        out.insert(0, half)
    return out


def ranks(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each id among the different ones in order (null: -1), and these."""
    coded = ids.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order) + 1, np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place[-1] = -1
    return place[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


class Chunk:
    """Words of a chunk of documents in a fixed order, the windows still in question (`alive`, by first word) and those to go (`gone`)."""

    def __init__(self, table: pa.Table, window: int, state: tuple[bytes, bytes] | None = None):
        self.table = table = table.combine_chunks().sort_by([("lot", "ascending"), ("id", "ascending")])
        self.window = window
        self.ids = table.column("id").combine_chunks()
        text = table.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.starts, self.ends, self.rows = spans(self.data, offsets)
        n = len(self.starts)
        if state:
            self.alive, self.gone = (np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x in state)
            return
        self.alive, self.gone = np.zeros(n, bool), np.zeros(n, bool)
        whole = np.zeros(n + 1, np.int64)
        has = (self.rows[1:] - self.rows[:-1] >= window) & self.ids.is_valid().to_numpy(zero_copy_only=False)
        np.add.at(whole, self.rows[:-1][has], 1)
        np.add.at(whole, self.rows[1:][has] - window + 1, -1)
        self.alive = np.cumsum(whole)[:-1] > 0

    def state(self) -> tuple[bytes, bytes]:
        return np.packbits(self.alive).tobytes(), np.packbits(self.gone).tobytes()

    def runs(self, length: int) -> tuple[np.ndarray, ...]:
        """First and last window of each run of living windows that stand under one part of `length` words, with the hashes of the part and of the
        run as a whole (of a window itself, a second hash). A window stands under the part inside it with the smallest hash (the first of equals), so equal windows of two
        documents stand under equal parts at equal places."""
        starts = np.flatnonzero(self.alive)
        if not len(starts):
            return starts, starts, starts.astype(np.uint64), starts.astype(np.uint64)
        if not hasattr(self, "hashes"):
            self.hashes = word_hashes(self.data, self.starts, self.ends)
            self.whole = windows(self.hashes, self.window)
        n = len(self.whole)
        g = windows(self.hashes, length)
        least, at = g[:n].copy(), np.zeros(n, np.int32)
        for j in range(1, self.window - length + 1):
            lower = g[j : j + n] < least
            np.copyto(least, g[j : j + n], where=lower)
            at[lower] = j
        p = starts + at[starts]
        new = np.empty(len(p), bool)
        new[0] = True
        new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        a, b, p = starts[first], starts[np.append(first[1:], len(p)) - 1], p[first]
        # first and last window hold all words of the run
        if length < self.window:
            span = mix(mix(self.whole[a] * A + self.whole[b] * B) + ((b - a) << 32).astype(np.uint64) + (p - a).astype(np.uint64))
        else:
            span = windows(mix(self.hashes ^ B), self.window)[a]
        return a, b, g[p], span

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, starts, side="right") - 1

    def questions(self, number: int, length: int, buckets: int) -> Iterator[tuple]:
        """The different parts of the chunk with the smallest id that has each, whether several have, and whether their runs differ; by bucket."""
        a, _, h, span = self.runs(length)
        if not len(a):
            return
        rank, names = ranks(self.ids)
        rank = rank[self.row_of(a)]
        order, first = _groups(h, span, length == self.window)
        h, span, rank = h[order], span[order], rank[order]
        low, high = np.minimum.reduceat(rank, first), np.maximum.reduceat(rank, first)
        flags = SEVERAL * (low != high) + MIXED * (np.minimum.reduceat(span, first) != np.maximum.reduceat(span, first))
        h, span = h[first], span[first]
        bucket = ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        for k in range(buckets):
            own = order[ends[k - 1] if k else 0 : ends[k]]
            if len(own):
                yield k, number, h[own].tobytes(), span[own].tobytes(), flags[own].astype(np.uint8).tobytes(), names.take(pa.array(low[own]))

    def answer(self, length: int, told: pa.Table) -> None:
        """A part that repeats nowhere takes its windows out of question. Where all its runs agree its smallest id settles them; else they live on."""
        a, b, h, span = self.runs(length)
        self.alive[:] = False
        if not len(a) or not told.num_rows:
            return
        known = np.frombuffer(b"".join(told.column("h").to_pylist()), np.uint64)
        mixed = np.frombuffer(b"".join(told.column("flags").to_pylist()), np.uint8) > 0
        ids = told.column("ids").combine_chunks().flatten()
        other = np.frombuffer(b"".join(told.column("span").to_pylist()), np.uint64) if length == self.window else None
        order = np.argsort(known) if other is None else np.lexsort((other, known))
        place = np.searchsorted(known[order], h)
        while other is not None:  # of windows that share a hash by chance, on to the one that shares the second too
            on = np.flatnonzero(place + 1 < len(known))
            on = on[(known[order[place[on] + 1]] == h[on]) & (other[order[place[on]]] != span[on])]
            if not len(on):
                break
            place[on] += 1
        place[place == len(known)] = 0
        place = order[place]
        hit = np.flatnonzero((known[place] == h) & (other is None or other[place] == span))
        a, b, place = a[hit], b[hit], place[hit]
        later = pc.greater(self.ids.take(pa.array(self.row_of(a))), ids.take(pa.array(place))).to_numpy(zero_copy_only=False).astype(bool)
        for marks, which in ((self.alive, mixed[place]), (self.gone, ~mixed[place] & later)):
            edge = np.zeros(len(marks) + 1, np.int64)
            np.add.at(edge, a[which], 1)
            np.add.at(edge, b[which] + 1, -1)
            marks |= np.cumsum(edge)[:-1] > 0

    def left(self) -> pa.Table:
        """The chunk's rows without the words of windows that go."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        at = np.flatnonzero(self.gone)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        drop = np.cumsum(edge)[:-1] > 0
        raw, texts = self.data.tobytes(), self.table.column("text").combine_chunks()
        n_removed, digests, kept = [], [], []
        for i, (lo, hi) in enumerate(zip(self.rows[:-1], self.rows[1:], strict=True)):
            stay = ~drop[lo:hi]
            n_removed.append(int(hi - lo - stay.sum()))
            words = b" ".join([raw[x:y] for x, y in zip(self.starts[lo:hi][stay].tolist(), self.ends[lo:hi][stay].tolist(), strict=True)])
            digests.append(hashlib.sha256(words).hexdigest())
            kept.append(words.decode() if n_removed[-1] else texts[i].as_py())
        columns = {"id": self.ids, "n_words": pa.array(np.diff(self.rows), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.string()), "rest": self.table.column("rest").combine_chunks()}
        return pa.table(columns)


def _groups(h: np.ndarray, span: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes (`both`: equal pairs) stand together, and where each begins."""
    order = np.lexsort((span, h)) if both else np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if both:
        new[1:] |= span[order][1:] != span[order][:-1]
    return order, np.flatnonzero(new)


def _asked(rows: list[tuple], kind: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    parts = [x if x is not None else pa.array([], kind) for x in columns[5]]
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.concat_arrays([pa.array([], kind), *parts]))
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:5]), ids], ["dest", "chunk", "h", "span", "flags", "ids"])


def _first(window: int, length: int, buckets: int, key: tuple, docs: pa.Table) -> pa.Table:
    chunk = Chunk(docs, window)
    return _asked(list(chunk.questions(key[0].as_py(), length, buckets)), chunk.ids.type)


def _told(docs: pa.Table, told: pa.Table, window: int, length: int) -> Chunk:
    """The chunk after a level's answers."""
    state = told.filter(told.column("state"))
    chunk = Chunk(docs, window, (state.column("h")[0].as_py(), state.column("span")[0].as_py()) if state.num_rows else None)
    chunk.answer(length, told.filter(pc.invert(told.column("state"))))
    return chunk


def _next(window: int, length: int, longer: int, buckets: int, key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Takes a level's answers in and asks for the next one; the marks travel along (to a place of their own, below zero)."""
    chunk, number = _told(docs, told, window, length), key[0].as_py()
    rows = list(chunk.questions(number, longer, buckets))
    if rows or chunk.gone.any():
        rows.append((-1 - number, number, *chunk.state(), None, None))
    return _asked(rows, chunk.ids.type)


def _last(window: int, length: int, key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
    return _told(docs, told, window, length).left()


def _compare(last: bool, key: tuple, asked: pa.Table) -> pa.Table:
    """Answers of a bucket: to each chunk, those of its parts that several documents have, their smallest id, and whether their runs differ anywhere."""
    names = ["chunk", "state", "h", "span", "flags", "ids"]
    if key[0].as_py() < 0:
        return pa.table([asked.column("chunk"), pa.array([True] * asked.num_rows), *(asked.column(x) for x in names[2:])], names)
    asked = asked.combine_chunks()
    h, span, flags = (np.frombuffer(b"".join(asked.column(x).to_pylist()), kind) for x, kind in (("h", np.uint64), ("span", np.uint64), ("flags", np.uint8)))
    rank, ids = ranks(asked.column("ids").combine_chunks().flatten())
    owner = np.repeat(np.arange(asked.num_rows), [len(x) // 8 for x in asked.column("h").to_pylist()])
    order, first = _groups(h, span, last)
    over = lambda f, x: f.reduceat(x[order], first)
    low, any_flags = over(np.minimum, rank), over(np.bitwise_or, flags)
    repeats = (any_flags & SEVERAL > 0) | (low != over(np.maximum, rank))
    mixed = (any_flags & MIXED > 0) | (over(np.minimum, span) != over(np.maximum, span))
    group = np.empty(len(h), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    said = np.flatnonzero(repeats[group])
    cuts = np.searchsorted(owner[said], np.arange(asked.num_rows + 1))
    rows = [said[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    use = [i for i, r in enumerate(rows) if len(r)]
    least = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(rows[i]) for i in use])]), pa.int32()), ids.take(pa.array(low[group[said]])))
    return pa.table([asked.column("chunk").take(pa.array(use, pa.int64())), pa.array([False] * len(use)), pa.array([h[rows[i]].tobytes() for i in use], pa.binary()), pa.array([span[rows[i]].tobytes() if last else None for i in use], pa.binary()), pa.array([mixed[group[rows[i]]].astype(np.uint8).tobytes() for i in use], pa.binary()), least], names)


def dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts in a document with a smaller id.

    Levels. Level 1 looks at parts of half the window's length, or half of that and so on down to SHORTEST (7 for 13), and only at those
    that stand for a full window: the part of smallest hash inside it. Windows whose part occurs in one document alone are out of question.
    The others are looked at again by parts of twice the length, and so on to the window itself, until none is left. Where all
    occurrences of a part agree in every full window that they stand for (copies), their smallest id settles these windows at once.

    Texts are shuffled once, into chunks of documents, and each level reads them there. A chunk asks for each of its different parts once, so the key
    of a part that every document has counts once a chunk; questions go to buckets by hash, and answers back to the chunks, only for
    parts that repeat. Between levels a chunk keeps two bits a word. What is
    settled has agreed in 128 bits of hash.

    Words are runs of bytes other than ASCII white space, unchanged. Null and empty texts have no words; texts of fewer words than a
    window lose nothing; very long texts are handled in one piece by vectorised code. Rows that share an id are one document
    (they must share the text); a null id is never smaller nor larger than another, so such rows neither lose words nor take them from others. An empty
    table gives no rows. Only the named columns are read, whatever else there is and is called.
    Returns (id, n_words, n_removed, kept_sha256, kept, rest): the digest is of the words left, joined by one space; kept is these, or the
    text itself where nothing went; rest is a struct of the columns named in `carry`, which ride along.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rest = F.struct(*[quoted(c) for c in carry]) if carry else F.lit(None).cast("int")
    ident, text = quoted(id_col), quoted(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, buckets = (max(1, -(-size // x)) for x in (CHUNK_BYTES, BUCKET_BYTES))
    lot = F.xxhash64(ident, text)
    base = docs.select(ident.alias("id"), text.alias("text"), rest.alias("rest"), lot.alias("lot"), F.pmod(lot, F.lit(chunks)).alias("chunk"))
    lengths = levels(window)
    by_chunk = lambda: base.groupBy("chunk")
    asked = by_chunk().applyInArrow(_with_key(partial(_first, window, lengths[0], buckets)), ASKED.format(kind=kind))
    for length, longer in zip(lengths, [*lengths[1:], None], strict=True):
        told = asked.groupBy("dest").applyInArrow(_with_key(partial(_compare, longer is None)), TOLD.format(kind=kind)).groupBy("chunk")
        if longer:
            asked = by_chunk().cogroup(told).applyInArrow(_with_keys(partial(_next, window, length, longer, buckets)), ASKED.format(kind=kind))
    found = [StructField(c, t) for c, t in (("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType()), ("kept", StringType()))]
    columns = StructType([StructField("id", base.schema["id"].dataType), *found, StructField("rest", base.schema["rest"].dataType)])
    return by_chunk().cogroup(told).applyInArrow(_with_keys(partial(_last, window, lengths[-1])), columns).withColumnRenamed("id", id_col)


def _with_key(f):
    return lambda key, rows: f(key, rows)


def _with_keys(f):
    return lambda key, left, right: f(key, left, right)
