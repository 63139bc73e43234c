"""SimHash near-dedup: exact pairs within a Hamming radius by sharded vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._forest import Forest
from ._shared import connected_components, fresh, quoted, table
from ._words import mix

SEED = 42
#: Shards are of about SHARD_ROWS, and there are about SHARDS of them, until that would take them over LARGE_ROWS: then there are more. The routing tree
#: is fitted on at most SAMPLE distinct fingerprints, or SAMPLE_EACH a shard (lowest hashes of all).
SHARD_ROWS, SHARDS, LARGE_ROWS, SAMPLE, SAMPLE_EACH = 8_192, 1_024, 1 << 20, 32_768, 16
#: A shard's rows, as the sample foretells them, are dealt to pieces of so many that live there, and so many that ask there or four times those that live there.
HOME_ROWS, ASK_ROWS = 1 << 20, 1 << 15
LEAF = 96


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint. Null and wordless texts have 0."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    starts = (ends - n)[: len(words) - shingle + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter([digest(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _halves(d: np.ndarray, radius: int) -> int | None:
    """Ball radius that splits best: fewest points within reach of both sides, among splits that aren't lopsided."""
    counts = np.bincount(d, minlength=65)
    inner = np.cumsum(counts)
    n = inner[-1]
    best, mu = None, None
    for m in range(64):
        small = min(inner[m], n - inner[m])
        if small * 8 < n:
            continue
        shared = inner[min(64, m + radius)] - (inner[m - radius] if m >= radius else 0)
        cost = shared + 0.5 * abs(n - 2 * inner[m])
        if best is None or cost < best:
            best, mu = cost, m
    return mu


def routing_tree(sample: np.ndarray, leaves: int, radius: int) -> tuple:
    """Nested (vantage point, ball radius, inside, outside); a leaf is its number, given in order."""
    number = iter(range(1 << 30))

    def grow(points: np.ndarray, share: int):
        if share <= 1 or len(points) < 16:
            return next(number)
        # the vantage point, of a few, whose best ball is shared least
        options = []
        for v in points[:: max(1, len(points) // 8)][:8]:
            d = distance(points, v)
            if (mu := _halves(d, radius)) is not None:
                options.append((int(((d > mu - radius) & (d <= mu + radius)).sum()), int(v), mu))
        if not options:
            return next(number)
        _, v, mu = min(options)
        d = distance(points, np.uint64(v))
        return (v, mu, grow(points[d <= mu], share // 2), grow(points[d > mu], share - share // 2))

    return grow(sample, leaves)


def route(tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, whether each is at home there): by the triangle bound, all leaves that can hold points within the radius."""
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, tuple):
            yield node, rows, home
            continue
        v, mu, inside, outside = node
        d = distance(fps[rows], np.uint64(v)).astype(np.int16)
        near, far = d <= mu + radius, d > mu - radius
        stack.append((inside, rows[near], home[near] & (d[near] <= mu)))
        stack.append((outside, rows[far], home[far] & (d[far] > mu)))


def tree_links(points: np.ndarray, queries: np.ndarray, fps: np.ndarray, radius: int, forest: Forest) -> None:
    """Joins in `forest` every query with every point within the radius: a vantage-point tree over the points,
    built as far as the queries reach; both are row numbers into fps."""
    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        mu = None
        if len(p) > LEAF:
            v = fps[p[len(p) // 2]]
            d = distance(fps[p], v).astype(np.int16)
            mu = _halves(d, radius)
        if mu is None:
            for at in range(0, len(p), LEAF):
                part = p[at : at + LEAF]
                for lo in range(0, len(q), 16_384):
                    x, y = np.nonzero(distance(fps[q[lo : lo + 16_384], None], fps[part][None, :]) <= radius)
                    forest.add(q[lo + x], part[y])
            continue
        e = distance(fps[q], v).astype(np.int16)
        stack.append((p[d <= mu], q[e <= mu + radius]))
        stack.append((p[d > mu], q[e > mu - radius]))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges between fingerprints of table (fp, rep): as many as it takes to connect what pairs within `radius` connect.

    Shards are leaves of a small vantage-point tree; a fingerprint lives in one shard and asks in every other that the triangle bound cannot
    rule out, so each pair meets in a shard. Where the sample foretells a crowded shard, its living and its asking rows are dealt into blocks, and each
    pair of blocks is a piece of its own: whatever a shard holds, a task's rows are bounded and no pair is lost. A piece gives a spanning
    forest of its pairs, never the pairs.
    """
    n = fps.count()
    leaves = max(1, min(SHARDS, -(-n // SHARD_ROWS)), -(-n // LARGE_ROWS))
    size = max(SAMPLE, SAMPLE_EACH * leaves)
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64).view(np.uint64)
    tree = routing_tree(sample, leaves, radius)
    lives, asks = np.ones(leaves, np.int64), np.ones(leaves, np.int64)
    for leaf, rows, home in route(tree, sample, radius):
        here, there = (int(x) * n / len(sample) for x in (home.sum(), len(rows)))
        lives[leaf] = max(1, round(here / HOME_ROWS))
        asks[leaf] = max(1, round(there / max(ASK_ROWS, 4 * here / lives[leaf])))
    first = np.concatenate([[0], np.cumsum(lives * asks)])  # number of each shard's first piece

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            lot = mix(values.copy())
            for leaf, rows, home in route(tree, values, radius):
                a, b = int(lives[leaf]), int(asks[leaf])
                block, slice_ = (lot[rows] % np.uint64(a)).astype(np.int64), (lot[rows] // np.uint64(a) % np.uint64(b)).astype(np.int64)
                for i in range(a):
                    for j in range(b):
                        here, asking = home & (block == i), slice_ == j
                        use = here | asking
                        if use.any():
                            take = pa.array(rows[use])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), first[leaf] + i * b + j, np.int64)), pa.array(here[use]), pa.array(asking[use]), batch.column(0).take(take), batch.column(1).take(take)], ["piece", "home", "asks", "fp", "rep"])

    def pairs(key, shard):
        values = shard.column("fp").to_numpy().view(np.uint64)
        home, asking = (shard.column(x).to_numpy(zero_copy_only=False) for x in ("home", "asks"))
        forest = Forest(len(values))
        tree_links(np.flatnonzero(home), np.flatnonzero(asking), values, radius, forest)
        root = forest.roots(np.arange(len(values)))
        child = np.flatnonzero(root != np.arange(len(values)))
        rep = shard.column("rep").combine_chunks()
        return pa.table({"a": rep.take(pa.array(child)), "b": rep.take(pa.array(root[child]))})

    kind = fps.schema["rep"].dataType.simpleString()
    pieces = int(first[-1])
    placed = fps.select("fp", "rep").mapInArrow(spread, f"piece bigint, home boolean, asks boolean, fp bigint, rep {kind}")
    # more partitions than pieces, so that few pieces share one; empty ones cost little
    return placed.repartition(max(pieces, min(4 * pieces, 2_000)), "piece").groupBy("piece").applyInArrow(pairs, f"a {kind}, b {kind}")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the document of smallest id of each group, with the columns of docs, whatever their names.

    Of several rows of that id the one of least text stays (null first; of equal texts the least row as JSON), so a repeated row stays once. Of a group
    without ids, one row of its smallest fingerprint stays, that of the least text.
    """
    marked = table(fingerprints(docs, shingle, id_col, text_col))
    classes = table(_classes(marked, radius))
    key, row, fp = (fresh(docs, x) for x in ("id_", "row_", "fp_"))
    ident, text = quoted(id_col), quoted(text_col)
    # what goes is less than what stays, so the smaller list is joined; both are of ids alone
    named = marked.where("id is not null")
    gone = table(named.join(classes, F.col("fp") == F.col("fp_")).where("id <> component_id").select(F.col("id").alias(key)).distinct())
    again = table(named.groupBy(F.col("id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key))
    kept = docs.where(ident.isNotNull()).join(gone, ident == F.col(key), "left_anti")
    if again.limit(1).count():
        several = kept.join(again, ident == F.col(key), "left_semi").select(ident.alias(key), F.struct("*").alias(row))
        several = several.groupBy(key).agg(F.min_by(row, F.struct(F.col(row)[text_col], F.to_json(row))).alias(row))
        kept = kept.join(again, ident == F.col(key), "left_anti").union(several.select(f"{row}.*"))
    nameless = classes.where("component_id is null and fp_ = group").select(F.col("fp_").alias(fp))
    if not nameless.limit(1).count():
        return kept

    def run(column):
        return pa.array(np.fromiter((fingerprint(x.as_py(), shingle) for x in column), np.uint64, len(column)).view(np.int64))

    rows = docs.where(ident.isNull()).select(F.arrow_udf(run, "bigint", F.ArrowUDFType.SCALAR)(text).alias("fp"), F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("least"))
    rows = rows.groupBy("fp").agg(F.min_by("row", F.struct("least", F.to_json("row"))).alias("row"))
    return kept.union(rows.join(nameless, F.col("fp") == F.col(fp), "left_semi").select("row.*"))


def dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose fingerprints link at `radius` or fewer differing bits, directly or through others.

    Returns (id, fingerprint as 16 hex digits, component_id = smallest id of the group, itself included). Equal
    fingerprints form a class (pre-aggregated), so copies are never compared; trees and
    components work on classes. Null and empty texts have fingerprint zero, linked like any other. Rows that share an
    id are nodes of one name: each is returned, their groups are one. Rows with a null id form groups by text like any other; the component
    is null where no row of a group has an id. An empty table gives no rows. Only the two named columns are read.
    """
    marked = table(fingerprints(docs, shingle, id_col, text_col))
    out = marked.join(_classes(marked, radius), F.col("fp") == F.col("fp_"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp_, group, component_id) of every fingerprint of (id, fp): the smallest fingerprint of its group, and the group's smallest id."""
    reps = table(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    edges = links(reps.select("fp", F.col("fp").alias("rep")), radius)
    # one id with several texts joins their classes
    shared = marked.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi and id is not null").select("id", "lo")
    same = marked.join(shared, "id").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()
    parts = connected_components(edges.union(same))
    placed = reps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    names = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    return placed.join(names, "group").select(F.col("fp").alias("fp_"), "group", "component_id")
