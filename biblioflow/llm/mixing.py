"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import quoted, table

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of a source's shuffled queue, and of the merged queue. Both are fixed, so the tables of slice sums are
#: bounded by sources x SLICES rows and by (passes + 2) x SLICES + 1 rows whatever the input.
SLICES = 4096


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Words wanted of each source: (source, source_size) plus target.

    Weights go to the sources by code point, null last, repeating. `budget` times all words is shared by weight;
    a target stops at `ceiling` times its source's size and the excess is shared again by weight until none is above.
    In closed form: sources in the order of ceiling / weight, where a prefix is capped and the rest gets one rate.
    Reads one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("rate", (F.lit(budget) * F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("w_left"))
    # the first source that stays below its ceiling at the rate left for it and the later ones sets the rate of all those
    s = s.withColumn("rn", F.row_number().over(by))
    level = F.min(F.when(F.col("rate") * F.col("w") < F.col("cap"), F.struct("rn", "rate"))).over(everything)["rate"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w")))
    return s.withColumn("level", level).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, ceiling: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document with the words that the mix takes of it.

    Every source's documents are shuffled by a seeded hash and queued in as many passes in a row as `ceiling` allows (2 passes for 2).
    An entry's virtual finish time is the source's words up to and with it over the source's target; the merged queue
    is sorted by finish time and cut where the budget of words is used up. Running sums are two-level: sums of hash
    slices (pre-aggregated), then a window within a slice, so that neither a source nor the queue meets in one task.
    The cut is found on slice sums, and rows are ranked only in the slice where it falls.

    Null text has size 0; null is a source of its own, last. Documents of size 0 take 0 words. Repeated rows are
    separate documents. An empty table gives no rows. Columns besides the three named ones and `carry` are not read.
    Returns id, size, source, source_size, target, taken (size times the passes taken), and with `carry` the document's columns of those names as struct `rest`.
    """
    size = F.coalesce(F.regexp_count(quoted(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rest = [F.struct(*[quoted(x) for x in carry]).alias("rest")] if carry else []
    named = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (id_col, text_col)])
    lot = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")  # 60 bits, which any engine can follow
    base = docs.select(*rest, quoted(id_col).alias("id"), quoted(source_col).alias("source"), size.alias("size"), lot.alias("r"))
    base = table(base.withColumn("slice", F.shiftright("r", 48).cast("int")))
    slices = base.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    goal = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, budget, ceiling)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = slices.withColumn("ahead", ahead).join(goal.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
    plan = plan.select("source_", F.col("slice").alias("slice_"), "ahead", "source_size", "target")
    queue = base.join(plan, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slice") == F.col("slice_")))
    within = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("r", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    passes = range(1, math.ceil(ceiling) + 1)
    for e in passes:
        finish = (F.col("ahead") + within + F.lit(e - 1) * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
        queue = queue.withColumn(f"t{e}", F.when(F.col("size") > 0, finish))
    rest = ["rest"] if carry else []
    queue = table(queue.select(*rest, "id", "source", "size", "r", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), *[f"t{e}" for e in passes]))

    bin_of = lambda t: F.least(F.floor(F.col(t) * SLICES), F.lit((len(passes) + 2) * SLICES)).cast("int")
    entry = lambda e: F.struct(F.col(f"t{e}").alias("t"), F.col("r"), F.col("id"), F.lit(e).alias("e"))
    entries = queue.select("size", F.inline(F.array(*[F.struct(bin_of(f"t{e}").alias("b"), entry(e).alias("entry")) for e in passes]))).where("b is not null")
    words = goal.agg(F.round(F.sum("target"), 3)).first()[0] or 0.0
    bins = entries.groupBy("b").agg(F.sum("size").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    edge = bins.where(F.col("upto") > words).orderBy("b").first()  # the slice of the merged queue in which the budget ends
    if edge is None:
        taken = F.when(F.col("t1").isNull(), 0).otherwise(len(passes))
    else:
        at = entries.where(F.col("b") == edge["b"])
        used = F.lit(edge["upto"] - edge["n"]) + F.sum("size").over(Window.orderBy("entry").rowsBetween(Window.unboundedPreceding, 0))
        last = at.withColumn("used", used).where(F.col("used") <= words).agg(F.max("entry").alias("x")).first()["x"]
        inside = F.lit(False) if last is None else None
        fits = lambda e: inside if inside is not None else entry(e) <= F.struct(F.lit(last["t"]).alias("t"), F.lit(last["r"]).alias("r"), F.lit(last["id"]).cast(queue.schema["id"].dataType).alias("id"), F.lit(last["e"]).alias("e"))
        taken = sum(F.when(bin_of(f"t{e}") < edge["b"], 1).when((bin_of(f"t{e}") == edge["b"]) & fits(e), 1).otherwise(0) for e in passes)
    return queue.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"), *rest)
