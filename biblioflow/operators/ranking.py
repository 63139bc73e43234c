"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive positions that share a slice.
SLICE = 65_536


def position_slice(pos: Column) -> Column:
    return F.floor(pos / SLICE)


def text_slice(key: Column) -> Column:
    """The first characters of a sort key, which sort as the keys do."""
    return F.substring(key, 1, 3)


def placed(df: DataFrame, slices: Sequence[tuple[Column, bool]], order: Sequence[Column], out: str) -> DataFrame:
    """Adds `out`, the place of each row in `order`, from 1.

    `slices` are columns, with whether they descend, whose order is a coarser form of `order`. Rows are numbered within a slice; sizes of slices
    (pre-aggregated) give what is ahead of each.
    """
    names = [f"__slice{i}" for i in range(len(slices))]
    df = df.withColumns(dict(zip(names, (s for s, _ in slices), strict=True)))
    sort = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, slices, strict=True)]
    before = F.sum("__n").over(Window.orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1))
    sizes = df.groupBy(*names).agg(F.count("*").alias("__n")).select(*[F.col(n).alias(f"{n}_") for n in names], F.coalesce(before, F.lit(0)).alias("__ahead"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    numbered = df.join(sizes, same).withColumn(out, F.col("__ahead") + F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return numbered.drop(*names, *[f"{n}_" for n in names], "__ahead")
