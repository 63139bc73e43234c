"""The citation style of a list, by vote of its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import let


def points(c: Column) -> dict[str, Column]:
    """Points of one entry for each style."""
    out = {style: F.lit(0.0) for style in X.STYLES}
    for style, worth, pattern in X.STYLE_SIGNALS:
        out[style] = out[style] + F.when(c.rlike(pattern), worth).otherwise(0.0)
    out["mla"] = out["mla"] + F.when(~c.rlike(r"(?U)\(\d{4}\)") & c.rlike(r"(?U)\d{4}"), 0.3).otherwise(0.0)
    return out


def verdict(totals: dict[str, Column], n: Column) -> Column:
    """struct(style, confidence): most points, ties in the order APA, MLA, IEEE, Chicago; weak votes are unknown."""
    best = F.greatest(*totals.values())
    style = F.coalesce(*[F.when(totals[s] == best, F.lit(s)) for s in X.STYLES])
    share = F.try_divide(best, sum(totals.values(), F.lit(0.0)))
    weak = best / F.greatest(n, F.lit(1)) < 0.3
    return F.struct(
        F.when(F.coalesce(best, F.lit(0.0)) == 0, "unknown").when(weak, "unknown").otherwise(style).alias("style"),
        F.when(F.coalesce(best, F.lit(0.0)) == 0, 0.0).when(weak, share * 0.5).otherwise(F.least(F.lit(1.0), share)).alias("style_confidence"),
    )


def vote_array(entries: Column) -> Column:
    """The verdict over an array of entries, within the row."""
    scored = F.transform(entries, lambda e: F.struct(*[p.alias(s) for s, p in points(e).items()]))
    total = lambda a, s: F.aggregate(F.transform(a, lambda x: x[s]), F.lit(0.0), lambda t, x: t + x)
    return let(scored, lambda a: verdict({s: total(a, s) for s in X.STYLES}, F.size(a)))


def vote(entries: DataFrame, by: list[str], raw_col: str = "raw") -> DataFrame:
    """The verdict for each list of an entry table: one pre-aggregated grouping."""
    scored = points(F.col(raw_col))
    sums = entries.groupBy(*by).agg(*[F.sum(p).alias(f"__{s}") for s, p in scored.items()], F.count("*").alias("__n"))
    return sums.select(*by, verdict({s: F.col(f"__{s}") for s in X.STYLES}, F.col("__n")).alias("v")).select(*by, "v.style", "v.style_confidence")
