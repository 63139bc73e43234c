"""Aggregates over runs, and precision and recall of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import names, needs_review

MEASURED = ("title", "authors", "year", "journal", "volume", "issue", "pages", "doi", "publisher")


def document_summary(citations: DataFrame, by: str | list[str] = "doc_id", accepted_col: str = "accepted") -> DataFrame:
    """Per document: citation_count, discarded_count, segment_count, average_confidence, flagged."""
    ok = F.col(accepted_col)
    return citations.groupBy(by).agg(
        F.count_if(ok).alias("citation_count"),
        F.count_if(~ok).alias("discarded_count"),
        F.count("*").alias("segment_count"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
        F.count_if(ok & needs_review()).alias("flagged"),
    )


def batch_summary(files: DataFrame) -> DataFrame:
    """One row over a table of files (error, citation_count, confidence_sum and, if it is there, duration_ms, which adds its sum and mean)."""
    cited = F.sum("citation_count")
    return files.agg(
        F.count("*").alias("file_count"),
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
        F.coalesce(cited, F.lit(0)).alias("citation_count"),
        F.count_if(F.col("citation_count") > 0).alias("files_with_citations"),
        F.coalesce(F.try_divide(F.sum("confidence_sum"), cited), F.lit(0.0)).alias("average_confidence"),
        *([F.sum("duration_ms").alias("duration_ms"), F.avg("duration_ms").alias("ms_per_file")] if "duration_ms" in files.columns else []),
    )


def has_citations() -> Column:
    return F.coalesce(F.col("citation_count"), F.lit(0)) > 0


def is_reference_only(kind: Column) -> Column:
    """Whether a document of this kind is nothing but a list of references."""
    return F.coalesce(kind.isin("bibliography", "annotated_bibliography"), F.lit(False))


def review_queue(citations: DataFrame) -> DataFrame:
    return citations.where(needs_review())


def tally(parsed: DataFrame, expected: str = "expected") -> DataFrame:
    """Per field: tp, fp, fn, precision, recall, f1, of parsed columns against a struct of expected ones (authors as `Family, Given`).

    An exact value is a hit; a wrong one is a false positive and a false negative; a rightly empty one counts for nothing.
    """

    def one(f: str) -> Column:
        got = names(F.col("authors")) if f == "authors" else F.array(F.trim(F.col(f)))
        want = F.col(f"{expected}.{f}") if f == "authors" else F.array(F.col(f"{expected}.{f}"))
        some = lambda x: F.array_join(x, "") != ""
        return F.struct(F.lit(f).alias("field"), (some(want) & (got == want)).alias("hit"), some(got).alias("got"), some(want).alias("want"))

    rows = parsed.select(F.inline(F.array(*[one(f) for f in MEASURED])))
    sums = rows.groupBy("field").agg(F.count_if("hit").alias("tp"), F.count_if(F.col("got") & ~F.col("hit")).alias("fp"), F.count_if(F.col("want") & ~F.col("hit")).alias("fn"))
    return sums.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0))}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )
