"""Merging of entries that are certainly the same work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_form, present, squeeze, strip

COUNTED = ("title", "year", "journal", "volume", "issue", "pages", "doi", "publisher")


def normalize_doi(c: Column) -> Column:
    v = F.lower(strip(present(c)))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        v = F.regexp_replace(v, "^" + prefix.replace(".", r"\."), "")
    return strip(v)


def normalize_title(c: Column) -> Column:
    """Lower case, without accents and punctuation."""
    folded = F.regexp_replace(normal_form(present(c), "NFKD"), r"\p{M}", "")
    return squeeze(F.regexp_replace(F.lower(folded), r"(?U)[^\w\s]+", " "))


def duplicate_key(doi: Column, title: Column, year: Column) -> Column:
    """doi:..., else work:title|year, else null: never merged."""
    d, t = normalize_doi(doi), normalize_title(title)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when((t != "") & (year != ""), F.concat(F.lit("work:"), t, F.lit("|"), year))


def completeness() -> Column:
    n = sum(((F.col(x) != "").cast("int") for x in COUNTED), F.lit(0)) + (F.size("authors") > 0).cast("int")
    return F.struct(n.alias("n"), F.col("confidence").alias("confidence"))


def deduplicate(citations: DataFrame, pos_col: str = "pos") -> DataFrame:
    """One row per work: the most complete record (the earliest of equals), at the place of the first, with the files of all.

    Adds `copies`. Rows without a key pass through. The order of merged_sources is that of folding records in order, each new best in front:
    files of records that beat all before them, latest first, then the others'. Records are reduced per (work, completeness) and
    (work, file), both with partial aggregates, so that no work's records meet in one task; what is collected per work is its
    distinct files.
    """
    own = [c for c in citations.columns if c != "merged_sources"]
    given = F.col("merged_sources") if "merged_sources" in citations.columns else F.array().cast("array<string>")
    files = F.filter(F.when(F.size(given) > 0, given).otherwise(F.array("source_file")), lambda x: x != "")
    df = citations.withColumns({"__key": duplicate_key(F.col("doi"), F.col("title"), F.col("year")), "__full": completeness(), "__files": F.coalesce(files, F.array().cast("array<string>")), "merged_sources": F.coalesce(given, F.array().cast("array<string>"))})
    keyed = df.where("__key is not null")
    row = F.struct(*own, "merged_sources")
    best = keyed.groupBy("__key").agg(F.max_by(row, F.struct("__full", (-F.col(pos_col)).alias("p"))).alias("__best"), F.min(pos_col).alias("__first"), F.count("*").alias("copies"))
    # first record of each level of completeness; those above every earlier level led at their time
    levels = keyed.groupBy("__key", "__full").agg(F.min(F.struct(F.col(pos_col).alias("p"), F.col("__files").alias("f"))).alias("x"))
    before = F.max("__full").over(Window.partitionBy("__key").orderBy("x.p").rowsBetween(Window.unboundedPreceding, -1))
    led = levels.withColumn("__before", before).where("__before is null or __full > __before").select("__key", F.posexplode("x.f").alias("i", "file"), F.struct(F.lit(0).alias("class"), (-F.col("x.p")).alias("at"), F.col("i")).alias("rank"))
    rest = keyed.select("__key", pos_col, F.posexplode("__files").alias("i", "file")).groupBy("__key", "file").agg(F.min(F.struct(F.lit(1).alias("class"), F.col(pos_col).alias("at"), F.col("i"))).alias("rank"))
    ranked = led.select("__key", "file", "rank").union(rest.select("__key", "file", "rank")).groupBy("__key", "file").agg(F.min("rank").alias("rank"))
    sources = ranked.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("rank", "file"))).alias("s")).select(F.col("__key").alias("__k"), F.transform("s", lambda x: x["file"]).alias("__sources"))
    merged = best.join(sources, F.col("__key") == F.col("__k"), "left")
    kept = merged.select(*[F.col("__best")[c].alias(c) for c in own], F.when(F.col("copies") > 1, F.coalesce("__sources", F.array().cast("array<string>"))).otherwise(F.col("__best")["merged_sources"]).alias("merged_sources"), "copies", F.col("__first").alias("__at"))
    alone = df.where("__key is null").select(*own, "merged_sources", F.lit(1).cast("long").alias("copies"), F.col(pos_col).alias("__at"))
    return kept.union(alone).withColumn(pos_col, F.col("__at")).drop("__at")


def duplicate_count(citations: DataFrame) -> DataFrame:
    """One row: removed, the number of records that were the same work as an earlier one."""
    key = duplicate_key(F.col("doi"), F.col("title"), F.col("year"))
    return citations.select(key.alias("k")).where("k is not null").groupBy("k").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removed"))
