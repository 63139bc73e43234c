"""A training corpus from raw documents: quality, near-duplicates, repeated passages, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm import _shared, decontaminate, mixing, quality, simhash, substring_dedup

#: Documents scored below this are rejected.
QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labelled documents of docs, without the held-out fifth.

    Null and empty texts are scored as texts of no words; repeated rows share a score; rows without an id teach nothing; very long texts are scored whole.
    """
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable)
    return docs.where(quality.score(docs, model) >= QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash group.

    Null and empty texts have fingerprint zero and so form a group; a repeated row stays once, of rows that share an id that of least text stays; rows without
    an id form groups by text like any, and stay, one of a group, only where no row of the group has an id.
    """
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has. A document of which nothing is left goes.

    Null, empty and short texts lose nothing; rows that share an id are one document; rows without an id lose nothing and take nothing from others.
    """
    carried = tuple(c for c in docs.columns if c != "text")
    out = substring_dedup.dedup(docs, carry=carried).where("n_removed = 0 or n_removed < n_words")
    fresh = {"text": F.col("kept")}
    if "n_chars" in carried:
        own = F.col("rest")["n_chars"]
        fresh["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(own).cast(docs.schema["n_chars"].dataType)
    return out.select(*[(fresh[c] if c in fresh else F.col("rest")[c]).alias(c) for c in docs.columns])


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. One window is enough to go, however long the document: the twentieth of the words that
    marks a document as contaminated would let whole items through in long ones.

    Null, empty and wordless texts hold no window and stay; repeated rows are judged alike.
    """
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(docs.columns))
    return found.where("n_hit = 0").select(*[F.col("rest")[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with the words taken of each (its size once or twice) and its source's target. Null and repeated ids are documents like any.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own. The columns size, source_size, target and taken are the
    mixture's; columns of docs that have these names already follow as size_, source_size_ and so on.
    """
    found = ["size", "source_size", "target", "taken"]
    # rows are numbered once, in a written table: texts would take an executor's memory in mix()'s windows, and ids may be null or repeat
    row = _shared.fresh(docs, "row_")
    docs = _shared.table(docs.withColumn(row, F.monotonically_increasing_id()))
    own = [c for c in docs.columns if c != row]
    mixed = mixing.mix(docs, carry=(row,)).where("taken > 0").select(F.col("rest")[row].alias("row"), *found)
    kept = docs.select(F.col(row).alias("row_number"), F.struct(*[_shared.quoted(c) for c in own]).alias("own")).join(mixed.withColumnRenamed("row", "row_number"), "row_number")
    taken = {c.lower() for c in [*own, *found]}

    def renamed(c: str) -> str:
        if c.lower() not in found:
            return c
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        return c

    return kept.select(*[F.col("own")[c].alias(renamed(c)) for c in own], *found)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("benchmark_filter", benchmark_filter),
    ("mixture", mixture),
]

#: A classifier and SimHash groups are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage wrote on its way, and its input, are deleted once its result is written;
    the last one's are read by the result, so they stay."""
    docs, behind = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with _shared.written() as paths:
            docs = _shared.table(stage(spark, docs, sf_dir))
        _shared.delete(spark, behind + paths[:-1])
        behind = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
