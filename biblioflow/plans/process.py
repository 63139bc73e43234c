"""The whole way from documents to citations, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.derive import label
from ..functions.text import document_stats, normalize_document, present, squeeze, step
from ..operators.detect import detect
from ..operators.parse import is_reference, parse
from ..operators.segment import split_entries
from ..operators.style import vote_array
from ..operators.summarize import describe_reference_list, summarize


@dataclass(frozen=True)
class Options:
    force_parse: bool = False
    force_prose: bool = False
    summary_sentences: int = X.SUMMARY_SENTENCES
    build_summary: bool = True
    strip_furniture: bool = True


def characterise(docs: DataFrame, options: Options = Options(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """Documents with raw_text (normalised), stats, detection, entries, style and style_confidence. No shuffle.

    Rows whose text is blank have error_kind `empty_document`; an error that is there already stays.
    """
    pages = F.col("page_count") if "page_count" in docs.columns else F.lit(0)
    df = step(docs.drop("raw_text"), raw_text=normalize_document(F.col(text_col), options.strip_furniture))
    df = step(df, stats=document_stats(F.col("raw_text"), pages))
    df = detect(df, "raw_text", options.force_parse, options.force_prose)
    df = step(df, __block=F.col("detection.bibliography_text"))
    df = step(step(df, entries=split_entries(F.col("__block"))), __v=vote_array(F.col("entries")))
    had = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("error", "error_kind")]
    empty = squeeze(F.col("raw_text")) == ""
    df = df.withColumns({"style": F.col("__v.style"), "style_confidence": F.col("__v.style_confidence"), "error": F.coalesce(had[0], F.when(empty, "No text could be read from the document.")), "error_kind": F.coalesce(had[1], F.when(empty, "empty_document"))})
    return df.drop("__v", "__block")


def citations(characterised: DataFrame, keys: list[str], source_col: str | None = None, gate: bool = True) -> DataFrame:
    """One row per entry: keys, pos, the fields of a citation, source_file, accepted. The gate tells references from the rest; it drops none."""
    source = F.col(source_col) if source_col else F.lit("")
    rows = characterised.select(*keys, F.col("style").alias("__style"), present(source.cast("string")).alias("source_file"), F.posexplode("entries").alias("pos", "raw"))
    out = parse(rows, "raw", "__style").drop("raw")
    empty = {c: F.lit("") for c in ("address", "edition", "booktitle")}
    out = out.withColumns({**empty, "merged_sources": F.array().cast("array<string>"), "edited": F.lit(False)})
    return out.withColumn("accepted", is_reference() if gate else F.lit(True))


def process(docs: DataFrame, keys: list[str], options: Options = Options(), text_col: str = "text", source_col: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(documents, citations). Documents have no citations nested in them: join by the keys, or nest() for output."""
    base = characterise(docs, options, text_col)
    return base, citations(base, keys, source_col)


def with_summary(characterised: DataFrame, cited: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:  # noqa: B008
    """Documents with citation_count and summary: of the body, or a description where the document is a list itself."""
    counts = cited.groupBy(*keys).agg(F.count_if("accepted").alias("citation_count"), F.count_if(~F.col("accepted")).alias("discarded_count"))
    df = characterised.join(counts, keys, "left").withColumns({"citation_count": F.coalesce("citation_count", F.lit(0)), "discarded_count": F.coalesce("discarded_count", F.lit(0))})
    if not options.build_summary:
        return df.withColumn("summary", F.lit(""))
    df = df.withColumns({"__kind": F.col("detection.kind"), "__body": _summary_body()})
    return _summarized(df, options).drop("__kind", "__body")


def _is_list(kind: Column) -> Column:
    return kind.isin("bibliography", "annotated_bibliography")


def _summary_body() -> Column:
    """The text to summarise: none where the document is a list itself, which is described instead."""
    text = F.coalesce(F.nullif(F.col("detection.body_text"), F.lit("")), F.col("raw_text"))
    return F.when(F.coalesce(_is_list(F.col("detection.kind")), F.lit(False)), "").otherwise(text)


def _summarized(df: DataFrame, options: Options) -> DataFrame:
    """Adds the summary of __body, or a description by __kind and citation_count."""
    kind = F.col("__kind")
    described = describe_reference_list(F.col("citation_count"), label(kind, X.KIND_LABELS))
    return summarize(df, "__body", options.summary_sentences, "__s").withColumn("summary", F.when(_is_list(kind), described).otherwise(F.col("__s"))).drop("__s")


def summaries(characterised: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:  # noqa: B008
    """keys, kind, citation_count, discarded_count and summary of every document, in one pass where with_summary() joins two: what a document needs
    goes with the first of its entries (a document without any has one of no text, which isn't counted), and meets their counts in one grouping."""
    entries = F.when(F.size("entries") > 0, F.col("entries")).otherwise(F.array(F.lit("")))
    rows = characterised.select(*keys, "style", F.struct("detection", "raw_text").alias("__own"), F.posexplode(entries).alias("__at", "__entry"))
    rows = rows.select(*keys, "style", F.when(F.col("__at") == 0, F.col("__own")).alias("own"), F.array("__entry").alias("entries"))
    cited = citations(rows, [*keys, "own"]).where(F.col("own").isNotNull() | (F.col("raw_text") != ""))
    real = F.col("raw_text") != ""
    counts = cited.groupBy(*keys).agg(F.count_if(F.col("accepted") & real).alias("citation_count"), F.count_if(~F.col("accepted") & real).alias("discarded_count"), F.first("own", ignorenulls=True).alias("own"))
    df = counts.select(*keys, F.col("own.detection").alias("detection"), F.col("own.raw_text").alias("raw_text"), "citation_count", "discarded_count")
    df = df.select(*keys, F.col("detection.kind").alias("__kind"), _summary_body().alias("__body"), "citation_count", "discarded_count")
    df = _summarized(df, options) if options.build_summary else df.withColumn("summary", F.lit(""))
    return df.select(*keys, F.col("__kind").alias("kind"), "citation_count", "discarded_count", "summary")


def parse_pasted(pasted: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """References pasted as text: cut, one style for all, parsed, none turned away. Blank text gives no rows."""
    df = step(pasted, entries=split_entries(F.col(text_col))).withColumn("style", F.when(F.size("entries") > 1, vote_array(F.col("entries"))["style"]).otherwise("unknown"))
    return citations(df, keys, gate=False)


def nest(documents: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with their accepted citations and discarded ones as arrays, for the JSON sink."""
    row = F.struct("pos", *[c for c in cited.columns if c not in (*keys, "pos")])
    arrays = cited.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("accepted"), row))).alias("citations"), F.array_sort(F.collect_list(F.when(~F.col("accepted"), row))).alias("discarded"))
    return documents.join(arrays, keys, "left")
