"""Sorting, searching, paging and editing of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.authors import parse_author_field
from ..functions.derive import author_string, display_title, needs_review, venue
from ..functions.text import present, strip
from .parse import score
from .ranking import placed, position_slice, text_slice

c = F.col


def order_columns(order: str, pos_col: str = "pos") -> list[Column]:
    """Sort columns; document order breaks ties, so that every order is stable."""
    year = lambda gone: F.when(c("year") == "", gone).otherwise(c("year"))
    orders = {
        "document": [],
        "confidence_asc": [c("confidence").asc()],
        "confidence_desc": [c("confidence").desc()],
        "year_desc": [year("0000").desc()],
        "year_asc": [year("9999").asc()],
        "title": [F.lower(display_title()).asc()],
    }
    return [*orders[order], c(pos_col).asc()]


def matches(query: str) -> Column:
    """Whether title, authors, year, venue, DOI or file contain the text, whatever the case."""
    hay = F.concat_ws(" ", display_title(), author_string(), c("year"), venue(), c("doi"), c("source_file"))
    return F.contains(F.lower(hay), F.lit(query.strip().lower()))


def browse(citations: DataFrame, order: str = "document", query: str = "", review_only: bool = False, page: int = 1, page_size: int = X.PAGE_SIZE, pos_col: str = "pos") -> DataFrame:
    """One page: filtered, sorted, cut by offset and limit (a top-k plan, no full sort of the table). A page number out of range is the first or the last page;
    rows are counted only for a page after the first."""
    df = citations.where(matches(query)) if query.strip() else citations
    df = df.where(needs_review()) if review_only else df
    page = max(page, 1) if page <= 1 else min(page, page_count(df, page_size).first()["pages"])
    return df.orderBy(*order_columns(order, pos_col)).offset(page_size * (page - 1)).limit(page_size)


def ranked(citations: DataFrame, order: str = "document", pos_col: str = "pos") -> DataFrame:
    """All rows with their `place` in the order, from 1."""
    sort = order_columns(order, pos_col)
    near = (position_slice(c(pos_col)), False)
    year = lambda gone: F.when(c("year") == "", gone).otherwise(c("year"))
    slices = {"document": [near], "confidence_asc": [(c("confidence"), False), near], "confidence_desc": [(c("confidence"), True), near], "year_asc": [(year("9999"), False), near], "year_desc": [(year("0000"), True), near], "title": [(text_slice(F.lower(display_title())), False)]}
    return placed(citations, slices[order], sort, "place")


def page_count(citations: DataFrame, page_size: int = X.PAGE_SIZE) -> DataFrame:
    return citations.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / page_size)).cast("long").alias("pages"))


def clamp_page(page: Column, pages: Column) -> Column:
    return F.greatest(F.lit(1), F.least(page, pages))


def edit(citations: DataFrame, edits: DataFrame, key: str = "pos") -> DataFrame:
    """Citations with the fields of `edits` (key and any of title, authors_text, year, volume, pages, journal, publisher, doi; null leaves a
    field) put in, marked edited and scored anew."""
    fields = [f for f in ("title", "year", "volume", "pages", "journal", "publisher", "doi") if f in edits.columns]
    e = edits.select(c(key).alias("__key"), *[c(f).alias(f"__{f}") for f in fields], *([c("authors_text").alias("__authors")] if "authors_text" in edits.columns else []))
    df = citations.join(e, c(key) == c("__key"), "left")
    new = {f: F.coalesce(strip(c(f"__{f}")), c(f)) for f in fields}
    if "authors_text" in edits.columns:
        new["authors"] = F.when(c("__authors").isNotNull(), parse_author_field(c("__authors"))).otherwise(c("authors"))
    was = c("edited") if "edited" in citations.columns else F.lit(False)
    df = df.withColumns({**new, "edited": was | c("__key").isNotNull()})
    fresh = score(c("title"), c("authors"), c("year"), c("doi"), F.concat("journal", "publisher"), c("volume"), c("pages"))
    df = df.withColumn("confidence", F.when(c("__key").isNotNull(), fresh).otherwise(c("confidence")))
    return df.drop(*[x for x in df.columns if x.startswith("__")])


def preview(text: Column, lines: int = X.PREVIEW_LINES) -> Column:
    return F.array_join(F.slice(F.split(present(text), "\n"), 1, lines), "\n")


def content_digest(content: Column, name: Column, *options: Column) -> Column:
    """Key under which a result can be reused: SHA-256 of content, name and options."""
    return F.sha2(F.concat(content.cast("binary"), name.cast("binary"), *[o.cast("string").cast("binary") for o in options]), 256)


def only_new(files: DataFrame, results: DataFrame, digest_col: str = "digest") -> DataFrame:
    """Files whose digest has no result yet."""
    return files.join(results.select(digest_col).distinct(), digest_col, "left_anti")


def numbered(citations: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Adds rank: the place in the order within each group."""
    return citations.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order_columns(order))))
