"""Extractive summaries: sentences scored by term frequency and place, the best k in document order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.lines import any_of
from ..functions.text import let, present, step, strip, word_count


def is_reference_line(c: Column) -> Column:
    return let(strip(c), _like_reference)


def _like_reference(s: Column) -> Column:
    """Of a stripped line. All but two names hold a digit, and two names a comma, so most lines are asked no more than that."""
    numbered = any_of(s, (r"(?U)^\s*\[?\d+\]?\.?\s", X.DOI_ANY, r"(?iuU)\bvol\.\s*\d+.*\bpp?\.\s*\d+"))
    two_names = F.regexp_count(s, F.lit(r"(?U)[A-Z][a-z]+,\s+[A-Z]\.")) >= 2
    return (s == "") | (s.rlike(r"(?U)\d") & numbered) | (s.contains(",") & two_names)


def is_equation_like(c: Column) -> Column:
    return let(strip(c), _like_equation)


def _like_equation(s: Column) -> Column:
    n, letters, terms = F.char_length(s), F.char_length(F.regexp_replace(s, r"\P{L}+", "")), F.regexp_count(s, F.lit("[A-Za-z]{3,}"))
    return (n < 12) | let(terms, lambda t: (t < 3) | ((t < 6) & s.rlike(X.MATH))) | (letters < n * 0.6)


def clean_for_summary(c: Column) -> Column:
    """Prose lines as one paragraph; the stripped text where there are none."""
    lines = F.transform(F.split(present(c), "\n"), lambda x: strip(x))
    return let(F.array_join(F.filter(lines, lambda x: ~_like_reference(x) & ~_like_equation(x)), " "), lambda p: F.when(p == "", strip(present(c))).otherwise(p))


def split_sentences(c: Column) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def add(s: Column, x: Column) -> Column:
        whole = F.when(s["open"] == "", x).otherwise(strip(F.concat(s["open"], F.lit(" "), x)))
        # abbreviations are short: where a full stop is last, the pattern needs no more than the end of the sentence
        tail = lambda b: F.when(b.endswith("."), F.substring(b, -32, 32)).otherwise(b)
        return let(whole, lambda b: F.when(tail(b).rlike(X.SENTENCE_ABBREVIATION), F.struct(s["out"].alias("out"), b.alias("open"))).otherwise(F.struct(F.concat(s["out"], F.array(b)).alias("out"), F.lit("").alias("open"))))

    done = F.aggregate(F.split(c, X.SENTENCE_BOUNDARY), start, add, lambda s: F.concat(s["out"], F.array(s["open"])))
    return F.filter(F.transform(done, lambda x: strip(x)), lambda x: x != "")


def content_words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z][A-Za-z'-]{2,}"), F.lit(0)), lambda w: ~w.isin(*X.STOP_WORDS))


def term_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, n): counts of content words per document, pre-aggregated before the one shuffle."""
    return docs.select(id_col, F.explode(content_words(present(F.col(text_col)))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def _pick(k: int):
    """Scores the sentences of each row and joins the best k, a batch at a time. In rows, since a shuffle of every token of every document would
    cost far more. Scores are compared to 12 places, so that equal ones are ties however they were added up."""

    def run(rows: pa.Array) -> pa.Array:
        row = pc.list_parent_indices(rows).to_numpy()
        text, words, penalty = rows.flatten().flatten()
        sentence, n = pc.list_parent_indices(words).to_numpy(), len(row)
        codes = words.flatten().dictionary_encode()
        _, same, counts = np.unique(row[sentence] * max(1, len(codes.dictionary)) + codes.indices.to_numpy(), return_inverse=True, return_counts=True)
        count = counts[same]
        peak = np.ones(len(rows), np.int64)
        np.maximum.at(peak, row[sentence], count)
        first = np.searchsorted(row, np.arange(len(rows)))
        size = np.bincount(row, minlength=len(rows))
        place = (np.arange(n) - first[row]) / size[row]
        weight = np.where(place < 0.15, 1.5, np.where(place > 0.85, 1.2, 1.0))
        value = np.bincount(sentence, count, n) / peak[row] / (np.bincount(sentence, minlength=n) + 1) * weight * penalty.to_numpy()
        order = np.lexsort((np.arange(n), -np.round(value, 12), row))  # rows stay where they are, so a place in one tells the rank
        chosen = np.sort(order[np.arange(n) - first[row] < k])
        ends = np.concatenate([[0], np.cumsum(np.minimum(size, k))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text.take(pa.array(chosen))), " ")

    return run


def scored_sentences(c: Column) -> Column:
    """array of struct(text, words, penalty) of the text's sentences."""
    clean = F.substring(clean_for_summary(c), 1, X.SUMMARY_INPUT_CHARS)
    low = lambda s: F.when(word_count(s) < 6, 0.3).otherwise(1.0) * F.when(_like_reference(s), 0.1).otherwise(1.0) * F.when(_like_equation(s), 0.1).otherwise(1.0)
    return F.transform(split_sentences(clean), lambda s: F.struct(s.alias("text"), content_words(s).alias("words"), low(s).alias("penalty")))


def summarize(docs: DataFrame, text_col: str = "text", k: int = X.SUMMARY_SENTENCES, out_col: str = "summary") -> DataFrame:
    """Adds a summary of at most k sentences; '' for null and blank text. Ties go to the earlier sentence."""
    pick = F.arrow_udf(_pick(k), "string", F.ArrowUDFType.SCALAR)
    df = step(docs, __sentences=scored_sentences(F.col(text_col)))
    return df.withColumn(out_col, F.when(strip(present(F.col(text_col))) == "", "").otherwise(pick(F.col("__sentences")))).drop("__sentences")


def describe_reference_list(n: Column, kind: Column) -> Column:
    """A sentence on a document that is itself a list of references."""
    name = F.lower(kind)
    some = F.concat(F.lit("This document is a "), name, F.lit(" rather than a narrative text. "), n.cast("string"), F.lit(" entries were parsed from it, and each one is listed under Citations with its extracted fields."))
    none = F.concat(F.lit("This document is a "), name, F.lit(". No individual entries could be isolated from it, so the full text is available under Raw Text."))
    return F.when(n > 0, some).otherwise(none)
