"""Columns derived from the fields of a citation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import let, present, squeeze, strip, words

c = F.col


def full_name(a: Column) -> Column:
    return strip(F.concat_ws(" ", a["given"], a["family"]), " ")


def citation_name(a: Column) -> Column:
    return F.when((a["family"] != "") & (a["given"] != ""), F.concat(a["family"], F.lit(", "), a["given"])).when(a["family"] != "", a["family"]).otherwise(a["given"])


def initials(a: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.array(a["given"], a["family"]), lambda x: x.rlike(r"(?U)^\p{L}")), lambda x: F.upper(F.substring(x, 1, 1))), "")


def names(authors: Column) -> Column:
    return F.transform(authors, lambda a: citation_name(a))


def cite_key() -> Column:
    """family_year_word: lower case, the first title word that is no article or preposition."""
    family = F.replace(F.lower(present(F.try_element_at(c("authors"), F.lit(1))["family"])), F.lit(" "), F.lit(""))
    title_words = F.transform(words(c("title")), lambda w: F.lower(strip(w, ",.;:\"'")))
    word = present(F.try_element_at(F.filter(title_words, lambda w: (w != "") & ~w.isin(*X.KEY_SKIP_WORDS)), F.lit(1)))
    parts = F.filter(F.array(family, c("year"), word), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise("unknown")


def author_string() -> Column:
    def join(n: Column) -> Column:
        k = F.size(n)
        return F.when(k == 0, "").when(k == 1, n[0]).when(k == 2, F.array_join(n, " & ")).otherwise(F.concat(F.array_join(F.slice(n, 1, F.greatest(k - 1, F.lit(1))), ", "), F.lit(", & "), F.element_at(n, -1)))

    return F.when(F.size("authors") == 0, "").otherwise(let(names(c("authors")), join))


def short_author_string() -> Column:
    n, k = names(c("authors")), F.size("authors")
    return F.when(k == 0, "").when(k == 1, n[0]).when(k == 2, F.array_join(n, " & ")).otherwise(F.concat(n[0], F.lit(" et al.")))


def display_title() -> Column:
    raw = squeeze(c("raw_text"))
    short = let(raw, lambda r: F.when(r == "", "Empty entry").when(F.char_length(r) > 110, F.concat(F.rtrim(F.substring(r, 1, 110), F.lit(" ,;:-")), F.lit("..."))).otherwise(r))
    return F.when(c("title") != "", c("title")).otherwise(short)


def first_of(*columns: str) -> Column:
    return present(F.coalesce(*[F.nullif(c(x), F.lit("")) for x in columns]))


def venue() -> Column:
    return first_of("journal", "booktitle", "publisher")


def locator() -> Column:
    parts = [F.when(c(x) != "", F.concat(F.lit(label), c(x))) for x, label in (("volume", "vol. "), ("issue", "no. "), ("pages", "pp. "))]
    return F.concat_ws(", ", *parts)


def doi_url() -> Column:
    return F.when(c("doi") == "", c("url")).when(c("doi").startswith("http"), c("doi")).otherwise(F.concat(F.lit("https://doi.org/"), c("doi")))


def fields_found() -> Column:
    return sum(((c(x) != "").cast("int") for x in ("title", "year", "journal", "doi", "volume", "pages", "publisher")), F.lit(0)) + (F.size("authors") > 0).cast("int")


def confidence_band(score: Column | None = None) -> Column:
    s = c("confidence") if score is None else score
    return F.when(s >= X.HIGH, "high").when(s >= X.MEDIUM, "medium").otherwise("low")


def needs_review() -> Column:
    return c("confidence") < X.REVIEW


def missing_fields() -> Column:
    checks = (("title", c("title") == ""), ("authors", F.size("authors") == 0), ("year", c("year") == ""), ("venue", venue() == ""), ("DOI", c("doi") == ""))
    return F.filter(F.array(*[F.when(gone, name) for name, gone in checks]), lambda x: x.isNotNull())


def estimated_pages(word_count: Column, page_count: Column | None = None) -> Column:
    """The real page count, or words at 300 a page, rounded half to even; 1 at least for any word."""
    guess = F.when(word_count == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(word_count / X.WORDS_PER_PAGE).cast("int")))
    return guess if page_count is None else F.when(page_count > 0, page_count).otherwise(guess)


def reading_minutes(word_count: Column) -> Column:
    return F.when(word_count == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(word_count / X.WORDS_PER_MINUTE).cast("int")))


def label(value: Column, labels: dict[str, str], default: str = "Unknown") -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def style_label(style: Column) -> Column:
    return F.when(style == "unknown", "Unknown").otherwise(F.upper(style))
