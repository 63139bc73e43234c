"""Fields of one reference, as columns. What can't be confirmed is the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.authors import AUTHORS, author_span
from ..functions.lines import any_of
from ..functions.text import extract, let, matched, normalize_unicode, present, squeeze, step, strip, tidy_field, word_count

TEXT_FIELDS = ("title", "year", "journal", "volume", "issue", "pages", "doi", "url", "publisher", "address", "edition", "booktitle", "raw_text", "style", "entry_type", "source_file")
FIELDS = (*TEXT_FIELDS[:9], "authors", "raw_text", "style", "entry_type", "confidence")


def extract_doi(c: Column) -> Column:
    return F.rtrim(extract(c, X.DOI), F.lit(".,;"))


def extract_url(c: Column) -> Column:
    return F.rtrim(extract(c, X.WEB), F.lit(".,;"))


def masked(c: Column) -> Column:
    """Without web addresses, DOIs and arXiv numbers, whose digits mean nothing else."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, X.WEB, " "), X.DOI, " "), X.ARXIV, " ")


def extract_year(c: Column) -> Column:
    """A year in parentheses, else the first one that is no part of a range."""
    bare = extract(masked(c), r"(?U)(?<!-)" + X.YEAR.removeprefix("(?U)") + "(?!-)")
    return F.when(c.rlike(X.YEAR_PAREN), extract(c, r"(?U)\(((?:19|20)\d{2})[a-z]?\)", 1)).otherwise(bare)


def is_annotation_line(c: Column) -> Column:
    def judge(s: Column) -> Column:
        cited = any_of(s, (X.YEAR, X.DOI, X.ARXIV, X.CONTRIBUTOR, X.MONOGRAPH_PAGES, "(?U)^" + X.INVERTED)) | looks_like_publisher(s)
        return (word_count(s) >= X.ANNOTATION_LINE_WORDS) & ~cited

    return let(strip(c), judge)


def looks_like_publisher(c: Column) -> Column:
    return F.lower(c).rlike("|".join(X.PUBLISHER_WORDS))


def split_header(c: Column) -> Column:
    """The citation proper: the first block up to its commentary."""
    block = F.split(strip(c), X.BLANK_LINE)[0]

    def cut(s: Column) -> Column:
        n, comment = F.size(s["lines"]), s["comment"]
        first = F.array_position(F.slice(comment, 3, F.greatest(n, F.lit(1))), True)  # commentary from the third line on
        plain = F.array_position(F.reverse(comment), False)
        end = F.greatest(F.when(plain == 0, 0).otherwise(n - plain + 1), F.lit(1))
        top = lambda k: F.array_join(F.slice(s["lines"], 1, k.cast("int")), "\n")
        long_tail = (n > 3) & (word_count(F.array_join(F.slice(s["lines"], 4, F.greatest(n, F.lit(1))), " ")) >= X.ANNOTATION_WORDS)
        return F.when(n < 2, s["block"]).when(first > 0, top(first + 1)).when(end < n, top(end)).when(long_tail, top(F.lit(3))).otherwise(s["block"])

    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: strip(x) != "")
    # only a block of several lines can hold commentary
    looked_at = lambda b: let(lines(b), lambda x: let(F.struct(b.alias("block"), x.alias("lines"), F.transform(x, is_annotation_line).alias("comment")), cut))
    return let(block, lambda b: F.when(b.contains("\n"), looked_at(b)).otherwise(b))


def safe_sentences(c: Column) -> Column:
    """Sentences; initials and abbreviations don't end one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def add(s: Column, x: Column) -> Column:
        return let(
            F.when(s["open"] == "", x).otherwise(strip(F.concat(s["open"], F.lit(" "), x))),
            lambda b: F.when(b.rlike(X.INITIAL_END) | b.rlike(X.ABBREVIATION_END), F.struct(s["out"].alias("out"), b.alias("open"))).otherwise(F.struct(F.concat(s["out"], F.array(b)).alias("out"), F.lit("").alias("open"))),
        )

    done = F.aggregate(F.split(c, r"(?U)(?<=[.!?])\s+"), start, add, lambda s: F.concat(s["out"], F.array(s["open"])))
    return F.filter(F.transform(done, lambda x: strip(x)), lambda x: x != "")


def is_plausible_title(c: Column, author_region: Column) -> Column:
    names = F.regexp_count(c, F.lit(r"[A-Za-z]{3,}"))
    echo = (author_region != "") & author_region.contains(strip(c, " .,"))
    return (
        F.char_length(c).between(6, 300)
        & ~any_of(c, (X.LOCATOR_ONLY, X.DOI, X.WEB, X.ARXIV))
        & ~F.lower(c).rlike("|".join(X.NOT_TITLE))
        & (names >= 2)
        & ~echo
        & ~((F.regexp_count(c, F.lit(r"(?U)\b[A-Z]\.")) >= 2) & (names < 5))
    )


def _before(c: Column, pattern: str) -> Column:
    """Text before the first match, null without one."""
    return F.when(c.rlike(pattern), F.substring(c, F.lit(1), F.regexp_instr(c, F.lit(pattern)) - 1))


def _sentence_after(c: Column, pattern: str) -> Column:
    """What follows the first match, up to a full stop; null without a match."""
    return F.when(c.rlike(pattern), F.split(strip(extract(c, pattern + r"([\s\S]*)$", 1)), r"(?U)\.\s|\.$", 2)[0])


def extract_title(body: Column, rest: Column, region: Column) -> Column:
    """First plausible of: a quoted title; what stands before the venue, or an arXiv number; the sentence after the year; capitals; the first
    sentence after the authors; the longest."""
    shout = strip(matched(body, X.CAPITALS))
    sentences = F.filter(safe_sentences(rest), lambda s: F.char_length(s) > 10)
    longest = lambda a: F.filter(a, lambda s: F.char_length(s) == F.array_max(F.transform(a, F.char_length)))
    marked = F.array(
        matched(body, r'"([^"]{4,300})"'),
        _before(rest, X.VENUE_TAIL),
        _before(rest, X.ARXIV),
        _sentence_after(body, X.YEAR_PAREN + r"\.?\s*"),
        _sentence_after(body, r"(?U)[.,]\s*(?:19|20)\d{2}[a-z]?\.\s+"),
        F.when(~shout.rlike(X.CAPITALS_IMPRINT), shout),
    )
    spoken = let(sentences, lambda a: F.array(F.try_element_at(a, F.lit(1)), F.try_element_at(longest(a), F.lit(1))))
    clean = lambda x: strip(strip(tidy_field(strip(x, " ,.;")), '"'))

    def first(candidates: Column) -> Column:
        """Cleaned and judged one by one until one will do, which is dear; null where none does."""
        judge = lambda x: F.when(x.isNotNull(), let(clean(x), lambda y: F.when(is_plausible_title(y, region), y)))
        return F.aggregate(candidates, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, judge(x)))

    return F.coalesce(first(marked), first(spoken), F.lit(""))


def _after_title(c: Column, title: Column) -> Column:
    at = F.instr(c, title)
    return F.when((title != "") & (at > 0), F.substring(c, at + F.char_length(title), F.char_length(c))).otherwise(c)


def extract_journal(header: Column, title: Column, rest: Column) -> Column:
    named = tidy_field(F.rtrim(strip(extract(rest, X.VENUE_TAIL, 1)), F.lit(",")), 120)
    leading, labelled, inside = X.JOURNALS
    # the labelled form tries every letter of the text as a start, so its end is looked for first
    found = lambda s: F.array(matched(s, leading), F.when(s.rlike(r"(?iuU),\s*vol\.?\s*\d"), matched(s, labelled)), matched(s, inside))
    clean = F.transform(F.filter(let(_after_title(header, title), found), lambda x: x.isNotNull()), lambda x: tidy_field(x, 120))
    fits = lambda x: (F.char_length(x) >= 4) & ~x.rlike(X.LOCATOR_ONLY) & ~((title != "") & F.contains(F.lower(title), F.lower(x))) & ~looks_like_publisher(x)
    fallback = present(F.try_element_at(F.filter(clean, fits), F.lit(1)))
    return let(named, lambda x: F.when((F.char_length(x) >= 3) & ~looks_like_publisher(x), x).otherwise(fallback))


def _first(*options: Column) -> Column:
    """First that is neither null nor empty, else ''."""
    return present(F.coalesce(*[F.nullif(o, F.lit("")) for o in options]))


def extract_locators(header: Column, rest: Column) -> Column:
    """struct(volume, issue, pages)"""

    def find(m: Column) -> Column:
        return let(F.regexp_replace(m, X.YEAR_PAREN, " "), lambda x: let(extract(x, X.BARE_VOLUME, 1), lambda bare: gather(m, x, bare)))

    def gather(m: Column, no_years: Column, bare: Column) -> Column:
        bare_ok = (bare != "") & ~((F.char_length(bare) == 4) & F.try_to_number(bare, F.lit("9999")).between(1000, 2100))
        volume = _first(extract(rest, X.VENUE_TAIL, 2), extract(m, X.VOLUME_LABEL, 1), extract(no_years, X.VOLUME_ISSUE, 1))
        issue = _first(extract(m, X.ISSUE_LABEL, 1), extract(no_years, X.VOLUME_ISSUE, 2))
        pages = _first(extract(rest, X.VENUE_TAIL, 3), F.replace(extract(m, X.PAGES_LABEL, 1), F.lit(" "), F.lit("")), extract(m, X.MONOGRAPH_PAGES, 1))
        return let(F.struct(volume.alias("v"), issue.alias("i"), pages.alias("p"), bare.alias("b"), bare_ok.alias("ok")), lambda s: F.struct(
            F.when((s["v"] == "") & s["ok"], s["b"]).otherwise(s["v"]).alias("volume"),
            s["i"].alias("issue"),
            _first(s["p"], F.when((s["v"] == "") & s["ok"], extract(no_years, X.BARE_VOLUME, 2)), _page_range(m)).alias("pages"),
        ))

    return let(masked(header), find)


def _page_range(m: Column) -> Column:
    """The first rising range that is neither a span of calendar years nor wider than 500."""
    pairs = F.arrays_zip(F.regexp_extract_all(m, F.lit(X.PAGE_RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(m, F.lit(X.PAGE_RANGE), F.lit(2)).alias("b"))
    number = lambda r: (F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(2)))
    ranges = F.transform(pairs, lambda r: F.array(r["a"].cast("int"), r["b"].cast("int"), F.char_length(r["a"]), F.char_length(r["b"])))

    def ok(r: Column) -> Column:
        a, b = number(r)
        years = (r[2] == 4) & (r[3] == 4) & (a >= 1000) & (b <= 2100)
        return (b > a) & ~years & (b - a <= 500)

    return let(F.try_element_at(F.filter(ranges, ok), F.lit(1)), lambda r: F.when(r.isNotNull(), F.concat(r[0].cast("string"), F.lit("-"), r[1].cast("string"))))


def extract_publisher(header: Column, title: Column) -> Column:
    clean = F.transform(F.filter(let(_after_title(header, title), lambda s: F.array(*[matched(s, p) for p in X.PUBLISHERS])), lambda x: x.isNotNull()), lambda x: tidy_field(x, 80))
    fits = lambda x: (F.char_length(x) > 2) & ~((title != "") & F.contains(F.lower(title), F.lower(x)))
    return present(F.try_element_at(F.filter(clean, fits), F.lit(1)))


def entry_type(text: Column, journal: Column, volume: Column, publisher: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("proceedings|conference|symposium|workshop"), "inproceedings")
        .when(low.rlike("thesis|dissertation"), "thesis")
        .when(low.rlike(r"technical report|tech\. rep\.|report no\."), "report")
        .when(low.contains("chapter") & text.rlike(r"(?U)\bin\s+[A-Z]"), "incollection")
        .when(low.rlike("press|publisher|edition|chapter"), "book")
        .when((journal != "") | (volume != ""), "article")
        .when(publisher != "", "book")
        .when(low.rlike(r"(?U)vol\.?\s*\d|\d+\s*\(\d+\)|pp?\.\s*\d"), "article")
        .otherwise("misc")
    )


def score(title: Column, authors: Column, year: Column, doi: Column, venue: Column, volume: Column, pages: Column) -> Column:
    """Completeness, 0 to 1: a fifth each for title, authors, year, DOI and venue, a tenth each for volume and pages."""
    has = lambda c: (c != "").cast("double")
    return F.least(F.lit(1.0), (has(title) + (F.size(authors) > 0).cast("double") + has(year) + has(doi) + has(venue) + 0.5 * has(volume) + 0.5 * has(pages)) / 5)


def is_reference(df_col=F.col) -> Column:
    """Whether parsed fields are evidence of a reference at all."""
    c = df_col
    author, year = F.size(c("authors")) > 0, c("year") != ""
    venue, locator = (c("journal") != "") | (c("publisher") != ""), (c("volume") != "") | (c("pages") != "")
    return (c("doi") != "") | (author & (year | venue)) | ((c("url") != "") & (year | author)) | ((c("title") != "") & venue & (year | locator))


def parse(entries: DataFrame, raw_col: str = "raw", style_col: str | None = None) -> DataFrame:
    """Adds the fields of a citation to a table of entries; columns of those names are replaced.

    One projection per step, so that no expression is computed twice; the one step in Python (Unicode normal form) is an Arrow
    batch. Null and blank entries have empty fields and confidence 0.
    """
    style = F.col(style_col) if style_col else F.lit("unknown")
    df = step(entries, __raw=normalize_unicode(F.col(raw_col)), __named=style)
    df = step(df, __header=squeeze(split_header(F.col("__raw"))))
    df = step(df, __body=F.regexp_replace("__header", X.ENTRY_PREFIX, ""))
    df = step(step(df, __span=author_span(F.col("__body"))), __region=F.substring(F.col("__body"), F.lit(1), F.col("__span.end")), __rest=F.substring(F.col("__body"), F.col("__span.end") + 1, F.char_length("__body")))
    raw, header, body, rest = (F.col(f"__{x}") for x in ("raw", "header", "body", "rest"))
    df = step(df, __title=extract_title(body, rest, F.col("__region")), __doi=extract_doi(raw))
    title = F.col("__title")
    df = step(df, __journal=extract_journal(header, title, rest), __loc=extract_locators(header, rest), __publisher=extract_publisher(header, title), __year=extract_year(header))
    number = F.when(F.col("__doi") == "", F.nullif(extract(rest, X.ARXIV, 1), F.lit("")))
    url, year = extract_url(raw), F.col("__year")
    df = df.withColumns({
        "__url": _first(url, F.concat(F.lit("https://arxiv.org/abs/"), number)),
        "__year": _first(year, F.concat(F.lit("20"), F.substring(number, 1, 2))),
        "__journal": _first(F.col("__journal"), F.when(number.isNotNull(), "arXiv preprint")),
    })
    moved = (F.col("__journal") != "") & looks_like_publisher(F.col("__journal"))
    df = df.withColumns({"__publisher": F.when(moved, _first(F.col("__publisher"), F.col("__journal"))).otherwise(F.col("__publisher")), "__journal": F.when(moved, "").otherwise(F.col("__journal"))})
    out = {
        "title": title, "authors": F.coalesce(F.col("__span.authors"), F.array().cast(AUTHORS)), "year": F.col("__year"), "journal": F.col("__journal"),
        "volume": F.col("__loc.volume"), "issue": F.col("__loc.issue"), "pages": F.col("__loc.pages"), "doi": F.col("__doi"), "url": F.col("__url"), "publisher": F.col("__publisher"),
        "raw_text": strip(raw), "style": F.col("__named"),
    }
    df = df.withColumns(out)
    c = F.col
    df = df.withColumns({"entry_type": entry_type(raw, c("journal"), c("volume"), c("publisher")), "confidence": score(c("title"), c("authors"), c("year"), c("doi"), F.concat("journal", "publisher"), c("volume"), c("pages"))})
    return df.drop(*[x for x in df.columns if x.startswith("__")])
