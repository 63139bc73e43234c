"""References rendered in four styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.derive import doi_url, first_of
from ..functions.text import let, present, strip, words
from .ranking import placed, position_slice, text_slice

c = F.col


def initialise(given: Column) -> Column:
    """A given name as initials; those already reduced stay."""
    parts = words(strip(F.replace(given, F.lit("."), F.lit(". "))))
    short = lambda p: F.when(p.rlike(r"^[A-Z]\.?(?:-[A-Z]\.?)?$"), F.when(p.endswith("."), p).otherwise(F.concat(p, F.lit(".")))).when(p.rlike(r"(?U)^\p{L}"), F.concat(F.upper(F.substring(p, 1, 1)), F.lit(".")))
    return F.array_join(F.filter(F.transform(parts, short), lambda x: x.isNotNull()), " ")


def _name(a: Column, inverted: bool, short: bool) -> Column:
    given = initialise(a["given"]) if short else strip(a["given"])
    both = (lambda g: F.concat(a["family"], F.lit(", "), g)) if inverted else (lambda g: F.concat(g, F.lit(" "), a["family"]))
    return let(given, lambda g: F.when((a["family"] != "") & (g != ""), both(g)).when(a["family"] != "", a["family"]).otherwise(g))


def _people() -> Column:
    return F.filter("authors", lambda a: (a["family"] != "") | (a["given"] != ""))


def _but_last(n: Column) -> Column:
    return F.array_join(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(1))), ", ")


def author_list(style: str) -> Column:
    def apa(p: Column) -> Column:
        n = F.transform(p, lambda a: _name(a, True, True))
        return let(n, lambda n: F.when(F.size(n) == 1, n[0]).otherwise(F.concat(_but_last(n), F.lit(", & "), F.element_at(n, -1))))

    def mla(p: Column) -> Column:
        first = _name(p[0], True, False)
        return F.when(F.size(p) == 1, first).when(F.size(p) == 2, F.concat(first, F.lit(", and "), _name(F.element_at(p, -1), False, False))).otherwise(F.concat(first, F.lit(", et al.")))

    def ieee(p: Column) -> Column:
        n = F.transform(p, lambda a: _name(a, False, True))
        return let(n, lambda n: F.when(F.size(n) == 1, n[0]).when(F.size(n) > 6, F.concat(n[0], F.lit(" et al."))).otherwise(F.concat(_but_last(n), F.lit(", and "), F.element_at(n, -1))))

    def chicago(p: Column) -> Column:
        n = F.transform(p, lambda a, i: F.when(i == 0, _name(a, True, False)).otherwise(_name(a, False, False)))
        return let(n, lambda n: F.when(F.size(n) == 1, n[0]).when(F.size(n) > 3, F.concat(n[0], F.lit(", et al."))).otherwise(F.concat(_but_last(n), F.lit(", and "), F.element_at(n, -1))))

    form = {"apa": apa, "mla": mla, "ieee": ieee, "chicago": chicago}[style]
    return let(_people(), lambda p: F.when(F.size(p) == 0, "").otherwise(form(p)))


def standalone() -> Column:
    return c("entry_type").isin("book", "thesis", "report")


def container() -> Column:
    """The publisher of a work that stands alone, else the journal or book it is in."""
    return F.when(standalone(), first_of("publisher", "booktitle", "journal")).otherwise(first_of("journal", "booktitle", "publisher"))


def sentence(v: Column) -> Column:
    """Closed by exactly one terminal mark; '' stays ''."""
    return let(F.rtrim(strip(v), F.lit(",;")), lambda x: F.when(x == "", "").when(x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))


def _present(value: str | Column, before: str = "", after: str = "") -> Column:
    v = c(value) if isinstance(value, str) else value
    return F.when(v != "", F.concat(F.lit(before), v, F.lit(after)))


def _segments(*parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda x: strip(x)), lambda x: x != ""), " ")


def _title() -> Column:
    return F.when(c("title") == "", "").when(standalone(), sentence(c("title"))).otherwise(F.concat(F.lit('"'), c("title"), F.lit('."')))


def _apa() -> Column:
    volume = F.when(c("volume") != "", F.concat(c("volume"), F.when(c("issue") != "", F.concat(F.lit("("), c("issue"), F.lit(")"))).otherwise("")))
    tail = F.concat_ws(", ", _present(container()), volume, _present("pages"))
    return _segments(sentence(author_list("apa")), present(_present("year", "(", ").")), sentence(c("title")), sentence(tail), doi_url())


def _mla() -> Column:
    tail = F.concat_ws(", ", _present(container()), _present("volume", "vol. "), _present("issue", "no. "), _present("year"), _present("pages", "pp. "))
    return _segments(sentence(author_list("mla")), _title(), sentence(tail), doi_url())


def _ieee() -> Column:
    tail = F.concat_ws(", ", _present(container()), _present("volume", "vol. "), _present("issue", "no. "), _present("pages", "pp. "), _present("year"))
    title = F.when(c("title") == "", "").when(standalone(), sentence(c("title"))).otherwise(F.concat(F.lit('"'), c("title"), F.lit(',"')))
    return _segments(present(_present(author_list("ieee"), after=",")), title, sentence(tail), present(_present("doi", "doi: ", ".")))


def _chicago() -> Column:
    place = F.when((c("address") != "") & (container() != ""), F.concat(c("address"), F.lit(": "), container())).otherwise(container())
    imprint = F.concat_ws(", ", _present(place), _present("year"))
    numbered = strip(F.concat_ws(" ", _present(container()), _present("volume")))
    issued = F.concat_ws(", ", _present(numbered), _present("issue", "no. "))
    dated = F.concat_ws(" ", _present(issued), _present("year", "(", ")"))
    paged = F.concat_ws(": ", _present(dated), _present("pages"))
    return _segments(sentence(author_list("chicago")), _title(), sentence(F.when(standalone(), imprint).otherwise(paged)), doi_url())


STYLES = {"apa": _apa, "mla": _mla, "ieee": _ieee, "chicago": _chicago}


def omissions() -> Column:
    checks = (("author", F.size("authors") == 0), ("title", c("title") == ""), ("year", c("year") == ""), ("venue", container() == ""), ("pages", c("pages") == ""))
    return F.filter(F.array(*[F.when(gone, name) for name, gone in checks]), lambda x: x.isNotNull())


def format_reference(style: str, marker: Column | None = None) -> Column:
    """struct(text, marker, italic, omitted); an unknown style is APA."""
    text = STYLES.get(style, _apa)()
    italic = F.when(standalone(), c("title")).otherwise(container())
    return F.struct(text.alias("text"), (marker if marker is not None else F.lit("")).alias("marker"), italic.alias("italic"), omissions().alias("omitted"))


def sort_key() -> Column:
    family = present(F.try_element_at(c("authors"), F.lit(1))["family"])
    return F.lower(F.coalesce(F.nullif(family, F.lit("")), F.nullif(c("title"), F.lit("")), c("raw_text")))


def format_list(citations: DataFrame, style: str, by: list[str] | None = None, pos_col: str = "pos") -> DataFrame:
    """Adds list_pos and reference: IEEE numbers in the given order, the others sort by author. Lists are told apart by the columns `by`;
    without any, the table is one list, numbered slice by slice."""
    style = style if style in STYLES else "apa"
    order = [c(pos_col)] if style == "ieee" else [sort_key(), c(pos_col)]
    if by:
        df = citations.withColumn("list_pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        df = placed(citations, [(position_slice(order[0]) if style == "ieee" else text_slice(order[0]), False)], order, "list_pos")
    marker = F.concat(F.lit("["), c("list_pos").cast("string"), F.lit("]")) if style == "ieee" else None
    return df.withColumn("reference", format_reference(style, marker))


def format_all_styles(citations: DataFrame) -> DataFrame:
    """One row per citation and style (adds style_name, reference)."""
    each = F.array(*[F.struct(F.lit(s).alias("style_name"), format_reference(s).alias("reference")) for s in STYLES])
    return citations.select("*", F.inline(each))


#: style, name, heading of its list, order of its list
GUIDES = (
    ("apa", "APA, 7th edition", "References", "by first author"),
    ("mla", "MLA, 9th edition", "Works Cited", "by first author"),
    ("ieee", "IEEE", "References", "numbered as cited"),
    ("chicago", "Chicago, 17th edition, notes and bibliography", "Bibliography", "by first author"),
)


def style_guides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUIDES, "style string, name string, list_heading string, ordering string")
