"""The author list at the head of an entry, as column expressions.

The list is a run of names with separators between them. One pattern without backtracking (atomic groups) describes the run as a whole; the same
pieces, each anchored where the last ended, then give its names one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import let, strip, words

AUTHORS = "array<struct<given:string,family:string>>"


def _group(*options: str) -> str:
    return f"(?>{'|'.join(options)})"


def _no_place() -> str:
    """Behind an inverted name: neither an imprint's colon follows, nor is the given name a place (`Boston, Mass.`)."""
    places = "|".join(sorted({q.replace(".", r"\.") for p in X.PLACE_ABBREVIATIONS for q in (p, p.removesuffix("."))}))
    return rf"(?!{X.IMPRINT_COLON})(?<!,[ \t]{{1,9}}(?:{places})[ \t]{{0,9}})"


_INVERTED = _group(rf"(?:{X.SURNAME}),[ \t]+(?:{X.GIVEN})") + _no_place()
_DIRECT = _group(X.INITIALS + X.SURNAME)
_WRITTEN = _group(rf"{X.WRITTEN_GIVEN}[ \t]+{X.SURNAME}")
#: Separators: a conjunction, after which written-out names count too, and a bare comma. Titles look like written-out names.
_LINK = _group(r"[ \t]*+,[ \t]*+(?:and[ \t]++|&[ \t]*+)", r"[ \t]++and[ \t]++", r"[ \t]*+&[ \t]*+")
_COMMA = _group(r"[ \t]*+,[ \t]*+") + r"(?!and[ \t]|&)"
_NAME, _LINKED = _group(_INVERTED, _DIRECT), _group(_INVERTED, _WRITTEN, _DIRECT)
_MORE = rf"(?!{X.ET_AL})" + _group(_LINK + _LINKED, _COMMA + _NAME)
LIST = rf"(?U)^{_NAME}(?:{_MORE})*+(?:{X.ET_AL})?+"
EACH = rf"(?U)\G(?:^{_NAME}|(?!^){_MORE})"


def _name(piece: Column) -> Column:
    """struct(given, family) of a name with the separator before it."""
    bare = F.regexp_replace(piece, rf"(?U)^(?:{_LINK}|{_COMMA})", "")

    def parts(x: Column) -> Column:
        inverted = x.contains(",")
        given = F.when(inverted, F.regexp_extract(x, r"(?s)^[^,]*,(.*)$", 1)).otherwise(F.regexp_extract(x, rf"(?U)^({X.INITIALS}|{X.WRITTEN_GIVEN}[ \t]+)", 1))
        return let(given, lambda g: F.struct(strip(g).alias("given"), strip(F.when(inverted, F.substring_index(x, ",", 1)).otherwise(F.substring(x, F.char_length(g) + 1, F.char_length(x)))).alias("family")))

    return let(bare, parts)


def author_span(c: Column) -> Column:
    """Entry text without its index -> struct(authors, end): names in order, each once whatever its case, and the length of the list (0: the text
    doesn't open with a name)."""

    def once(names: Column) -> Column:
        key = lambda a: F.lower(F.concat(a["family"], F.lit("\n"), a["given"]))
        return let(F.transform(names, key), lambda keys: F.filter(names, lambda a, i: F.array_position(keys, key(a)) == i + 1))

    def of(span: Column) -> Column:
        return F.struct(let(F.transform(F.regexp_extract_all(span, F.lit(EACH), F.lit(0)), _name), once).alias("authors"), F.char_length(span).alias("end"))

    return let(F.regexp_extract(F.coalesce(c, F.lit("")), LIST, 0), of)


def parse_author_field(c):
    """Names of an edited field: separated by semicolons, `Family, Given` or `Given Family`."""

    def one(x):
        parts = words(x)
        inverted = F.struct(strip(F.regexp_extract(x, r"(?s)^[^,]*,(.*)$", 1)).alias("given"), strip(F.substring_index(x, ",", 1)).alias("family"))
        natural = let(parts, lambda w: F.struct(F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ").alias("given"), F.element_at(w, -1).alias("family")))
        return F.when(x.contains(","), inverted).otherwise(natural)

    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.rtrim(strip(x), F.lit(","))), lambda x: strip(x) != "")
    return F.transform(names, one)
