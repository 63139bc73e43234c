"""Reference blocks cut into entries.

Each way of cutting marks where entries start and splits there; all of it happens within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.lines import any_of
from ..functions.text import let, present, strip

MARK = "\x01"


def _cut(marked_text: Column) -> Column:
    """Pieces between marks, stripped of white space, without empty ones."""
    return F.filter(F.transform(F.split(marked_text, MARK), lambda x: strip(x)), lambda x: x != "")


def looks_like_entry(c: Column) -> Column:
    return (F.char_length(strip(c)) >= X.ENTRY_CHARS) & any_of(strip(c), X.ENTRY_EVIDENCE)


def entry_numbering(numbers: Column) -> Column:
    """Numbers of a reference list: two or more, from at most 3 on, strictly rising, not too sparse."""
    rising = F.forall(F.sequence(F.lit(2), F.greatest(F.size(numbers), F.lit(2))), lambda i: F.coalesce(F.try_element_at(numbers, i) > F.try_element_at(numbers, i - 1), F.lit(False)))
    ends = F.try_element_at(numbers, F.lit(-1)) - F.try_element_at(numbers, F.lit(1))
    return F.coalesce((F.size(numbers) >= 2) & (F.try_element_at(numbers, F.lit(1)) <= 3) & rising & (ends <= 3 * F.size(numbers)), F.lit(False))


def by_numbers(text: Column) -> Column:
    """Entries of the first index form that numbers a list: [n], (n), n. - what stands before the first index goes. Null without one."""
    forms = []
    for form in X.INDEX_FORMS:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(1)), lambda n: n.cast("int"))
        pieces = F.split(F.regexp_replace(text, form, MARK + "$0"), MARK)
        entries = F.filter(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: strip(x)), lambda x: x != "")
        forms.append(F.when(let(numbers, entry_numbering), entries))
    return F.coalesce(*forms)


def by_blank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, X.BLANK_LINE), lambda x: strip(x)), lambda x: x != "")


def _by_line(text: Column, starts) -> Column:
    solid = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return _cut(F.array_join(F.transform(solid, lambda x: F.concat(F.when(starts(x), MARK).otherwise(""), strip(x))), "\n"))


def by_hanging_indent(text: Column) -> Column:
    return _by_line(text, lambda x: ~x.rlike(r"(?U)^\s"))


def by_author(text: Column) -> Column:
    return _by_line(text, lambda x: strip(x).rlike(X.BOUNDARY))


def merge_continuations(entries: Column) -> Column:
    """Pieces that open in lower case or are too short join the one before, unless they open with a name."""
    solid = F.filter(F.transform(entries, lambda x: strip(x)), lambda x: x != "")
    goes_on = lambda x: ~x.rlike(X.BOUNDARY) & (x.rlike(r"(?U)^\p{Ll}") | (F.char_length(x) < X.ENTRY_CHARS))
    return _cut(F.array_join(F.transform(solid, lambda x, i: F.when((i > 0) & goes_on(x), F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit(MARK), x))), ""))


def accepted(entries: Column) -> Column:
    """The merged entries, where there are several and enough of them look like references; else null."""
    ratio = lambda e: F.size(F.filter(e, looks_like_entry)) >= X.SPLIT_RATIO * F.size(e)
    return let(merge_continuations(entries), lambda e: F.when((F.size(e) > 1) & ratio(e), e))


def split_entries(c: Column) -> Column:
    """array<string>: index numbers, then names where three or more lines open with one, blank lines, hanging indents, names, else the block as one."""
    text = F.translate(present(c), MARK, "")
    lines = F.split(text, "\n")
    named = F.size(F.filter(lines, lambda x: strip(x).rlike(X.BOUNDARY)))
    indented = F.exists(lines, lambda x: x.rlike(r"(?U)^\s+\S"))
    ways = F.coalesce(
        accepted(by_numbers(text)),
        F.when(named >= 3, accepted(by_author(text))),
        F.when(text.rlike(X.BLANK_LINE), accepted(by_blank_lines(text))),
        F.when(indented, accepted(by_hanging_indent(text))),
        F.when(named.between(1, 2), accepted(by_author(text))),
        F.array(strip(text)),
    )
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(ways)


def explode_entries(docs: DataFrame, block_col: str = "bibliography_text") -> DataFrame:
    """One row per entry: the columns of docs (without the block), entry_pos and raw."""
    keep = [c for c in docs.columns if c != block_col]
    return docs.withColumn("__entries", split_entries(F.col(block_col))).select(*keep, F.posexplode("__entries").alias("entry_pos", "raw"))
