"""Predicates over single lines, and numbers over arrays of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import let, strip, word_count

LINE = "struct<raw:string,s:string,signal:boolean,prose:boolean>"


def any_of(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def citation_signal(c: Column) -> Column:
    """One decisive sign, or two of the weak ones. Decisive signs hold a digit, so a line without one is asked for the other weak signs only.

    Weak signs are looked for where a part that they can't do without is found, and only if two such parts are: most prose is settled by plain searches.
    The parts hold no s or i, whose forms beyond ASCII (?iu) takes for them and lower() doesn't.
    """

    def several(low: Column, *more: str) -> Column:
        has = lambda *parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
        signs = ((X.WORK_TITLE, has(".", ":")), (X.AUTHOR_LINE, has(",")), (X.QUOTED, has('"')), (X.ROLE_WORD, has("by")), (X.IMPRINT_WORD, has("pre", "publ", "book", "verlag", "co.", "nc.", "ltd.")))
        count = lambda found: reduce(lambda a, b: a + b, [x.cast("int") for x in found]) >= X.WEAK_SIGNALS
        if more:
            return count([*[part & c.rlike(p) for p, part in signs], *[c.rlike(p) for p in more]])
        return count([part for _, part in signs]) & count([part & c.rlike(p) for p, part in signs])

    decisive = any_of(c, (X.DOI_ANY, X.BRACKET, X.ARXIV_LINE, X.VENUE_LINE, X.LOCATOR_WORD))
    numbered = decisive | let(F.lower(c), lambda low: several(low, X.PAGE_COUNT_WORD, X.YEAR_WORD, X.VOLUME_ISSUE_WORD))
    return F.coalesce(F.when(c.rlike(r"(?U)\d"), numbered).otherwise(let(F.lower(c), lambda low: several(low))), F.lit(False))


def wordy(c: Column) -> Column:
    """Whether a line has PROSE_WORDS words at least; reads no further than the last of them."""
    return c.rlike(rf"(?U)^\s*+(?:\S++\s++){{{X.PROSE_WORDS - 1}}}\S")


def is_prose(c: Column) -> Column:
    return wordy(c) & ~citation_signal(c)


def is_contents_line(c: Column) -> Column:
    return c.rlike(X.CONTENTS_LEADER) | (c.rlike(X.CONTENTS_NUMBER) & (word_count(c) <= 6))


def is_declaration(c: Column) -> Column:
    """A line that names the document a bibliography, as a title would."""
    tail = strip(F.regexp_replace(c, X.DECLARATION, ""))
    return c.rlike(X.DECLARATION) & (word_count(c) <= X.DECLARATION_WORDS) & ~is_contents_line(c) & ((tail == "") | tail.rlike(X.DECLARATION_TAIL))


def marked(lines: Column) -> Column:
    """array<string> to array of struct(raw, s = stripped, signal, prose)."""

    # a step at a time over the array, since an expression that is written twice in a lambda runs twice
    bare = F.transform(lines, lambda x: F.struct(x.alias("raw"), strip(x).alias("s")))
    signed = F.transform(bare, lambda x: F.struct(x["raw"].alias("raw"), x["s"].alias("s"), citation_signal(x["s"]).alias("signal")))
    return F.transform(signed, lambda x: F.struct(x["raw"].alias("raw"), x["s"].alias("s"), x["signal"].alias("signal"), (wordy(x["s"]) & ~x["signal"]).alias("prose")))


def density(part: Column) -> Column:
    """Share of marked lines with a signal, blank ones aside; 0 for none."""
    solid = F.filter(part, lambda x: x["s"] != "")
    return F.coalesce(F.try_divide(F.size(F.filter(solid, lambda x: x["signal"])), F.size(solid)), F.lit(0.0))


def block_end(part: Column, gap: int = X.HEADED_PROSE_GAP) -> Column:
    """Length of the leading part of marked lines before the first run of more than `gap` prose lines (blank and short lines don't count,
    a signal ends a run)."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(-1).alias("at"), F.lit(-1).alias("end"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["signal"], 0).when(x["prose"], s["run"] + 1).otherwise(s["run"])
        at = F.when(x["signal"], -1).when(x["prose"] & (s["run"] == 0), s["i"]).otherwise(s["at"])
        return F.struct((s["i"] + 1).alias("i"), run.alias("run"), at.alias("at"), F.when((s["end"] < 0) & (run > gap), at).otherwise(s["end"]).alias("end"))

    return F.aggregate(part, start, step, lambda s: F.when(s["end"] < 0, s["i"]).otherwise(s["end"]))


def dense_start(part: Column, gap: int = X.SCAN_PROSE_GAP) -> Column:
    """Index of the topmost signal line below the lowest run of more than `gap` prose lines, seen from the end; the length without one."""
    n = F.size(part)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("top"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["signal"], 0).when(x["prose"], s["run"] + 1).otherwise(s["run"])
        top = F.when(x["signal"] & ~s["over"], s["i"] + 1).otherwise(s["top"])
        return F.struct((s["i"] + 1).alias("i"), run.alias("run"), top.alias("top"), (s["over"] | (run > gap)).alias("over"))

    return n - F.aggregate(F.reverse(part), start, step, lambda s: s["top"])
