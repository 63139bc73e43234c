"""Where a document keeps its references, and what kind of document it is.

Lines stay in their row as an array, so detection is one projection without a shuffle, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.lines import block_end, citation_signal, dense_start, density, is_declaration, marked
from ..functions.text import let, present, step, strip, word_count

MARK = "\x01"


def match_lines(text: Column, *patterns: str) -> Column:
    """Sorted numbers of the lines on which matches end (their last character that is no white space), over the whole text."""
    newlines = lambda x: F.regexp_count(x, F.lit("\n"))

    def upto(s: Column) -> Column:
        count = lambda k: F.aggregate(F.slice(s["all"], 1, k + 1), F.lit(0), lambda a, n: a + n) - s["tail"][k]
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s["all"]) - 1), lambda k: k < F.size(s["all"]) - 1), count)

    out = F.array().cast("array<int>")
    for p in patterns:
        pieces = F.split(F.regexp_replace(text, p, "$0" + MARK), MARK)
        sizes = let(pieces, lambda x: F.struct(F.transform(x, newlines).alias("all"), F.transform(x, lambda y: newlines(y) - newlines(F.rtrim(y, F.lit(X.SPACES)))).alias("tail")))
        out = F.array_union(out, F.when(text.rlike(p), let(sizes, upto)).otherwise(F.array()).cast("array<int>"))
    return F.array_sort(out)


def merge_spans(spans: Column) -> Column:
    """Sorted array of struct(a, b), touching ones as one."""
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (r["a"] <= last["b"])
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(spans), empty, add)


def looks_annotated(text: Column) -> Column:
    """At least 0.3 of two or more blocks end in a paragraph of commentary."""
    blocks = F.filter(F.transform(F.split(text, X.BLANK_LINE), lambda x: strip(x)), lambda b: b != "")

    def annotated(b: Column) -> Column:
        lines = F.filter(F.split(b, "\n"), lambda x: strip(x) != "")
        rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
        return (F.size(lines) >= 2) & (word_count(rest) >= X.ANNOTATION_WORDS) & ~citation_signal(strip(F.element_at(lines, -1)))

    return (F.size(blocks) >= 2) & (F.size(F.filter(blocks, annotated)) >= X.ANNOTATED_SHARE * F.size(blocks))


def _part(lines: Column, a: Column, b: Column) -> Column:
    return F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))


def _raw(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda x: x["raw"]), "\n")


def _solid(part: Column) -> Column:
    return F.filter(part, lambda x: x["s"] != "")


def detect(docs: DataFrame, text_col: str = "text", force_parse: bool = False, force_prose: bool = False) -> DataFrame:
    """Adds struct `detection`: bibliography_text, body_text, method, kind, confidence, notes.

    First that holds: the reader's override; headings on their own line (each opens a block up to the next heading or terminator or a long run
    of prose; the last one's block always counts, earlier ones and an unheaded list at the end must be dense); a declaring title whose document is
    dense or has annotated author entries; a dense tail. Null and blank texts have no bibliography; the control character that marks matches
    within this module is taken out of texts first.
    """
    t = "__t"
    df = step(docs, **{t: F.translate(present(F.col(text_col)), MARK, "")})
    body_of = strip(F.col(t))
    note = lambda *parts: F.array(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    result = lambda bib, body, method, kind, conf, notes: F.struct(bib.alias("bibliography_text"), body.alias("body_text"), F.lit(method).alias("method"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (conf if isinstance(conf, Column) else F.lit(float(conf))).cast("double").alias("confidence"), notes.alias("notes"))
    empty = F.lit("")
    if force_prose:
        return df.withColumn("detection", result(empty, body_of, "none", "non_academic", 0.0, note("Read as prose on request; no citations were parsed."))).drop(t)
    blank = result(empty, empty, "none", "unknown", 0.0, note("The document contains no readable text."))
    if force_parse:
        kind = F.when(looks_annotated(body_of), "annotated_bibliography").otherwise("bibliography")
        forced = result(body_of, empty, "forced", kind, 1.0, note("Every line was parsed as a citation on request."))
        return df.withColumn("detection", F.when(body_of == "", blank).otherwise(forced)).drop(t)

    df = step(df, __l=marked(F.split(t, "\n")), __h=match_lines(F.col(t), X.HEADING_LINE, X.HEADING_TWO_LINES))
    df = step(df, __n=F.size("__l"), __b=F.when(F.size("__h") > 0, F.array_sort(F.array_union("__h", match_lines(F.col(t), X.TERMINATOR)))))
    lines, n = F.col("__l"), F.col("__n")
    solid = _solid(lines)
    front = F.slice(solid, 1, X.FRONT_MATTER_LINES)
    df = step(df, __d=F.array_position(F.transform(front, lambda x: is_declaration(x["s"])), True))
    declared = F.col("__d") > 0
    declaring = F.when(declared, F.try_element_at(solid, F.col("__d").cast("int"))["s"]).otherwise("")

    # headed blocks
    def block(h: Column) -> Column:
        a = h + 1
        stop = F.coalesce(F.array_min(F.filter("__b", lambda b: b > h)), n)
        return F.struct(a.alias("a"), (a + block_end(_part(lines, a, stop))).alias("b"), (h == F.array_max("__h")).alias("last"))

    def counts(r: Column) -> Column:
        part = _part(lines, r["a"], r["b"])
        size = F.size(_solid(part))
        return (size > 0) & (r["last"] | ((size >= X.MIN_BLOCK_LINES) & (density(part) > X.DENSITY)))

    spans = F.transform(F.filter(F.transform("__h", block), counts), lambda r: F.struct(r["a"].cast("int").alias("a"), r["b"].cast("int").alias("b")))
    df = step(df, __r0=F.when(F.size("__h") > 0, merge_spans(spans)))
    df = step(df, __a=F.array_max(F.transform("__r0", lambda r: r["b"])))
    df = step(df, __tail=F.when(F.size("__r0") > 0, _part(lines, F.col("__a"), n)))
    tail = F.col("__tail")
    df = step(df, __s=F.when((F.size(_solid(tail)) >= X.MIN_BLOCK_LINES) & (density(tail) > X.DENSITY), F.col("__a") + dense_start(tail)))
    below = _part(lines, F.col("__s"), n)
    also = (F.size(_solid(below)) >= X.MIN_BLOCK_LINES) & (density(below) > X.DENSITY)
    df = step(df, __r=F.when(F.col("__s").isNotNull() & also, merge_spans(F.concat("__r0", F.array(F.struct(F.col("__s").cast("int").alias("a"), n.cast("int").alias("b")))))).otherwise(F.col("__r0")))
    regions = F.col("__r")
    df = step(df, __c=strip(F.array_join(F.transform(regions, lambda r: strip(_raw(_part(lines, r["a"], r["b"])))), "\n\n")))
    uncovered = F.filter(lines, lambda x, i: ~F.exists(regions, lambda r: (i >= r["a"]) & (i < r["b"])) & ~F.array_contains("__h", i))
    covered_lines = F.flatten(F.transform(regions, lambda r: _part(lines, r["a"], r["b"])))
    share = lambda c: F.try_divide(F.char_length(c), F.char_length(body_of))
    whole = (share(F.col("__c")) >= X.REFERENCE_ONLY) & (density(covered_lines) > X.DENSITY)
    annotated = looks_annotated(F.col("__c")) | (declared & F.lower(declaring).contains("annotated"))
    headings = F.transform("__h", lambda h: F.element_at(lines, h + 1)["s"])
    headed_note = F.when(F.size(regions) == 1, F.concat(F.lit('Matched the heading "'), F.element_at(headings, -1), F.lit('".'))).otherwise(F.concat(F.size(regions).cast("string"), F.lit(" reference blocks were collected, headed "), F.array_join(F.transform(F.slice(headings, 1, F.size(regions)), lambda h: F.concat(F.lit("'"), h, F.lit("'"))), ", "), F.lit(".")))
    headed_notes = F.when(declared, F.array(headed_note, F.concat(F.lit('The front matter also declares: "'), F.substring(declaring, 1, 80), F.lit('".')))).otherwise(F.array(headed_note))
    headed = result(F.col("__c"), strip(_raw(uncovered)), "section_header", F.when(whole & annotated, "annotated_bibliography").when(whole, "bibliography").otherwise("research_paper"), F.when(declared, 0.95).otherwise(0.9), headed_notes)

    # a declaring title
    below_title = F.slice(solid, F.greatest(F.col("__d"), F.lit(1)).cast("int") + 1, F.size(solid))
    is_annotated = F.lower(declaring).contains("annotated") | looks_annotated(body_of)
    entries = F.size(F.filter(below_title, lambda x: x["s"].rlike(X.AUTHOR_LINE)))
    titled_ok = declared & ((density(below_title) > X.DENSITY) | (is_annotated & (entries >= 3)))
    evidence = F.when(density(below_title) > X.DENSITY, F.concat(F.round(density(below_title) * 100).cast("int").cast("string"), F.lit("% of the lines beneath it read as references."))).otherwise(F.concat(entries.cast("string"), F.lit(" catalog entries were identified beneath it.")))
    titled = result(body_of, empty, "title_page", F.when(is_annotated, "annotated_bibliography").otherwise("bibliography"), 0.9, F.array(F.concat(F.lit('The document declares in its front matter: "'), F.substring(declaring, 1, 80), F.lit('".')), evidence))

    # a dense tail
    half = F.floor(n / 2).cast("int")
    df = step(df, __k=F.when(density(_part(lines, half, n)) > X.DENSITY, dense_start(lines)))
    dense_part = _part(lines, F.col("__k"), n)
    found = strip(_raw(dense_part))
    level = density(dense_part)
    dense_ok = F.col("__k").isNotNull() & (found != "") & (level > X.DENSITY)
    dense = result(found, strip(_raw(_part(lines, F.lit(0), F.col("__k")))), "density_scan", F.when(looks_annotated(found), "annotated_bibliography").when(share(found) >= X.REFERENCE_ONLY, "bibliography").otherwise("research_paper"), F.least(F.lit(0.85), level), note("No references heading was present, so the reference block was located by citation density (", F.round(level * 100).cast("int").cast("string"), "% of its lines)."))
    none = result(empty, body_of, "none", "non_academic", 0.0, note("No references heading and no dense block of citations were found."))

    out = F.when(body_of == "", blank).when(F.size(regions) > 0, headed).when(titled_ok, titled).when(dense_ok, dense).otherwise(none)
    return step(df, detection=out).drop(t, "__l", "__n", "__h", "__b", "__d", "__r0", "__r", "__a", "__tail", "__s", "__c", "__k")


def bibliography_section(docs: DataFrame, text_col: str = "text", force_parse: bool = False) -> DataFrame:
    """Adds `bibliography_text` alone."""
    return detect(docs, text_col, force_parse).withColumn("bibliography_text", F.col("detection.bibliography_text")).drop("detection")
