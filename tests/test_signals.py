import re

import pytest
from pyspark.sql import functions as F

from biblioflow.functions import fixed as X
from biblioflow.functions.lines import citation_signal
from biblioflow.operators.detect import detect

#: The title pattern as it was first written, which takes a stack frame a word.
PLAIN_TITLE = r"(?:[A-Z][A-Za-z'-]+|[A-Z][A-Z'-]{2,})(?:[ :]+(?:[A-Z][A-Za-z'-]+|[A-Z][A-Z'-]{2,}|of|the|and|with|a|an|to|in|on|for|from)){2,}\s*[.:](?:\s|$)"


def test_long_lines_take_no_stack(spark):
    rows = [(1, "The " + "of the " * 10_000 + "end."), (2, "Title " * 10_000), (3, "Title " * 10_000 + "One. x"), (4, "THE " * 10_000 + "END: a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.ok for r in df.select("doc_id", F.col("text").rlike(X.WORK_TITLE).alias("ok")).orderBy("doc_id").collect()] == [False, False, True, True]
    assert {r.method for r in detect(df).select("detection.method").collect()} == {"none"}


def test_titles_are_those_of_the_plain_pattern(spark):
    import random

    rng = random.Random(3)
    pieces = ["The", "An", "a", "an", "and", "of", "often", "ano", "ABC", "A", "Ab", "xAb", "Bé", "McDo", "it's", "from", " ", " ", " ", " ", " ", ":", ": ", ".", ". ", " : ", "::", "\t", "-", "9"]
    lines = ["".join(rng.choices(pieces, k=rng.randint(3, 14))) for _ in range(6_000)]
    lines += [" ".join(rng.choices(pieces[:16], k=rng.randint(3, 6))) + rng.choice([".", ":", ". x", ": Ab", ",", " : the of", ".x"]) for _ in range(6_000)]
    got = [r.ok for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, s string").select("i", F.col("s").rlike(X.WORK_TITLE).alias("ok")).orderBy("i").collect()]
    want = [re.search(PLAIN_TITLE, x) is not None for x in lines]
    assert sum(want) > 500 and [x for x, a, b in zip(lines, got, want, strict=True) if a != b] == []


@pytest.mark.parametrize(
    ("line", "signal"),
    [
        ("Call us on +1 (235) 555-2058 now.", False), ("94.182.225.142 (705) 555-1902 and 1 (705) 555-1902 again", False), ("A Note of the Day. Call +1 (235) 555-2058", False), ('The Word of the Day. token = "a530279e89c01177"', False), ("Hetion, Hetion, Hetion, from the Lake Press", False),
        ("Nature 12 (235), 998-1004, 1999", True), ("Nature 12 (3) 555-1902, in 2001", True), ("Letters 1 (235) 555 to 558, 1999", True), ('The Way of the World. "Notes on 12 wells"', True), ('The Way of the World. "Metadata"', True), ("Hetion, Hetion, from the Lake Press", True), ("The War of the Roses: 1899-1902", True),
    ],
)
def test_numbers_and_keys_that_cite_nothing(spark, line, signal):
    df = spark.createDataFrame([(line,)], "s string")
    assert df.select(citation_signal(F.col("s"))).first()[0] is signal


def test_signals_are_those_of_all_patterns(spark):
    """Weak signs are looked for only where their necessary parts are; that must change nothing, whatever the case or the form of letters."""
    import random

    from biblioflow.functions.lines import any_of, is_prose

    rng = random.Random(8)
    pieces = ["Abbot", "Obi, S", "de la Cruz, M", "The", "the", "of", "Press", "preſſ", "PUBLİSHING", "publıshers", "bookſ", "booKs", "Verlag", "Co.", "inc.", "İnc.", "Ltd.", "Edited", "ed.", "Eds.", "Trans.", "ıllus.", "illuſtrated", "by", "BY", '"quoted text"', '"a1b2c3d4"', '"', ",", ".", ":", " ", " ", "12 pp.", "1999", "4 (5)", "٣", "é"]
    lines = [rng.choice([" ", " ", ""]).join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(12_000)] + ["", None]
    s = F.col("s")
    weak = lambda *p: sum((s.rlike(x).cast("int") for x in p), F.lit(0)) >= X.WEAK_SIGNALS
    five = (X.AUTHOR_LINE, X.WORK_TITLE, X.IMPRINT_WORD, X.ROLE_WORD, X.QUOTED)
    decisive = any_of(s, (X.DOI_ANY, X.BRACKET, X.ARXIV_LINE, X.VENUE_LINE, X.LOCATOR_WORD))
    plain = F.coalesce(F.when(s.rlike(r"(?U)\d"), decisive | weak(*five, X.PAGE_COUNT_WORD, X.YEAR_WORD, X.VOLUME_ISSUE_WORD)).otherwise(weak(*five)), F.lit(False))
    words = F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    df = spark.createDataFrame([(x,) for x in lines], "s string").select("s", citation_signal(s).alias("a"), plain.alias("b"), is_prose(s).alias("p"), ((words >= X.PROSE_WORDS) & ~plain).alias("q"))
    rows = df.collect()
    assert [r for r in rows if r.a != r.b or (r.p or False) != (r.q or False)] == [] and 500 < sum(r.b for r in rows) < 11_500
