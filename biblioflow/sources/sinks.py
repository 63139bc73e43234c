"""Citations written as BibTeX, RIS, CSV, JSON and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExportError
from ..functions import fixed as X
from ..functions.derive import author_string, cite_key
from ..operators.render import GUIDES, format_list

c = F.col


def _line(label: str, value: str | Column, end: str = "") -> Column:
    v = c(value) if isinstance(value, str) else value
    return F.when(v != "", F.concat(F.lit(label), v, F.lit(end)))


def bibtex() -> Column:
    """One entry. No escaping, and keys are not made unique."""
    people = F.array_join(F.transform("authors", lambda a: F.concat(a["family"], F.lit(", "), a["given"])), " and ")
    fields = [("author  = ", people), ("title   = ", c("title")), ("journal = ", c("journal")), ("year    = ", c("year")), ("volume  = ", c("volume")), ("number  = ", c("issue")), ("pages   = ", F.replace(c("pages"), F.lit("-"), F.lit("--"))), ("doi     = ", c("doi")), ("url     = ", c("url")), ("publisher = ", c("publisher")), ("address = ", c("address")), ("booktitle = ", c("booktitle"))]
    body = F.concat_ws(",\n", *[_line("  " + label + "{", v, "}") for label, v in fields])
    return F.concat(F.lit("@"), c("entry_type"), F.lit("{"), cite_key(), F.lit(",\n"), body, F.lit("\n}"))


def ris() -> Column:
    kind = F.coalesce(*[F.when(c("entry_type") == t, code) for t, code in X.RIS_TYPES.items()], F.lit("GEN"))
    page = F.split("pages", "-")
    people = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a["family"], F.lit(", "), a["given"])), "\n"))
    source = F.when(c("journal") != "", F.concat(F.lit("JO  - "), c("journal"))).when(c("booktitle") != "", F.concat(F.lit("T2  - "), c("booktitle")))
    return F.concat_ws(
        "\n", F.concat(F.lit("TY  - "), kind), people, _line("TI  - ", "title"), source, _line("PY  - ", "year"), _line("VL  - ", "volume"), _line("IS  - ", "issue"),
        F.when(c("pages") != "", F.concat(F.lit("SP  - "), F.trim(page[0]))), F.when((c("pages") != "") & (F.size(page) > 1), F.concat(F.lit("EP  - "), F.trim(F.try_element_at(page, F.lit(2))))),
        _line("DO  - ", "doi"), _line("UR  - ", "url"), _line("PB  - ", "publisher"), F.lit("ER  - "),
    )


def csv_rows(citations: DataFrame, with_source: bool | None = None) -> DataFrame:
    """The columns of the CSV form; `Source file` only if any row has one (asked of the data unless told)."""
    names = (("Title", "title"), ("Year", "year"), ("Journal", "journal"), ("Volume", "volume"), ("Issue", "issue"), ("Pages", "pages"), ("DOI", "doi"), ("URL", "url"), ("Publisher", "publisher"), ("Confidence", "confidence"))
    columns = [c(f).alias(n) for n, f in names]
    columns.insert(1, author_string().alias("Authors"))
    if with_source is None:
        with_source = not citations.where("source_file <> ''").isEmpty()
    return citations.select(*columns, *([c("source_file").alias("Source file")] if with_source else []))


def _text(entry: Callable[[], Column]):
    return lambda citations, path, pos="pos": citations.orderBy(pos).select(entry().alias("value")).write.option("lineSep", "\n\n").text(path)


def _csv(citations: DataFrame, path: str, pos: str = "pos") -> None:
    csv_rows(citations.orderBy(pos)).write.option("header", True).csv(path)


def _json(citations: DataFrame, path: str, pos: str = "pos") -> None:
    citations.orderBy(pos).write.json(path)


def reference_lines(citations: DataFrame, style: str, pos: str = "pos") -> DataFrame:
    """(list_pos, value): a list's heading, at 0, and its references."""
    heading = next(h for s, _, h, _ in GUIDES if s == style)
    lines = format_list(citations, style, pos_col=pos).select("list_pos", F.concat_ws(" ", F.nullif(c("reference.marker"), F.lit("")), c("reference.text")).alias("value"))
    return citations.sparkSession.range(1).select(F.lit(0).cast("long").alias("list_pos"), F.lit(heading).alias("value")).union(lines.select(c("list_pos").cast("long"), "value"))


def _reference_list(style: str):
    def write(citations: DataFrame, path: str, pos: str = "pos") -> None:
        lines = reference_lines(citations, style, pos).orderBy("list_pos").select("value")
        lines.write.option("lineSep", "\n\n").text(path)

    return write


def _one_file(kind: str, module: str):
    """Office formats: small, one file, made on the driver from a stream of rows, and only where their library is installed."""

    def write(citations: DataFrame, path: str, pos: str = "pos") -> None:
        from importlib import import_module

        try:
            import_module(module)
        except ImportError as missing:
            raise ExportError(f"These citations could not be written as {kind}: {module} is not installed.") from missing
        if module == "openpyxl":
            csv_rows(citations.orderBy(pos)).toPandas().to_excel(path, sheet_name="Citations", index=False)
            return
        rows = (r["reference"]["text"] for r in format_list(citations, "apa", pos_col=pos).orderBy("list_pos").toLocalIterator())
        if module == "docx":
            from docx import Document

            doc = Document()
            for r in rows:
                doc.add_paragraph(r, style="List Number")
            doc.save(path)
        else:
            from xml.sax.saxutils import escape

            from reportlab.lib.styles import getSampleStyleSheet
            from reportlab.platypus import Paragraph, SimpleDocTemplate

            SimpleDocTemplate(path).build([Paragraph(escape(r), getSampleStyleSheet()["Normal"]) for r in rows])

    return write


#: Format -> writer(citations, path)
WRITERS = {
    "bibtex": _text(bibtex),
    "ris": _text(ris),
    "csv": _csv,
    "json": _json,
    "text": _reference_list("apa"),
    **{f"text-{s}": _reference_list(s) for s in ("apa", "mla", "ieee", "chicago")},
    "excel": _one_file("Excel", "openpyxl"),
    "word": _one_file("Word", "docx"),
    "pdf": _one_file("PDF", "reportlab"),
}


def export(citations: DataFrame, fmt: str, path: str, pos: str = "pos") -> None:
    """Writes in a format of WRITERS; what goes wrong is an ExportError."""
    if fmt not in WRITERS:
        raise ExportError(f"Unknown format {fmt}; there are {', '.join(WRITERS)}.")
    try:
        WRITERS[fmt](citations, path, pos)
    except ExportError:
        raise
    except Exception as error:
        raise ExportError(f"These citations could not be written as {fmt}: {error}") from error
