"""Documents read into rows, and files decoded into text.

Plain text and Parquet come through Spark's readers. Word and slide files are unpacked with the standard library; PDF and images need a library
that may be absent, which is an error of the row, never of the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BiblioflowError, CorruptedDocumentError, ExtractionError, OcrUnavailableError, UnsupportedFileError
from ..functions.text import present, squeeze

#: Decoder -> extensions and MIME types, in order of resolution (fixed values).
DECODERS = {
    "pdf": (("pdf",), ("application/pdf",)),
    "image": (("png", "jpg", "jpeg", "tif", "tiff"), ()),
    "docx": (("docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    "pptx": (("pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
}
FORMAT_NAMES = {"pdf": "PDF", "image": "Image", "docx": "Word", "pptx": "PowerPoint"}
DECODED = "text string, page_count int, pages array<string>, metadata map<string,string>, warnings array<string>, error string, error_kind string"


def supported_extensions() -> list[str]:
    return sorted(e for extensions, _ in DECODERS.values() for e in extensions)


def extension_of(filename: Column) -> Column:
    name = F.regexp_replace(present(filename), r"^.*[/\\]", "")
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def resolve_decoder(mime_type: Column, filename: Column) -> Column:
    """The decoder that claims the MIME type, else the extension; null for none."""
    mime, ext = F.lower(F.trim(present(mime_type))), extension_of(filename)
    by_mime = [F.when(mime.isin(*mimes) if mimes else mime.startswith("image/"), name) for name, (_, mimes) in DECODERS.items()]
    by_ext = [F.when(ext.isin(*extensions), name) for name, (extensions, _) in DECODERS.items()]
    return F.coalesce(*by_mime, *by_ext)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file sources name it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_pos, filename, mime_type, content) of whole files, in the order of their paths; file names may repeat. Missing paths are reported by missing_paths()."""
    whole = list(dict.fromkeys(_qualified(spark, p) for p in paths))
    order = F.create_map(*[x for i, p in enumerate(whole) for x in (F.lit(p), F.lit(i))])
    raw = spark.read.format("binaryFile").load(whole)
    return raw.select(F.coalesce(F.try_element_at(order, F.col("path")), F.lit(len(whole))).alias("file_pos"), F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), F.lit("").alias("mime_type"), "content")


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that are no files, by Spark's own view of the file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not (fs.exists(path) and fs.getFileStatus(path).isFile()):
            out.append(p)
    return out


def read_text_tables(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed(text_col, "text")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _text(node: ET.Element, prefix: str) -> str:
    return "".join(t.text or "" for t in node.iter(prefix + "t"))


def decode_docx(data: bytes) -> dict:
    """Paragraphs (headings set off by blank lines), then table rows: cells and rows once each, cells joined by ` | `."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
    parts, rows = [], []
    for p in body.findall(_W + "p"):
        text = _text(p, _W).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(_W + "val") or "") if style is not None else ""
        if text:
            parts.append(f"\n{text}\n" if name.startswith(("Heading", "Title", "Subtitle")) else text)
    for row in body.iter(_W + "tr"):
        cells = dict.fromkeys(t for t in ("\n".join(_text(p, _W) for p in cell.findall(_W + "p")).strip() for cell in row.findall(_W + "tc")) if t)
        rows.append(" | ".join(cells))
    parts += [r for r in dict.fromkeys(rows) if r]
    return {"text": "\n".join(parts), "page_count": max(1, len(list(body.iter(_W + "sectPr"))))}


def decode_pptx(data: bytes) -> dict:
    """Text frames, tables and notes of the slides in order, slides set apart by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {int(m[1]): n for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
        notes = {n for n in z.namelist() if n.startswith("ppt/notesSlides/notesSlide")}
        pages = []
        for k in sorted(names):
            root = ET.fromstring(z.read(names[k]))
            lines = [" | ".join(dict.fromkeys(_text(c, _A).strip() for c in tr.iter(_A + "tc"))) for tr in root.iter(_A + "tr")]
            in_tables = {id(p) for tr in root.iter(_A + "tr") for p in tr.iter(_A + "p")}
            lines = [t for p in root.iter(_A + "p") if id(p) not in in_tables and (t := _text(p, _A).strip())] + [x for x in lines if x.strip(" |")]
            note = f"ppt/notesSlides/notesSlide{k}.xml"
            if note in notes:
                lines += [t for p in ET.fromstring(z.read(note)).iter(_A + "p") if (t := _text(p, _A).strip()) and not t.isdigit()]
            pages.append("\n".join(lines))
    return {"text": "\n\n".join(p for p in pages if p), "page_count": len(pages), "pages": pages}


def decode_pdf(data: bytes) -> dict:
    try:
        import fitz
    except ImportError as missing:
        raise ExtractionError("PDF files need the PyMuPDF library, which is not installed.") from missing
    with fitz.open(stream=data, filetype="pdf") as doc:
        pages = [page.get_text() for page in doc]
        metadata = {k: str(v) for k, v in (doc.metadata or {}).items() if v}
    warnings = [] if any(p.strip() for p in pages) else ["No page has a text layer; the document may be scanned."]
    return {"text": "\n".join(pages), "page_count": len(pages), "pages": pages, "metadata": metadata, "warnings": warnings}


def decode_image(data: bytes) -> dict:
    try:
        import pytesseract
        from PIL import Image, ImageEnhance, ImageOps
    except ImportError as missing:
        raise OcrUnavailableError("Images need optical character recognition, which is not installed.") from missing
    image = ImageOps.grayscale(ImageOps.exif_transpose(Image.open(io.BytesIO(data))))
    if min(image.size) < 1_000:
        grow = 1_000 / min(image.size)
        image = image.resize([round(x * grow) for x in image.size])
    image = ImageEnhance.Contrast(ImageOps.autocontrast(image)).enhance(1.8)
    text = pytesseract.image_to_string(image, config="--psm 3")
    return {"text": text, "page_count": 1, "warnings": ["Little text was recognised."] if len(text.split()) < 15 else []}


_RUN = {"pdf": decode_pdf, "image": decode_image, "docx": decode_docx, "pptx": decode_pptx}
_FIELDS = (("text", pa.string(), ""), ("page_count", pa.int32(), 0), ("pages", pa.list_(pa.string()), []), ("metadata", pa.map_(pa.string(), pa.string()), {}), ("warnings", pa.list_(pa.string()), []), ("error", pa.string(), None), ("error_kind", pa.string(), None))


def decode_one(data: bytes | None, decoder: str | None, filename: str | None) -> dict:
    """Text and notes of one file; failures are fields of the result."""
    try:
        if decoder is None:
            raise UnsupportedFileError(f"Cannot read {filename or 'this file'}.", f"Supported formats are {', '.join('.' + e for e in supported_extensions())}.")
        return _RUN[decoder](data or b"")
    except BiblioflowError as e:
        return {"error": " ".join(x for x in (e.message, e.remedy) if x), "error_kind": e.kind}
    except Exception as e:
        return {"error": f"The file could not be decoded: {e}", "error_kind": CorruptedDocumentError.kind}


def _decode(content, decoder, filename):
    rows = [decode_one(*row) for row in zip(content.to_pylist(), decoder.to_pylist(), filename.to_pylist(), strict=True)]
    columns = [pa.array([list(r[n].items()) if n == "metadata" and n in r else [] if n == "metadata" else r.get(n, default) for r in rows], kind) for n, kind, default in _FIELDS]
    return pa.StructArray.from_arrays(columns, [n for n, _, _ in _FIELDS])


def decode(files: DataFrame) -> DataFrame:
    """Adds text, page_count, pages, metadata, warnings, error and error_kind to files (filename, mime_type, content), in Arrow batches."""
    udf = F.arrow_udf(_decode, f"struct<{DECODED.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array').replace(' map', ':map')}>", F.ArrowUDFType.SCALAR)
    df = files.withColumn("decoder", resolve_decoder(F.col("mime_type"), F.col("filename")))
    df = df.withColumn("__d", udf(F.col("content"), F.col("decoder"), F.col("filename")))
    df = df.select("*", "__d.*").drop("__d", "content")
    empty = F.col("error").isNull() & (squeeze(F.col("text")) == "")
    return df.withColumns({"error_kind": F.when(empty, "empty_document").otherwise(F.col("error_kind")), "error": F.when(empty, F.concat(F.lit("No text could be read from "), F.col("filename"), F.lit("."))).otherwise(F.col("error"))})


def pages_of(decoded: DataFrame) -> DataFrame:
    """(filename, page_no from 1, page_text)"""
    return decoded.select("filename", F.posexplode("pages").alias("p", "page_text")).select("filename", (F.col("p") + 1).alias("page_no"), "page_text")


def load_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus: a JSON array of records."""
    return spark.read.option("multiLine", True).json(path)
