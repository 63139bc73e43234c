"""What can go wrong, by kind. In tables these are the columns error and error_kind of the row; a row never fails a job."""

from __future__ import annotations


class BiblioflowError(Exception):
    """An error with a message, a kind, and perhaps a remedy for the reader."""

    kind = "error"

    def __init__(self, message: str, remedy: str | None = None):
        super().__init__(message)
        self.message, self.remedy = message, remedy


class ExtractionError(BiblioflowError):
    kind = "extraction"


class UnsupportedFileError(ExtractionError):
    kind = "unsupported_file"


class CorruptedDocumentError(ExtractionError):
    kind = "corrupted_document"


class EmptyDocumentError(ExtractionError):
    kind = "empty_document"


class OcrUnavailableError(ExtractionError):
    kind = "ocr_unavailable"


class ParsingError(BiblioflowError):
    kind = "parsing"


class StyleDetectionError(ParsingError):
    kind = "style_detection"


class SummarizationError(BiblioflowError):
    kind = "summarization"


class ExportError(BiblioflowError):
    kind = "export"


#: Kind of an error that none of these foresees.
UNEXPECTED = "unexpected"
KINDS = {e.kind: e for e in (ExtractionError, UnsupportedFileError, CorruptedDocumentError, EmptyDocumentError, OcrUnavailableError, ParsingError, StyleDetectionError, SummarizationError, ExportError)}
