"""Documents as they arrive: an extension beyond batch runs. The plans are stateless per document, so they run on a stream as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.process import Options, characterise, citations
from ..sources.documents import decode

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New files of a folder as (file_pos, filename, mime_type, content)."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).load(folder)
    return raw.select(F.lit(0).alias("file_pos"), F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), F.lit("").alias("mime_type"), "content")


def stream_citations(docs: DataFrame, keys: list[str], options: Options = Options(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """Accepted citations of a stream of documents."""
    return citations(characterise(docs, options, text_col), keys).where("accepted")


def decoded(files: DataFrame) -> DataFrame:
    return decode(files)


def write_stream(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands every micro-batch to `each` (a sink of the batch side, say) until what is there is done."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
