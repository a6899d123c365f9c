"""Files into document rows, and document rows into files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepool.functions.text import content_id

#: Kinds whose text comes from recognition, which is a hook of the caller's.
IMAGES = ["pdf", "png", "jpg", "jpeg", "tiff"]


def load_files(spark: SparkSession, path: str, recognize=None) -> DataFrame:
    """(path, extension, text, document_id) of every file; bytes are read strictly as UTF-8, so a file that isn't fails the job.

    ``recognize``: a function of a binary column that gives the text of images and PDFs (a pandas UDF, say). Without it they have none.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "content")
    image = F.col("extension").isin(IMAGES)
    seen = recognize(F.col("content")) if recognize else F.lit(None).cast("string")
    text = F.when(image, seen).otherwise(F.decode(F.when(~image, F.col("content")), "UTF-8"))
    return rows.select("path", "extension", text.alias("text"), F.substring(F.md5("content"), 1, 12).alias("document_id"))


def ordered_lines(blocks: DataFrame) -> DataFrame:
    """(document_id, text): recognised line blocks from top to bottom, then left to right. ``blocks``: document_id, top, left, text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"])
    return blocks.groupBy("document_id").agg(F.array_join(lines, "\n").alias("text"))


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    """An id that depends on the chunk's document, place and first 50 characters alone."""
    return content_id(F.concat_ws("_", document_id, index.cast("string"), F.substring(text, 1, 50)))


def write_report(rows: DataFrame, path: str) -> None:
    """An evaluation report as JSON lines, replacing an earlier one."""
    rows.write.mode("overwrite").json(path)


def append_chunks(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
