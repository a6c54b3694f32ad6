"""Alignment files and events as streams. Every file that arrives is whole, so blocks are complete and need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.maf import parse_each, read_lines


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines of the files that appear in the folder. block_id is 0 for headers, else a hash of path and place, as files have no order."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    lines = parse_each(files.select(F.col("_metadata.file_path").alias("path"), "value"))
    return lines.withColumn("block_id", F.when(F.col("block_id") == 0, F.col("block_id")).otherwise(F.xxhash64("path", "block_id")))


def stream_filter(lines: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """s lines by name prefixes; give one of the two. A predicate on each line, so neither state nor watermark."""
    if (include is None) == (exclude is None):
        raise ValueError("give one of include and exclude")
    keep = X.starts_with_any(F.col("name"), include) if include is not None else ~X.starts_with_any(F.col("name"), exclude)
    return lines.where((F.col("type") == "s") & keep)


def per_batch(lines: DataFrame, operator, sink):  # noqa: ANN001, ANN201
    """A writer that applies a block-local operator (DataFrame to DataFrame) to each micro-batch and hands ``sink`` the result.

    Blocks never span files nor files micro-batches, so results equal those over all files at once. ``sink`` takes the
    result and the batch's number, by which it can leave out a batch that is given to it again.
    """
    return lines.writeStream.foreachBatch(lambda batch, n: sink(operator(batch), n))


def per_file_batch(spark: SparkSession, folder: str, operator, sink, files_per_trigger: int = 64):  # noqa: ANN001, ANN201
    """As ``per_batch`` for files of any size: the stream carries names, and each micro-batch reads its files by byte ranges.

    Block numbers run through the files of one micro-batch.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path")

    def each(batch: DataFrame, n: int) -> None:
        listed = [r.path for r in batch.collect()]  # files_per_trigger names at most
        if listed:
            sink(operator(read_lines(batch.sparkSession, listed)), n)

    return names.writeStream.foreachBatch(each)


def event_bins(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(shard, bin, n): events by shard of users and tumbling window; a window is given out once it cannot change."""
    window = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy((F.col("user_id") % 16).alias("shard"), window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("shard", F.col("w.start").alias("bin"), "n")
