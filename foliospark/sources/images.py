"""Images as rows of documents_raw, and rows as text sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is taken for an image.
PATTERN = "*.{jpg,jpeg,png}"


def read_images(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, file_name, content_type, length, content) of the image files below a folder."""
    return _documents(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def stream_images(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """The same for files that keep arriving."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _documents(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path))


def _documents(files: DataFrame) -> DataFrame:
    ending = F.lower(F.substring_index("path", ".", -1))
    return files.select(
        F.xxhash64("path").alias("doc_id"),
        F.substring_index("path", "/", -1).alias("file_name"),
        F.concat(F.lit("image/"), F.when(ending == "jpg", "jpeg").otherwise(ending)).alias("content_type"),
        "length",
        "content",
    )


def split_images(uploads: DataFrame, content_type: str = "content_type") -> tuple[DataFrame, DataFrame]:
    """(images, rejected): only content types that begin with image/ go on."""
    ok = F.coalesce(F.col(content_type).startswith("image/"), F.lit(False))
    return uploads.filter(ok), uploads.filter(~ok)


def rgb_column(data: Column, channels: Column) -> Column:
    """Red, green and blue bytes from the image source's blue, green, red (alpha) or grey ones."""

    @F.pandas_udf("binary")
    def turn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, counts in batches:
            out = []
            for content, n in zip(contents, counts, strict=True):
                pixels = np.frombuffer(content, np.uint8).reshape(-1, n)
                out.append((np.repeat(pixels, 3, axis=1) if n == 1 else pixels[:, 2::-1]).tobytes())
            yield pd.Series(out, dtype=object)

    return turn(data, channels)


def read_pixels(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, width, height, rgb) of the image files below a folder, decoded by Spark's image source.

    Ids are those of ``read_images``. Files that can't be decoded have no row; alpha is dropped.
    """
    files = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path)
    # The source names files by encoded addresses, the others by plain paths.
    plain = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    place = F.regexp_replace(plain, "^file:///", "file:/")
    return files.select(F.xxhash64(place).alias("doc_id"), "image.width", "image.height", rgb_column(F.col("image.data"), F.col("image.nChannels")).alias("rgb"))
