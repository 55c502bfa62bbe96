"""What the operators share: table reads, words, durable cuts, size-checked joins."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacat.durable import cut, is_small, join_sized, shared_dir  # noqa: F401

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of non-white-space characters, in order; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filesystem(uri: str):
    """A pyarrow file system and path for ``uri`` (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it (also inside its lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def store(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`cut`, but compressed and by column: for tables that hold text. The folder ``label-...`` stays in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
