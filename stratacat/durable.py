"""Writing intermediate rows where every executor can read them again, and joins whose sides are counted first."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process (tests) may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return str(found)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(kind: str, column: str) -> Column:
    """About how many bytes a value takes."""
    if kind == "string" or kind == "binary":
        return 16 + F.coalesce(F.octet_length(column), F.lit(0))
    if kind.startswith(("array", "struct", "map")):
        return 16 + F.length(F.to_json(F.struct(column)))
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 16 << 20) -> bool:
    """Whether a count of at most ``max_rows`` + 1 rows shows that ``df`` has no more rows and no more bytes. It should be cheap to read (a result of :func:`cut`)."""
    width = sum((_bytes(kind, f"`{c}`") for c, kind in df.dtypes), F.lit(16))
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found.n <= max_rows and found.bytes <= max_bytes


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = 50_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Joins, broadcasting ``small`` only if :func:`is_small`; else both sides shuffle."""
    return big.join(F.broadcast(small) if is_small(small, max_rows, max_bytes) else small, on, how)
