"""Versioned Parquet tables and export writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table (those with a success marker), ascending."""
    fs, root = _filesystem(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def write_version(df: DataFrame, path: str) -> int:
    """Write a new snapshot beside the older ones; the path being read is never overwritten."""
    done = versions(df.sparkSession, path)
    number = done[-1] + 1 if done else 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """A snapshot, the latest one by default; an empty table of `schema` where there is none."""
    if number is None:
        done = versions(spark, path)
        if not done:
            if schema is None:
                raise ValueError(f"no table at {path}")
            return spark.createDataFrame([], schema)
        number = done[-1]
    return spark.read.parquet(f"{path}/version={number}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that parses back exactly with a standard reader (quotes doubled, blanks kept)."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="",
                                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_text(df: DataFrame, path: str, column: str = "md") -> None:
    """Text rows in their current order; part files in name order give the document."""
    df.select(column).write.mode("overwrite").text(path)


def write_page_files(posts: DataFrame, path: str, file_key: str = "file_key") -> None:
    """Metadata records as JSON lines, sorted by file key, so that each record is found by its key."""
    posts.repartitionByRange(F.col(file_key)).sortWithinPartitions(file_key).write.mode("overwrite").json(path)
