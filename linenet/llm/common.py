"""What the corpus operators share: the shared folder, lineage cuts, and safe column handling."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linenet.tables import discard, fresh_path, settled, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


shared_dir, materialize = shared_folder, settled


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct `row`, so that no name of theirs can clash with a working column."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def sliced(batches, rows: int = 500):
    """Arrow batches of a few rows each, so that a worker's Python objects stay few."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def lean(run):
    """An Arrow function that gives memory back to the system when its task ends, as workers live on for later tasks."""

    def released(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return released


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
