"""How jobs cut lineage: tables in the folder that all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.tables import shared_dir, small_batches


def text_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to a bounded number of rows and bytes, for texts and packed rows."""
    small_batches(spark)


class Scratch:
    """Tables of one job in the shared folder. What is dropped mustn't be read any more, not by a result that is still to be computed either."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back: nothing before it runs again when an executor is lost."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.tables = [x for x in self.tables if x[0] is not table]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for good."""
    return Scratch(df.sparkSession).write(df, name)


#: log2 of the bits by which rows that a join doesn't need are left out before its shuffle: 128 KB for any input; more wanted keys only make it coarser.
SIEVE_BITS = 20


def sieved(df: DataFrame, wanted: DataFrame, key: str, bits: int = SIEVE_BITS) -> DataFrame:
    """``df`` without most of the rows whose ``key`` isn't in the rows of ``wanted``; none that is goes.

    The marks are at most 2^bits, however many keys there are.
    """
    n = 1 << bits
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    marks = np.zeros(n, dtype=bool)
    marks[wanted.select(bucket.alias("bucket")).distinct().toArrow()["bucket"].to_numpy()] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            k = batch.num_columns - 1
            yield batch.filter(pa.array(keep[batch.column(k).to_numpy()])).select(list(range(k)))

    return df.select(*(F.col(f"`{c}`") for c in df.columns), bucket.alias(_free("_bucket", df.columns))).mapInArrow(run, df.schema)


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it as long as it is taken."""
    while name.lower() in map(str.lower, taken):
        name = f"_{name}"
    return name
