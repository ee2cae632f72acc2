"""Reading the tables of a data folder, and the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made where the session names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a new local folder in local mode (as in tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            _OWN[key] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        found = _OWN[key]
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what reads it sees the same rows each time, and nothing before it runs again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` wrote; they mustn't be read any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a table that is small enough to be dealt to all cores anew.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table whose files make fewer partitions than there are cores (a file of one row group can't be split), dealt to all cores; any larger one stays as its files split it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= SMALL and df.rdd.getNumPartitions() < n else df


#: Rows and bytes that travel between Spark and Python at once; Spark's own bounds are meant for narrow rows.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows and about ``most_bytes``, for rows of some KB or, packed, of some 100 KB: workers hold a batch as a whole."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{key}"
        found = re.fullmatch(r"(?i)(\d+)b?", str(spark.conf.get(key)))
        if not (found and 0 < int(found[1]) <= most):
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
