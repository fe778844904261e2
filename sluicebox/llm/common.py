"""What the operators share: reading tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: The hint for joins of tables that grow with the documents: broadcast ones would be built in the driver, round after round.
MERGE = "merge"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this driver has written, in order.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies in ``spark.checkpoint.dir``, in one folder for the application, which
    release() deletes.  Where that is unset, a session of this machine alone gets a
    temporary folder of this machine; a cluster is refused.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/sluicebox-{context.applicationId}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the folders written so far (from the one numbered ``since`` on, but for the last ones): results that read them must have been written."""
    for path in _written[since : len(_written) - but]:
        _delete(spark, path)
    del _written[since : len(_written) - but]


def stage_result(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, written and read again; what it has written on the way is deleted."""
    since = len(_written)
    out = materialize(make(), name)
    release(out.sparkSession, since, 1)
    return out


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark deletes a query's shuffle files when the query ends.

    For queries whose result is written: later jobs read that, so their shuffle
    files would only fill the executors' disks until the driver collects garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs its running tasks only, and
    lets several later jobs read the rows without computing them again.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with shuffle_cleanup(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow with batches of BATCH_BYTES.

    Rows are whole texts: a batch of Spark's default number of rows is held by the
    JVM and by the Python worker of each task at once.  The setting is the session's
    and stays, as the result is computed later.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def joined_binary(order: str, value: str) -> Column:
    """An aggregate: the group's binary values (null: none) joined in order; each byte is copied once, as a character."""
    parts = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.encode(F.array_join(F.transform(parts, lambda x: F.decode(x[value], "ISO-8859-1")), ""), "ISO-8859-1")


def crc32_fold(id_column: str, folds: int, fold: int):
    """Whether a row is in the given fold by crc32 of its id as text; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary")) % folds == fold


def text_key(text: str = "text"):
    """A digest that tells apart rows which share an id but not their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
