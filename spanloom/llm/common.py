"""What the training-data operators share: tables, work files in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom import session

#: A side of a join is broadcast only after its rows were counted and are no more than this many narrow rows.
BROADCAST_ROWS = 200_000
#: Bytes of rows that go to a Python worker at once, besides the last row of them; Spark itself counts rows only, so that long
#: texts would fill the memory of both sides. A session that sets its own bound keeps it.
BATCH_BYTES, BATCH_SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, that of spark.checkpoint.dir."""
    return session.work_folder(spark)


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back, which cuts its lineage. The files outlive
    executors and are left for the owner of the folder to clear."""
    return session.written(df, label)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from materialise() that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, df itself (a shuffled join) if not."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def hashed_share(key: str, share: float) -> Column:
    """Whether the row is among about the given share of rows whose keys hash lowest: told where it stands, so that none is sorted or
    brought together."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(min(2**63 - 1, int(share * 2**63)))


def map_texts(df: DataFrame, batches: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow for rows that hold whole texts, in batches of BATCH_BYTES. The bound is the session's from then on."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(batches, schema)


def release() -> None:
    """Gives memory that Arrow keeps for later back to the system, at the end of a task in a worker that others follow in."""
    pa.default_memory_pool().release_unused()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where use refers to it inside a lambda: the optimizer would put
    an alias's expression there and compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_case_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
