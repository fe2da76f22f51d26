"""Shared plumbing of the training-data operators: the shared folder, lineage cuts, sizes.

Nothing here touches machine-local folders when the cluster names ``spark.checkpoint.dir``;
only where that setting is absent and the master is one local process (tests) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ``[\x20\x09-\x0D]``, the white space of every word rule in this package (fixed values).
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The words those rules take.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; an own one only if that is unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        at = tempfile.mkdtemp(prefix="ebbflow-")
        atexit.register(shutil.rmtree, at, True)
        _own_dir = "file://" + at
    return _own_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder: lineage ends in files that outlive executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sized(df: DataFrame, rows: int, per_partition: int = 250_000) -> DataFrame:
    """``df`` in as few partitions as its counted rows need: small tables of an iteration would
    otherwise leave one file per map task and shuffle partition on disk."""
    return df.coalesce(max(1, -(-rows // per_partition)))


def compact(df: DataFrame, per_partition: int = 250_000, most_rows: int | None = None) -> DataFrame:
    """Checkpoints ``df``, then as ``sized``. A known bound on its rows also keeps the checkpoint's files few."""
    df = checkpointed(df if most_rows is None else sized(df, most_rows, per_partition))
    return sized(df, df.count(), per_partition)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffles of finished stages now, not when the driver next collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver program ends."""
    path = f"{shared_dir(spark)}/ebbflow/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the gateway is gone: the folder's owner cleans up
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder (column-pruned, compressed lineage cut).

    Hashes don't compress, so the cheap codec is the default.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Ships the package, and keeps Arrow batches of long texts small: rows and bytes per batch bound
    what a Python worker and the JVM beside it hold at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str):
    """A column by name, or a typed null where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores appended until no column of a user's table has those names."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks ``df`` for broadcast only when its counted ``rows`` are within the bound ``most``;
    beyond it the planner's shuffle joins (with skew splitting) are left alone."""
    return F.broadcast(df) if rows <= most else df
