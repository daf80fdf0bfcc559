"""Session helpers: the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    Only a local-mode session without the setting gets a private folder; on a cluster
    a missing setting is an error because executors cannot see the driver's disk.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="claimspark-")
        spark.conf.set(CHECKPOINT_CONF, path)
    return path


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back, in ``session`` if it is given.

    Cuts the lineage with storage that outlives executors. Unlike an RDD checkpoint, the
    table keeps column pruning and gives the optimizer its size.
    """
    spark = session or df.sparkSession
    path = new_dir(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, calls: Iterable[Callable], most: int = 8) -> list:
    """Results of independent calls that each run jobs, up to ``most`` at a time; the first error is raised when all have ended.

    Small jobs spend most of their time in the driver's planning, one thread each. The calls keep the job group of the caller.
    """
    with ThreadPoolExecutor(most) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
    return [r.result() for r in running]


def materialize_all(*dfs: DataFrame) -> list[DataFrame]:
    """:func:`materialize` of independent intermediates at once."""
    return at_once(dfs[0].sparkSession, [lambda df=df: materialize(df) for df in dfs])


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of a pattern that a job has written to its end, on any file system Spark reads."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(f.getPath().getParent().toString() for f in found)
