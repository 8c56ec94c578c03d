"""Tables that outlast a task: Parquet below the folder that the session names in ``spark.checkpoint.dir``.

Only a local session that names none (unit tests) gets a temporary folder of its process, which is
deleted when the process ends; on a cluster that is an error, as executors wouldn't see each other's
files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session's cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found and "://" in found:
        return found.rstrip("/")
    if found:  # no scheme: a path of the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return full.replace("file:/", "file:///", 1).rstrip("/") if full.startswith("file:/") and "://" not in full else full.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="veilstone-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer pieces than there are cores, as small files do; else as it is.

    So a large table, which comes in many pieces, is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(keys: DataFrame) -> DataFrame:
    """The rows of a narrow table, a few bytes each, dealt evenly over all cores.

    For rows that cost far more to work on than to send: a column of keys is a few megabytes in one row group, which
    no split of its file divides, so the number of pieces (see ``spread``) doesn't tell how many of them have rows.
    """
    return keys.repartition(2 * keys.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
