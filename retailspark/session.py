"""Session settings and the shared folder for materialised tables."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on. Cluster sizes, memory and shuffle partitions belong to the submitter.
DEFAULTS = {
    # no Python call sites on every column expression: building a plan gets several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app="retailspark", master=None, **conf):
    """A session with the library's defaults; keyword keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): str(v) for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="retailspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def release(spark):
    """Removes all tables that jobs of this library have written under the shared folder and not removed.

    For the end of an application: results not yet written elsewhere may still read them.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), "retailspark"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark, name):
    """A fresh path under the shared folder for a table written by one job."""
    return os.path.join(shared_dir(spark), "retailspark", f"{name}-{uuid.uuid4().hex}")


def materialise(df, name="table"):
    """Write ``df`` once as a Parquet table in the shared folder and go on from the files.

    For tables read by several later jobs: the lineage ends at reliable storage, so a lost executor
    costs a file read instead of the whole history, later readers take only the columns they need, and
    the planner knows the table's size. ``release`` removes the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
