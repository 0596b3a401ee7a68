"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

# Seconds a broadcast may wait for cores while steps run side by side.
PATIENCE = 36_000
# Where the innermost ``temporary_tables`` keeps its tables.
_STEP: ContextVar[str | None] = ContextVar("step", default=None)


def get_session(app_name: str = "peerscope", **settings: str) -> SparkSession:
    """A session with the settings the library relies on; ``settings`` win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Plans here are wide; recording a call site per column costs more
        # than building the column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster
    such a folder is lost with its machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="peerscope-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/peerscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`materialize` writes inside, once the step is done or has failed.

    For steps that write their result before they end: what is still to be
    computed from such a table afterwards can't be. Steps may be nested; tables
    written with ``keep`` stay, and threads that are started inside have no step
    unless :func:`side_by_side` starts them.
    """
    folder = new_path(spark, "step")
    outer = _STEP.set(folder)
    try:
        yield
    finally:
        _STEP.reset(outer)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a rerun, and
    gives later joins true table sizes to choose a strategy from. Inside
    :func:`temporary_tables` the table goes with the step unless ``keep`` is set.
    """
    step = _STEP.get()
    path = f"{step}/{name}-{uuid.uuid4().hex}" if step and not keep else new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, steps: dict[str, Callable]) -> dict:
    """The results of independent ``steps``, each run by a thread of its own within the caller's step.

    Jobs of one step may hold all cores while another waits to broadcast a few
    rows, so broadcasts are given more time meanwhile.
    """
    timeout = spark.conf.get("spark.sql.broadcastTimeout")
    spark.conf.set("spark.sql.broadcastTimeout", str(PATIENCE))
    try:
        with ThreadPoolExecutor(len(steps)) as pool:
            # Each thread needs its own copy of the local properties.
            running = {
                name: pool.submit(copy_context().run, inheritable_thread_target(spark)(step))
                for name, step in steps.items()
            }
            return {name: run.result() for name, run in running.items()}
    finally:
        spark.conf.set("spark.sql.broadcastTimeout", timeout)
