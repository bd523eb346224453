"""SparkSession construction and cluster-aware settings."""

from __future__ import annotations

import functools
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the engine relies on. They are applied only where the
# session has no value yet, so a cluster's own settings (spark-submit,
# spark-defaults) always win.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Mails run to tens of thousands of words: a 10,000-record Arrow batch of
    # long texts would put gigabytes into one Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}
# Settings that must be given when the JVM starts (only used when this module
# creates the session itself).
STATIC_DEFAULTS = {
    "spark.ui.enabled": "false",
    # Python workers are reused across tasks (no fork and import per task).
    "spark.python.worker.reuse": "true",
}


def get_spark(master: str | None = None, app: str = "mailsift", shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, creating one (local for tests / bench)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    static = dict(STATIC_DEFAULTS)
    if master and master.startswith("local"):
        static.setdefault("spark.driver.memory", "16g")
    static.update({k: v for k, v in (extra or {}).items() if not k.startswith("spark.sql.")})
    for k, v in static.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in SQL_DEFAULTS.items():
        if spark.conf.get(k, None) is None:  # None: never set explicitly
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``;
    it is only set here when nothing configured it (local tests), in which
    case a fresh scratch folder is used.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="mailsift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written hand-off tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}"


def handoff(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once,
    its lineage is cut, and its size is known to the planner."""
    spark = df.sparkSession
    path = handoff_path(spark, "handoff", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes = threading.local()


def handoff_path(spark: SparkSession, folder: str, name: str) -> str:
    """A new path for a hand-off table, noted in the innermost open scope."""
    path = f"{shared_scratch(spark, folder)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def handoff_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Delete, when the block ends or fails, the hand-off tables that this thread
    wrote in it. A frame that reads one must be written or collected by then;
    a path taken off the yielded list is kept."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield made
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in made:
            delete_path(spark, path)


def clears_handoffs(flow: Callable) -> Callable:
    """A flow (session first) whose result holds no lazy frame: its hand-off
    tables are deleted when it returns."""
    @functools.wraps(flow)
    def run(spark: SparkSession, *args, **kwargs):
        with handoff_scope(spark):
            return flow(spark, *args, **kwargs)
    return run


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a local
    session that did not start from the package's folder.

    Executors import the package for pandas UDFs and ``mapInPandas``. On a
    cluster it is shipped the usual way (``--py-files`` or an installed
    wheel); on a local master it is zipped once into the session's scratch
    folder and added with ``addPyFile``."""
    sc = spark.sparkContext
    if not sc.master.startswith("local") or getattr(sc, "_mailsift_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    folder = ensure_checkpoint_dir(spark)
    folder = folder[len("file:"):] if folder.startswith("file:") else folder
    path = os.path.join(folder, f"mailsift-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    sc._mailsift_shipped = True
