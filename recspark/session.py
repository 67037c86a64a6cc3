"""Session helpers.

``configure`` applies the runtime settings every operator relies on (UTC
session time zone, AQE with skew-join splitting).  ``checkpoint_dir`` reads
the cluster's ``spark.checkpoint.dir`` and only falls back to a scratch folder
when the session runs in local mode (tests); on a cluster an unset checkpoint
directory is an error, because a machine-local folder does not survive the
loss of an executor.
"""

from __future__ import annotations

import collections
import contextlib
import os
import tempfile
import threading
from collections.abc import Callable, Iterator

from pyspark import InheritableThread, SparkConf
from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def _package_zip() -> bytes:
    """The ``recspark`` sources as a zip, built in memory."""
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg_dir):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    return buf.getvalue()


def _importable_on_executors(spark: SparkSession) -> bool:
    """One one-row task asks a Python worker whether ``recspark`` imports
    there already (installed on the cluster, or shipped with --py-files)."""
    def probe(_):
        import importlib.util

        yield importlib.util.find_spec("recspark") is not None

    return all(spark.sparkContext.parallelize([0], 1).mapPartitions(probe).collect())


def write_shared_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write ``data`` to ``path`` through the cluster's Hadoop file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the cluster's Hadoop file system has ``path``."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def ship_package(spark: SparkSession) -> None:
    """Make ``recspark`` importable in the Python workers (pandas UDFs and
    grouped-map functions live in its modules), as ``--py-files`` would.

    On a cluster nothing is shipped when the workers import it already;
    otherwise the zip goes to the shared checkpoint folder (never a
    machine-local temporary folder).  A local-mode session (tests) ships a
    scratch copy."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if _is_local(spark):
        fd, path = tempfile.mkstemp(prefix="recspark-", suffix=".zip")
        with os.fdopen(fd, "wb") as f:
            f.write(_package_zip())
        sc.addPyFile(path)
    elif not _importable_on_executors(spark):
        path = scratch_path(spark, "pyfiles") + "/recspark.zip"
        write_shared_bytes(spark, path, _package_zip())
        sc.addPyFile(path)
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def get_spark(master: str | None = None, app: str = "recspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session.  A master and a partition count that were
    submitted stay; only without a master it is local[$BENCH_CPUS or *]."""
    submitted = SparkConf()
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master or not submitted.contains("spark.master"):
        builder = (builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '*')}]")
                   .config("spark.driver.memory", os.environ.get("RECSPARK_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in _RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir) when
    the cluster names one.  Only a local-mode session without one gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    configured = spark.conf.get("spark.checkpoint.dir", None) or current
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared (distributed) folder is "
            "required for checkpoints on a cluster")
    path = tempfile.mkdtemp(prefix="recspark-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for a written table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ``scratch_path`` that nothing reads any more."""
    if not path.startswith(checkpoint_dir(spark).rstrip("/") + "/tables/"):
        raise ValueError(f"not a scratch table: {path}")
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


_SET_LOCK = threading.Lock()
_SET: dict[tuple[str, str], tuple[int, str | None]] = {}


@contextlib.contextmanager
def runtime_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Inside, the session's ``key`` is ``value``, until the last thread that asked
    for it is out again."""
    at = spark.sparkContext.applicationId, key
    with _SET_LOCK:
        users, before = _SET.get(at, (0, None))
        if not users:
            before = spark.conf.get(key, None)
            spark.conf.set(key, value)
        _SET[at] = users + 1, before
    try:
        yield
    finally:
        with _SET_LOCK:
            users, before = _SET[at]
            _SET[at] = users - 1, before
            if users == 1:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Inside, a query's shuffle files are deleted as soon as it ends, not when the
    driver happens to collect its garbage.  Meant for queries that write their result."""
    return runtime_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, size: str = "4m") -> contextlib.AbstractContextManager[None]:
    """Inside, queries send Python batches of few bytes: the JVM keeps several times
    a batch outside its heap."""
    return runtime_conf(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, name: str, by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """``df`` from a table in the shared folder; its shuffle files are gone."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with shuffles_dropped(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def garbage_collected(spark: SparkSession, seconds: float = 10.0) -> Iterator[None]:
    """Inside, the driver collects its garbage every few seconds, so that Spark
    deletes the shuffles and cached blocks of tables that are out of use (for
    libraries that run many jobs of their own)."""
    over = threading.Event()

    def work() -> None:
        while not over.wait(seconds):
            spark.sparkContext._jvm.System.gc()

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def run_side_by_side(stages: list[list[Callable[[], object]]], most: int) -> None:
    """Run the jobs of each stage after those of the stage before, at most ``most`` at a
    time.  After a failure no other job is begun; those under way end, then the failure
    is raised.  The threads last to the end: each has one of its own in the driver's JVM."""
    waiting = collections.deque((k, job) for k, stage in enumerate(stages) for job in stage)
    left, failed, turn = [len(stage) for stage in stages], [], threading.Condition()

    def worker() -> None:
        while True:
            with turn:
                turn.wait_for(lambda: failed or not waiting or not any(left[:waiting[0][0]]))
                if failed or not waiting:
                    return
                k, job = waiting.popleft()
            try:
                job()
            except Exception as e:
                failed.append(e)
            finally:
                with turn:
                    left[k] -= 1
                    turn.notify_all()

    threads = [InheritableThread(target=worker) for _ in range(min(most, max(left, default=0)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
