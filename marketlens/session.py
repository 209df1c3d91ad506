"""Session helpers: a tuned local session for tests/bench, checkpoint dir."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small), coalesces small shuffle
# partitions and splits skewed join partitions, so a key holding a third of
# the rows does not land in one task.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Bytes that AQE gives a shuffle task and a scan task reads, unless the session has settings of its own: they are
#: compressed, and sorts and hash tables take some 17 times as much memory.
TASK_BYTES, SCAN_BYTES = 16 << 20, 32 << 20
#: Bytes of stored input for one of the shuffle partitions that AQE starts from; more than it needs are merged again.
INPUT_BYTES = 4 << 20
#: Bytes of stored input whose shuffles lie on disk at a time; a step that shuffles all rows several times takes more
#: than that in slices, each of which reads the input again: at most MAX_SLICES.
SLICE_BYTES, MAX_SLICES = 256 << 20, 8
_ADVISORY, _SCAN = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "marketlens",
                  event_log_dir: str | None = None) -> SparkSession:
    """Build (or reuse) a local session with the job settings applied.

    ``event_log_dir`` turns on Spark's event log there (stage and task times
    for later reading; the web UI stays off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("MARKETLENS_DRIVER_MEMORY", "16g"))
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    for key, value in CORE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_core_conf(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Apply the session-level settings the operators assume (idempotent)."""
    for key, value in CORE_CONF.items():
        spark.conf.set(key, value)
    for key, value in ((_ADVISORY, TASK_BYTES), (_SCAN, SCAN_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


#: Shuffle partitions set by ``size_shuffles``, by application: a setting of the session itself is left alone.
_SIZED: dict[str, int] = {}
#: Bytes of the largest input given to ``size_shuffles``, by application.
_INPUTS: dict[str, int] = {}


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let AQE start from a number of shuffle partitions that follows the input, so that a task's share does not grow with it.

    Never fewer than ``spark.sql.shuffle.partitions``, and never fewer than for a larger input before."""
    own, app = spark.conf.get(_INITIAL, None), spark.sparkContext.applicationId
    _INPUTS[app] = max(input_bytes, _INPUTS.get(app, 0))
    if own is not None and own != str(_SIZED.get(app)):
        return
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // INPUT_BYTES), _SIZED.get(app, 0))
    _SIZED[app] = wanted
    spark.conf.set(_INITIAL, str(wanted))


def slices(df: DataFrame, column: str) -> list[DataFrame]:
    """``df`` in parts by a hash of ``column``, as many as the input known to ``size_shuffles`` asks for; a row is in just one.

    Written one after another with ``freed_shuffles``, only one part's shuffles lie on disk. Where ``column`` is the key of
    joins or aggregates below, Spark filters their inputs by it."""
    known = _INPUTS.get(df.sparkSession.sparkContext.applicationId, 0)
    n = min(MAX_SLICES, -(-known // SLICE_BYTES))
    # xxhash64, not the hash that deals rows to shuffle partitions: a part still reaches all of those
    return [df.where(F.pmod(F.xxhash64(column), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


_FREEING: dict[SparkSession, tuple[int, str | None]] = {}
_FREE_LOCK = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of a write inside as soon as it ends, not when the driver's JVM happens to collect its plan.

    For writes only, whose plans are not used again: a DataFrame collected inside would shuffle anew the next time."""
    with _FREE_LOCK:
        depth, before = _FREEING.get(spark, (0, None))
        if not depth:
            before = spark.conf.get(_FREE, None)
            spark.conf.set(_FREE, "true")
        _FREEING[spark] = depth + 1, before
    try:
        yield
    finally:
        with _FREE_LOCK:
            depth, before = _FREEING.pop(spark)
            if depth > 1:
                _FREEING[spark] = depth - 1, before
            elif before is None:
                spark.conf.unset(_FREE)
            else:
                spark.conf.set(_FREE, before)


@contextmanager
def plain_plans(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Plan and run without adaptive re-planning: for small aggregates inside a driver loop.

    AQE runs each shuffle stage of a query as a job of its own; a partial
    aggregate that ends in a few rows has nothing to re-plan and is one job
    without it. Nor are its shuffle partitions merged: ``partitions`` sets
    how many there are, where the rows shuffled are known to be few."""
    wanted = {"spark.sql.adaptive.enabled": "false"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session. Only a local-mode session
    (tests, bench) without one gets a fresh folder under the temp dir; on a
    cluster a machine-local folder would not survive executor loss, so an
    unset value is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="marketlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # made here, so removed here
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """Name of a new folder in the shared checkpoint folder; what is there when the driver's Python ends is deleted."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _delete_scratch() -> None:
    for spark, path in _SCRATCH:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM is gone: the folder's owner cleans up
            return


def checkpoint_table(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint into the shared checkpoint folder.

    The rows are cached while the checkpoint is written: a reliable
    checkpoint of an uncached plan runs the plan twice (once for the action,
    once to write the files)."""
    checkpoint_dir(df.sparkSession)
    cached = df.persist()
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``marketlens`` importable in Python workers (once per context).

    Grouped-map / map-in-pandas steps run functions of this package on the
    executors. In local mode (tests, bench) the package sources are zipped
    and added with ``addPyFile``, so workers started from any working
    directory import the same code as the driver. On a cluster the package
    is deployed like any PySpark library (installed on the nodes or passed
    with ``--py-files``), so nothing is written to machine-local folders."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        fd, path = tempfile.mkstemp(prefix="marketlens-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            for dirpath, dirnames, files in os.walk(pkg_dir):
                dirnames[:] = [d for d in dirnames if d != "__pycache__"]
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(dirpath, name)
                        zf.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        atexit.register(lambda: os.path.exists(path) and os.remove(path))  # tasks fetch it as long as the session lives
        _SHIPPED.add(sc.applicationId)
