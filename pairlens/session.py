"""Session construction and lineage cutting.

On a cluster the session is built by the platform; ``spark.checkpoint.dir``
names a shared folder. ``checkpoint_dir`` reads that setting and only sets
a fresh scratch folder when it is unset (local runs and tests).
"""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()
#: what queries store below the checkpoint folder
_STORES = ("tables", "io", "weights")


def get_spark(master: str | None = None, app: str = "pairlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests. Cluster jobs use their own session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # bounds the rows x L scratch of the encode UDF (see operators.vectors)
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.sql.session.timeZone", "UTC")
        # one BLAS thread per Python worker: Spark already runs one task per core
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        # checkpoint files of unreferenced tables are removed during the session
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """One JVM on this machine (``local``, ``local[8]``); ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints.

    Uses ``spark.checkpoint.dir`` when the cluster sets it. Only a local master
    (tests, local runs) may go without: it takes a fresh scratch folder and
    records it in the session. On any other master a machine-local folder would
    lose what executors write, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        ship_package(spark, current)
        return current
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or sc.getConf().get(_CHECKPOINT_CONF, None)
    if not configured:
        if not is_local(sc.master):
            raise ValueError(f"{_CHECKPOINT_CONF} must name a folder that all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="pairlens-ckpt-")
        spark.conf.set(_CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    folder = sc.getCheckpointDir() or configured
    ship_package(spark, folder)
    return folder


def shared_file(spark: SparkSession, path: str):
    """A new file on any Hadoop file system, open for ``write(bytearray)``."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)


def ship_package(spark: SparkSession, folder: str) -> None:
    """Make ``pairlens`` importable in the Python workers.

    The Arrow-batch steps reference functions of this package, so executors
    must be able to import it. The package is zipped into the shared folder
    (any Hadoop file system) and added with ``addPyFile`` once per application.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    atexit.register(_remove_stores, folder, os.getpid())
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    target = f"{folder.rstrip('/')}/pyfiles/pairlens-{digest}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
        out = shared_file(spark, target)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def _remove_stores(folder: str, pid: int) -> None:
    """Stored tables live as long as the driver's process. Folders that only Spark opens are left."""
    from pairlens.sources.paths import exists, open_path
    if os.getpid() != pid:
        return
    for name in _STORES:
        try:
            system, at = open_path(f"{folder.rstrip('/')}/{name}")
            if exists(system, at):
                system.delete_dir(at)
        except (OSError, ValueError):
            pass


def release(spark: SparkSession) -> None:
    """Remove what the queries of this session have stored; their results must have been read by then."""
    _remove_stores(checkpoint_dir(spark), os.getpid())


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage by writing Parquet into the shared folder and reading it back:
    later steps read only the columns they need, and a lost executor costs
    nothing that was already written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What a write deals out within goes from the disks when it is done, not only when the driver collects its garbage."""
    before = spark.conf.get(_SHUFFLE_CONF, None)
    spark.conf.set(_SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLE_CONF) if before is None else spark.conf.set(_SHUFFLE_CONF, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where the partitions of a result must not change between the jobs that
    read it (range-partitioned frames whose bounds are sampled).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
