"""SparkSession helpers shared by the library, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "quarry",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the engine assumes.

    AQE stays on so skewed (scanner, file) groups are split at runtime and
    small shuffles are coalesced; the UI is off (no extra server).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.cpu_count() or 8
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is
    (it is required there: a driver-local folder is not visible to
    executors).  Only for a local master (tests, single machine) is a
    scratch folder created when the setting is unset.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the "
                           "cluster file system); phase tables are written there")
    local = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def phase_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table of that name under ``<spark.checkpoint.dir>/quarry-tables/``."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/{name}-{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a table that ``phase_path`` named, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_phase_table(df, name: str):
    """Write ``df`` as Parquet in a folder of ``phase_path`` and return the re-read table (a
    lineage cut that keeps column pruning)."""
    spark = df.sparkSession
    path = phase_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker (UDFs and analysts are
    unpickled there by module name).  Workers do not share the driver's
    ``sys.path`` -- on a cluster, and locally when the driver runs from another
    folder -- so the package is zipped once per application and added with
    ``addPyFile``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-pkg-")
    archive = shutil.make_archive(os.path.join(out, "quarry"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="quarry")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
