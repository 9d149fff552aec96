"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every ledgerline job expects. AQE re-plans joins from runtime sizes
# (the size check behind every non-hinted broadcast) and splits skewed join
# partitions; UTC keeps dates identical to the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


#: Set to true where a ``file:`` scratch folder is a shared mount, to spare the trial of it.
SHARED_MOUNT = "ledgerline.scratch.sharedMount"

_TRIED: set[tuple[str, str]] = set()  # (application, folder): folders that passed the trial


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "ledgerline",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests and the bench; on a cluster use the cluster's session."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_shared(spark: SparkSession, folder: str) -> None:
    """Error unless a table that the executors write into ``folder`` is read back whole.

    The driver commits and lists what the executors wrote and other tasks read
    it, so where machines have folders of their own, files are missing.
    """
    try:
        known = (spark.sparkContext.applicationId, folder)
        if known in _TRIED:
            return
        n = 4 * spark.sparkContext.defaultParallelism
        path = f"{folder}/shared-{uuid.uuid4().hex}"
        spark.range(0, n, 1, n).write.parquet(path)
        read = sorted(r.id for r in spark.read.parquet(path).repartition(n).collect())
        why = "" if read == list(range(n)) else f"{len(read)} of {n} rows written there came back"
    except Exception as failed:  # whatever stops the trial stops the tables, too
        why = f"{type(failed).__name__}: {failed}"
    if why:
        raise RuntimeError(
            f"spark.checkpoint.dir is {folder}, which the machines of this cluster do not seem to share ({why}); "
            f"name shared storage, or set {SHARED_MOUNT}=true if it is a mount that all machines share"
        )
    _TRIED.add(known)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised tables.

    A ``file:`` folder is tried out on a cluster (``local`` masters run on one
    machine; see :func:`require_shared`) unless the session says that it is a
    shared mount.
    Uses ``spark.checkpoint.dir`` from the session. Only when it is unset and
    the master is local (tests, the bench) do we create a private folder and
    register it; a cluster without the setting is an error, because a
    machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        on_disk = configured.startswith(("file:", "/"))
        if on_disk and not sc.master.startswith("local") and spark.conf.get(SHARED_MOUNT, "false") != "true":
            require_shared(spark, configured.rstrip("/"))
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage for this cluster"
        )
    # a running session refuses to change spark.checkpoint.dir; later calls find what the context was given
    sc.setCheckpointDir(os.path.realpath(tempfile.mkdtemp(prefix="ledgerline-")))
    return sc.getCheckpointDir().rstrip("/")


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    try:
        return int(value) if value is not None else default
    except ValueError:
        return default


def default_parallelism(spark: SparkSession) -> int:
    return conf_int(spark, "spark.sql.shuffle.partitions", os.cpu_count() or 8)
