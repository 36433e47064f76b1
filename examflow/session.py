"""Spark session and shared-folder helpers.

Everything that must survive an executor loss (lineage cuts, written logs,
streaming checkpoints) goes under the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (local runs,
tests) do we pick a folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults sized for a laptop; a cluster deployment overrides them through
# spark-submit / spark-defaults. Nothing here is required for correctness.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A responder may call a paid service: a speculative duplicate task would
    # repeat those calls, so speculation stays off.
    "spark.speculation": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, app: str = "examflow", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = _context(spark)
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            _local_only(spark.conf.get("spark.master", "local"))
            configured = tempfile.mkdtemp(prefix="examflow-ckpt-")
            spark.conf.set("spark.checkpoint.dir", configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        # Unset: in a local run or a test a private temp folder is fine.
        _local_only(sc.master)
        configured = tempfile.mkdtemp(prefix="examflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _local_only(master: str) -> None:
    """On a cluster every machine has its own temp folder, so none will do."""
    if master.partition("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/examflow-{name}-{uuid.uuid4().hex[:12]}"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of Spark's 64, unless the session names a size of its
    own: a batch of long texts is several times as large as Python values, in each worker."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, 8 * 1024 * 1024)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (``--py-files``).

    Python code that runs on executors (the responder) is pickled by
    reference, so the executors need the package itself. It is zipped once
    per application on the driver and served to the executors by Spark.
    """
    sc = _context(spark)
    app = sc.applicationId if sc is not None else f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="examflow-pyfiles-")
    archive = os.path.join(out_dir, "examflow.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(app)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
