"""Spark session helpers.

All operators assume ``spark.sql.session.timeZone=UTC`` (the final service
interprets every bound and epoch value as UTC).  On a cluster the session is
handed to us already configured; ``get_spark`` only fills in settings that are
still unset so local runs and tests behave like the cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on.  They are applied only where the session
# does not define them already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts go to Python in batches of so many bytes; JVM and worker hold several copies of one.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "machlog") -> SparkSession:
    """Local session for tests / bench.  Never used on a real cluster."""
    master = master or os.environ.get("MACHLOG_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults the operators rely on, without overriding the
    cluster's own settings (except the time zone, which is semantic)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    _show_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def _show_package(spark: SparkSession) -> None:
    """Let Python workers look where this package was imported from, also when the
    driver runs in another folder.  On a cluster whose nodes do not have that folder
    the package must be installed or passed with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names the folder; we read it from the session.  Only when it
    is unset (local tests) do we create one under the system temp folder; a
    cluster must name one, as its nodes do not share that folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="machlog-ckpt-")
    sc.setCheckpointDir(local)
    return local
