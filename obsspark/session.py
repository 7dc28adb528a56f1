"""Session helpers.

Operators never create sessions; these helpers exist for tests, the
benchmark and the driver entry point.  Cluster settings that are
already present on the session (checkpoint dir, shuffle partitions)
are always respected.
"""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

# Largest per-source tail we plan for; the WindowGroupLimit pruning of
# row_number() <= N is only planned when N is below this threshold.
DEFAULT_WINDOW_GROUP_LIMIT = 50_000


def get_session(master: str | None = None, app: str = "obsspark",
                shuffle_partitions: int | None = None, extra_conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # checkpoint files of materialized intermediates are removed
               # once their DataFrames are garbage collected
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession, max_tail: int = DEFAULT_WINDOW_GROUP_LIMIT) -> None:
    """Settings the operators' semantics rely on.

    * UTC session zone: offset-less line timestamps are read as UTC.
    * windowGroupLimitThreshold >= the largest tail so that
      ``row_number() <= N`` is pruned per partition before the shuffle.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cur = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if cur < max_tail:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max_tail))


def shared_dir(spark: SparkSession, sub: str | None = None) -> str:
    """A folder every executor can reach.

    Uses the cluster's ``spark.checkpoint.dir``.  Without that setting a
    local session uses a folder of its warehouse, and any other master
    raises: a folder of our choice would not be shared.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    if sub is None:
        return base
    return os.path.join(base.rstrip("/"), f"{sub}-{uuid.uuid4().hex}")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder (a reliable checkpoint) and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Hand this package, with all its parts, to the executors' Python, whatever their search path; once per application."""
    context = spark.sparkContext
    if getattr(context, "_obsspark_shipped", False):
        return
    folder = os.path.join(SparkFiles.getRootDirectory(), "package")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "obsspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for place, _, names in sorted(os.walk(_PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(place, name), os.path.relpath(os.path.join(place, name), os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context._obsspark_shipped = True


def scale_settings(input_bytes: int, executor_cores_total: int, target_partition_bytes: int = 256 << 20,
                   max_tail: int = DEFAULT_WINDOW_GROUP_LIMIT) -> dict[str, str]:
    """Session settings sized for an input of ``input_bytes``.

    * scan splits of ~128 MiB (``maxPartitionBytes``) keep each scan
      task's sort for the partial WindowGroupLimit in memory;
    * ``shuffle.partitions`` is an upper bound of input / target size
      (at least 2 waves of the cluster's cores); AQE coalesces small
      shuffles down to ``advisoryPartitionSizeInBytes`` and splits skewed
      partitions of joins;
    * the window-group-limit threshold admits the largest tail.
    """
    parts = max(2 * executor_cores_total, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": str(max_tail),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int, executor_cores_total: int, **kw) -> dict[str, str]:
    conf = scale_settings(input_bytes, executor_cores_total, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
