"""Session construction and session-level settings shared by every plan."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime

from pyspark.sql import SparkSession

# The single clock of the engine: every "now" of the reference becomes this
# explicit parameter (time of day is kept; it matters for floor-day maths).
DEFAULT_AS_OF = datetime(2001, 6, 15, 12, 0, 0)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "revlens") -> SparkSession:
    """Session with the settings every plan assumes.  For local runs pass a
    ``local[...]`` master (8 shuffle partitions unless given); on a cluster
    pass no master and leave ``spark.sql.shuffle.partitions`` to the cluster
    configuration or size it with ``recommended_shuffle_partitions``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if shuffle_partitions is None:
            shuffle_partitions = 8
        builder = builder.config("spark.driver.memory", os.environ.get("REVLENS_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}       # of local applications without the setting


def ensure_checkpoint_dir(spark: SparkSession, local_dir: str | None = None) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, registered with
    the context.  Where that is unset, a local session uses ``local_dir``, or
    a folder of its own (tests), for all of its life; on a cluster it is an
    error, as a machine-local folder would not survive the loss of an executor."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
        app = context.applicationId
        if local_dir is not None or app not in _own_folders:
            _own_folders[app] = local_dir or tempfile.mkdtemp(prefix="revlens-checkpoint-")
        folder = _own_folders[app]
    context.setCheckpointDir(folder)
    return folder


def recommended_shuffle_partitions(input_bytes: int, target_bytes: int = 256 << 20,
                                   minimum: int = 8) -> int:
    """Initial shuffle partition count for a job reading ``input_bytes``:
    about ``target_bytes`` per task before AQE coalesces small partitions
    (set it as ``spark.sql.shuffle.partitions`` or AQE's
    ``coalescePartitions.initialPartitionNum``)."""
    return max(minimum, -(-input_bytes // target_bytes))
