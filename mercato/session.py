"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  The session time zone matters for
# month truncation of timestamps; AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting protects the
# order-grain joins against a hot key.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their DataFrames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


MB = 1 << 20
JOBS_AT_ONCE = 4


def cluster_conf(total_input_bytes: int, executor_cores_total: int,
                 target_partition_bytes: int = 128 * MB) -> dict[str, str]:
    """Sizing for a cluster run, from the bytes the jobs will scan.

    Scan splits of 256 MB; an initial shuffle partition count that keeps
    each shuffle partition near ``target_partition_bytes`` even if a job
    shuffles as much as it reads (AQE then coalesces the small ones), at
    least twice the total cores; skew splitting above 4x the target.  The
    count follows the input without a cap; where the driver should track
    fewer partitions, pass a larger ``target_partition_bytes``.
    """
    initial = max(2 * executor_cores_total, -(-total_input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 * MB),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mercato", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    On a cluster the directory must be shared storage named by the
    deployment in ``spark.checkpoint.dir``; we read it from the session.
    Only a local-mode session (tests, single-node bench) without one gets
    a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mercato-ckpt-"))
    return sc.getCheckpointDir()


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the session's checkpoint folder and read it back (lineage is cut).

    A ``DataFrame.checkpoint`` would compute its last stage twice, once to
    count and once to write; a written table is computed once, survives lost
    executors and is read back with column pruning.  The files have the
    session's ``compression`` unless one is named.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, actions: Iterable[Callable[[], object]]) -> list:
    """Results of independent Spark actions, ``JOBS_AT_ONCE`` of them side by side.

    One job's last tasks then leave no core idle.  All actions that began have
    ended when this returns or raises; the first failed one, in order, is raised.
    """
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(action)) for action in actions]
        try:
            return [r.result() for r in running]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
