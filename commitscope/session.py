"""Session helpers: one place for the configuration the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job assumes.  AQE re-plans shuffles at run time (coalesces
# small partitions, splits skewed join partitions); UTC keeps timestamps
# comparable with the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "commitscope",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the defaults above.

    On a cluster pass ``master=None`` so spark-submit decides; locally the
    caller chooses ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we use it as is.  Only a local
    session without one gets a scratch folder; a cluster without one is
    refused, since executors cannot see each other's folders.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir() or configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # ``spark.checkpoint.dir`` is a core setting that cannot change at run
    # time; the context's checkpoint folder can.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="commitscope-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``commitscope`` importable in the Python workers.

    Python stages (the JSON validator, the caller's model function) are
    pickled by reference to this package; executors only have it if it is
    installed there or shipped.  Ship a zip of the package once per
    SparkContext with ``addPyFile`` (Spark copies it to every executor).
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="commitscope-py-"), "commitscope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(id(sc))


def recommended_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 128) -> dict[str, str]:
    """Partition sizing for a cluster run.

    Diffs are wide text rows and the in-row parse multiplies a row's size a
    few times (file arrays, groups, prompts), so stages are sized for
    ``target_partition_mb`` of *input* per task: file splits of that size,
    and an initial shuffle-partition count of input / target (at least two
    waves of the cluster's cores), which AQE then coalesces towards the
    same advisory size.  Skewed partitions above 4x the advisory size are
    split by AQE's skew-join handling.
    """
    target = target_partition_mb * 1024 * 1024
    partitions = max(2 * total_cores, -(-int(input_bytes) // target))
    partitions = -(-partitions // total_cores) * total_cores  # whole waves
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
    }
