"""Session construction and the one helper that cuts lineage in iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does the size-dependent work everywhere in this package: it coalesces small
# shuffle partitions, splits skewed join partitions and turns a join into a
# broadcast only after it has seen the real size of the smaller side.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    app_name: str = "archtrail",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create or reuse a session. On a cluster leave ``master`` and
    ``shuffle_partitions`` unset so that the submit-time settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    The cluster sets ``spark.checkpoint.dir``. Only a local-mode session that
    names none gets a temporary folder; elsewhere a missing setting is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="archtrail-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and continue from there.

    A written table rather than ``checkpoint()``: it survives lost executors just
    as well, and the planner then knows the real size (so it may broadcast a
    small side) and forgets the constraints of the old plan, which in a loop
    would otherwise grow from round to round. ``by``: a column of few values to
    store it by, so that a reader who names some of them opens only their files."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/archtrail-{application}/{uuid.uuid4().hex}"
    writer = df.repartition(by).write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
