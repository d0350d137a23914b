"""Session settings and lineage cutting shared by the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job expects. AQE splits hot join keys and sizes reduce
# partitions from measured bytes; broadcast joins stay behind Spark's own size check.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
}

# Shuffle files of a query go when it ends, not when the driver's garbage is collected some time later.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Only for sessions on one machine that name no shared folder, such as tests.
LOCAL_SCRATCH = "/tmp/checkpoints"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # a report compiles a few hundred stages; the default of 100 makes every run compile anew
        .config("spark.sql.codegen.cache.maxEntries", "5000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", LOCAL_SCRATCH)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """Folder for tables written between the stages of a job.

    It is the shared folder the cluster names in ``spark.checkpoint.dir``. Without that setting
    a local master uses ``LOCAL_SCRATCH``; anywhere else a machine-local path would be lost
    with its executor, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the scratch root, readable by every executor."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: for those that write all that is read of them later."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


class Stages:
    """Tables written once between the steps of a job, in the shared folder.

    Writing cuts the lineage like a checkpoint, and later readers scan only the columns they
    use. The shuffle files of a step go when its table is written, so a job of several steps holds those of
    one at a time. ``drop`` removes tables that no later step reads; what a returned DataFrame still
    reads stays until the retention of the shared folder removes it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, scratch_path(spark, name), 0

    def write(
        self, df: DataFrame, name: str, buckets: tuple[int, str] | None = None, codec: str = "snappy"
    ) -> DataFrame:
        """``df`` as written; with ``buckets`` (number, column) equal values of the column share a bucket.

        A bucketed table is read as dealt by that column, so grouping by it and more does not shuffle. It needs
        a catalogue entry while it is made; the entry goes at once, the files stay.
        """
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        if buckets is None:
            with shuffles_dropped(self.spark):
                df.write.option("compression", codec).parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            entry = f"stage_{uuid.uuid4().hex}"
            out = df.write.bucketBy(*buckets).option("path", path).option("compression", codec)
            with shuffles_dropped(self.spark):
                out.format("parquet").saveAsTable(entry)
            out = self.spark.table(entry).select(*df.columns)
            out.schema  # analysed while the entry is there
            self.spark.sql(f"DROP TABLE {entry}")
        out.stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table.stage_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "stage", codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back."""
    return Stages(df.sparkSession, name).write(df, name, codec=codec)
