"""Session set-up and the few helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What a shuffle's task should read about, and the partitions that a session has at least.
TASK_BYTES, LEAST_PARTITIONS = 128 << 20, 200


def partitions_for(shuffled_bytes: int) -> int:
    """Shuffle partitions for an amount of shuffled data; adaptive execution joins those that turn out small.

    Range partitioning, on which the distributed sorts rely, makes this many parts too. At 100 TB that is some 800,000.
    """
    return max(LEAST_PARTITIONS, -(-shuffled_bytes // TASK_BYTES))


def build_session(
    app: str = "gridwake", master: str | None = None, shuffled_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the library relies on; on a cluster, spark-submit's settings win.

    ``shuffled_bytes``, the largest amount a query will shuffle, sets the number of shuffle partitions: the default of 200 would
    mean 500 GB a task at 100 TB.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffled_bytes is not None:
        defaults["spark.sql.shuffle.partitions"] = str(partitions_for(shuffled_bytes))
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) is a temporary folder used, and only in local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gridwake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared folder, for tables that a query writes on its way; it goes with the application.

    Its results are read lazily, so it can't go earlier. What an application leaves that was killed can be told by its name.
    """
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/gridwake-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Written tables in the shared folder that cut the lineage of loops.

    Unlike a checkpoint, a table that is read back carries neither the constraints nor the statistics of the plan that made it, which
    grow with every round of a loop; and its size is known, so small tables are joined by broadcast.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_folder(spark)}/{name}/{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but_last(self) -> None:
        for path in self.paths[:-1]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = self.paths[-1:]


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads at most one row beyond that many."""
    return df.limit(rows + 1).count() <= rows
