"""Session defaults and shared scratch folders."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", app: str = "tidemark") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else the warehouse, which the cluster shares as well."""
    existing = spark.sparkContext.getCheckpointDir()
    folder = spark.conf.get(CHECKPOINT_KEY, None) or existing or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    if existing is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run of a job, in a folder of the application's own that goes when the application ends."""
    context = spark.sparkContext
    own = f"{shared_folder(spark).rstrip('/')}/tidemark-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def with_imports(df: DataFrame) -> DataFrame:
    """The same rows, ready for a Python function of this package: workers on this machine find the package where the driver did.

    A cluster ships it (--py-files) or has it installed.
    """
    env = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed dimension as an inline VALUES table, so Catalyst knows its exact size."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, int):
            return str(value)
        if isinstance(value, float):
            return f"{value!r}D"
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def small_dimension(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """An inline table marked for broadcast; its row count is fixed in the source code."""
    if len(rows) > 200:
        raise ValueError("dimension too large for a fixed inline table")
    return F.broadcast(inline_table(spark, columns, rows))
