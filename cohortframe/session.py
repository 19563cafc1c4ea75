"""Session helpers: local sessions for tests, staging of intermediate tables, size-checked small tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

SMALL_ROWS = 100_000
SMALL_VALUES = 2_000_000
ARRAY_VALUES = 1024  # what an array column counts for


def local_session(cores: str = "*", partitions: int = 8, name: str = "cohortframe", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortframe-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir."""
    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, wide_design: bool = False) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and read it from there.

    Cuts the lineage of iterative work and survives the loss of an executor. For wide designs (many columns derived
    from the same few inputs) the optimizer's constraint inference, which grows exponentially there, is off while the
    plan is made.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    if not wide_design:
        return df.checkpoint(eager=True)
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def bounded(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate an aggregate once and check its size.

    Up to ``max_rows`` rows it comes back as an in-memory table marked for broadcast; a larger one is staged and
    joined by shuffle. Rows of many values lower the limit, so that no more than ``SMALL_VALUES`` come to the driver. The
    flag tells which.
    """
    width = sum(ARRAY_VALUES if isinstance(f.dataType, (ArrayType, MapType)) else 1 for f in df.schema.fields)
    max_rows = min(max_rows, max(1, SMALL_VALUES // max(1, width)))
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema)), True
    return stage(df), False


def small_rows(df: DataFrame, what: str, max_rows: int = SMALL_ROWS) -> list:
    """Rows of a table that must be small (parameters, knots, levels); refuses larger ones."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
