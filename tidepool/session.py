"""Session helpers shared by tests, the bench and notebooks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine assumes everywhere: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidepool")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to Python, unless the session sets its own: both ends hold a batch for every running task.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Spark 4.1 takes a union of lists that were shuffled alike for one that is shuffled so itself; behind a broadcast join it isn't, and groups come out in pieces.
PLAIN_UNIONS = ("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session, as a zip that Python workers import from, bound the batches they get by bytes, and let unions be shuffled anew."""
    if BATCH_BYTES[0] not in spark.sparkContext.getConf().toDebugString():
        spark.conf.set(*BATCH_BYTES)
    spark.conf.set(*PLAIN_UNIONS)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-tidepool-")) / "tidepool.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, or where that is unset (tests) a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-tidepool-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/tidepool/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and an executor's loss costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
