"""Session defaults and the two helpers every multi-job operator needs: shipping this
package to Python workers, and cutting lineage with a table in the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch. Texts can be long, so the default of 10,000 is lowered where it is unset.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(name: str = "posegrid", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC, AQE and small shuffles; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each application, so that functions
    passed to mapInArrow and applyInPandas can be imported there whatever the working folder is."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        out = tempfile.mkdtemp(prefix="posegrid-")
        zipped = shutil.make_archive(os.path.join(out, "posegrid_src"), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(zipped)
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all
    runs on one machine (tests). On a cluster executors could not read each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="posegrid-checkpoint-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later jobs start from files
    that outlive any executor, and the lineage above is cut. The result's table_path says where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise wrote, once no later job reads it."""
    remove(df.sparkSession, df.table_path)
