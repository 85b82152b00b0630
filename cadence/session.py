"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Paths that this driver has made in the shared folder.
_MADE: list[str] = []
_SHIPPED: set[str] = set()


def build_session(name: str = "cadence", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume (UTC, AQE), and with this package sent to its executors; `conf`
    overrides the settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="cadence-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the cluster names it.

    Only where the setting is absent and the master is local (tests on one machine) a temporary folder is made and set;
    on a cluster its absence is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (
        jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    )
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="cadence-"))
        spark.sparkContext.setCheckpointDir(named)
    elif not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Remove what written() and work_path() have made in this session; results read from there must be saved before."""
    jvm = spark.sparkContext._jvm
    for path in _MADE:
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
    _MADE.clear()
