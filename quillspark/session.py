"""Sessions, and the package on Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the queries are written for: UTC, adaptive execution, ANSI mode. On a cluster the number of
    shuffle partitions is the caller's; a local session has few, and small tables."""
    builder = SparkSession.builder.master(master).appName("quillspark")
    settings = {"spark.sql.shuffle.partitions": "8"} if master.startswith("local") else {}
    settings |= {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """In local mode, lets Python workers import this package wherever the driver was started. Clusters get it by
    ``--py-files`` or an installation, as usual."""
    sc = spark.sparkContext
    if not sc.master.startswith("local[") or getattr(sc, "_quillspark_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="spark-")) / "quillspark.zip"
    with zipfile.ZipFile(to, "w") as z:
        for path in sorted(ROOT.glob("quillspark/**/*.py")):
            z.write(path, path.relative_to(ROOT))
    sc.addPyFile(str(to))
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, which has no other
    machines, may leave it unset; it gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The same rows read from the shared checkpoint folder: made once, and not again where executors are lost. ``tidy``: what
    was shuffled for them is deleted as soon as they are there, not when the driver happens to collect garbage."""
    shared_dir(df.sparkSession)
    if not tidy:
        return df.checkpoint()
    conf = df.sparkSession.conf
    before = conf.get(TIDY, "false")
    conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint()  # (a plan of its own, as plans keep the setting they were made under)
    finally:
        conf.set(TIDY, before)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast: for tables that grow with the input and that Spark believes to be
    small, as it counts compressed files and takes the rows that an ``explode`` makes for one."""
    return df.hint("shuffle_merge")
