"""Session settings and cutting of lineage."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lotweave", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster, the cluster's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOTWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Only a session in local mode may go without; it gets a temporary folder, and keeps it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster must name a shared folder")
    if spark.conf.get("lotweave.local.folder", None) is None:
        spark.conf.set("lotweave.local.folder", "file://" + tempfile.mkdtemp(prefix="lotweave-"))
    return spark.conf.get("lotweave.local.folder")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, so that they need no copy of it installed; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_lotweave_shipped", False):
        return
    package, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    root = f"{shared_folder(spark).rstrip('/')}/lotweave-{uuid.uuid4().hex}"
    Scratch._mine.append((spark, root))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lotweave.zip")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(f"{root}/lotweave.zip")
    sc._lotweave_shipped = True


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs no recomputation.

    Parquet rather than RDD checkpoints: compressed, pruned by column, and with sizes the planner knows.
    """

    _mine: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/lotweave-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        Scratch._mine.append((spark, self.root))

    def cut(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables no later plan reads."""
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    for spark, path in Scratch._mine:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; a shared folder has its own cleaning
            if path.startswith(f"file://{tempfile.gettempdir()}/lotweave-"):
                shutil.rmtree(Path(path.removeprefix("file://")).parent, ignore_errors=True)
