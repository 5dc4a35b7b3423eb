"""Session factory and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE).

    On a cluster the session comes from spark-submit; nothing here is needed.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitlake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a context, where their Python wouldn't find it by itself."""
    context, home = spark.sparkContext, Path(__file__).resolve().parent
    on_path = [Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
    if home.parent in on_path or getattr(context, "_pitlake_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="pitlake-")) / "pitlake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._pitlake_shipped = True
