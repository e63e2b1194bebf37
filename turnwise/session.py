"""SparkSession defaults for local runs and tests; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with one shuffle partition per core."""
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("turnwise")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": memory} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session whose executors do not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="spark-turnwise-")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
