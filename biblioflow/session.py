"""Session helpers: a tuned local session, and the package for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution and Arrow transfer, as the tests and the benchmark use it."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("biblioflow")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once a session, unless PYTHONPATH names it for them already."""
    app = spark.sparkContext.applicationId
    if app not in _shipped and str(ROOT) not in os.environ.get("PYTHONPATH", "").split(":"):
        path = Path(tempfile.mkdtemp(), "biblioflow_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(Path(__file__).parent.rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
    return spark
