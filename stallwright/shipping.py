"""Makes the package importable by the Python workers of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Very long texts make a batch of few rows, so a worker's memory stays bounded.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, hand the package to Spark, whose file server gives it to every executor, also to those that join later."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if not spark.conf.get(BATCH_SETTING, None):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="stallwright-ship-")  # the driver's own: executors get the file from its file server
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
