"""Getting this package to the Python workers, wherever the session was started from."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application. Operators that run Python in tasks call it."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():
        return  # Imported from an archive, so it was shipped by whoever submitted the job.
    folder = tempfile.mkdtemp(prefix="zonespark-package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
