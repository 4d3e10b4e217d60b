"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each application."""
    context = spark.sparkContext
    if _SHIPPED.get("to") == context.applicationId:
        return
    here = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="stripelore-zip-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = folder / "stripelore.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(target))
    _SHIPPED["to"] = context.applicationId
