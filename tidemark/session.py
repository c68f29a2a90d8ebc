"""Getting this package to the executors, and the folder that they share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, once a session, unless their path has it already."""
    application = spark.sparkContext.applicationId
    if application in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((ROOT / "tidemark").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(application)


SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would be a folder of one machine, so there it is an error.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(SETTING, folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
