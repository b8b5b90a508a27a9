"""Getting this package to Python workers that don't find it by themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once, as spark-submit --py-files would.

    Nothing is done where PYTHONPATH, which workers share, has the package's place.
    """
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="tidemark-zip-")  # the driver serves it for as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in [*sorted((ROOT / "tidemark").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
