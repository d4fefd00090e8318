"""tarnlake: analytics over loosely structured records, and operators for training-data pipelines, on PySpark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark) -> None:
    """Send this package to the executors of the session's context, once, so that they can import it anywhere.

    Where the session sets no bounds of an Arrow batch, they become those of ARROW: Spark's own, 10,000 rows and 64 MB, are
    held several times by each task, in the JVM and in Python.
    """
    context = spark.sparkContext
    for name, value in ARROW.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    if getattr(context, "_tarnlake", False):
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp()) / "tarnlake.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, Path("tarnlake") / p.relative_to(here))
    context.addPyFile(str(path))
    context._tarnlake = True
