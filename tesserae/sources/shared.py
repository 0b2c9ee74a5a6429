"""What all that runs on executors needs: the folder that they share with the driver, and bounded batches for Python."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_made: dict[str, str] = {}  # folders of local applications


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the session has it.

    Only on a local master without one (tests on one machine) a temporary folder stands in, the same for
    the whole application; on a cluster that folder would be lost with its machine, so there an unset one raises.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
    return _made[app]


def bounded_batches(spark: SparkSession, rows: int = 512, mb: int = 16) -> None:
    """Bound what an Arrow batch holds, in rows and bytes: texts may be very long.

    Spark reads these settings when a plan starts to run, so they stay set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
