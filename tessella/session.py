"""Session helpers: a session with the engine's defaults, and the package on every worker's path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "tessella_shipped"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT_ROWS = "10000"
#: Rows of an Arrow batch where the session has Spark's own default.
BATCH_ROWS = 1_000


def build(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Timers, lists and maps of streams (streaming.stateful) live in this store only.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a context, for code that they run by name.

    Arrow batches get at most BATCH_ROWS rows, unless the session states another number than Spark's default of
    10,000: rows may hold long texts, and a batch is held by the JVM and by the worker at once.

    The archive lies in a folder of the driver's; Spark itself serves it to the executors.
    """
    if spark.conf.get(_BATCH, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "tessella.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)
