"""Session defaults, and the package's way to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lectern").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Spark's own bound of a batch on its way to a Python worker, and the one taken instead: a batch is held several times over, by
#: the executor and by each worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once per application, so that Python functions can be loaded there. Where the
    session has not set a bound of its own, batches that go to Python are small."""
    key, usual, ours = BATCH_BYTES
    if spark.conf.get(key) == usual:
        spark.conf.set(key, ours)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        if root.is_dir():  # else it runs from a shipped archive already
            path = Path(tempfile.mkdtemp(prefix="lectern-src-")) / "lectern_src.zip"
            with zipfile.ZipFile(path, "w") as z:
                for f in sorted(root.rglob("*.py")):
                    z.write(f, f.relative_to(root.parent))
            spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that the driver and all executors share; where it is unset, on one
    machine, below a folder of this application."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _scratch:
            _scratch[app] = tempfile.mkdtemp(prefix="lectern-work-")
            atexit.register(shutil.rmtree, _scratch[app], True)
        base = "file://" + _scratch[app]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
