"""Session defaults for local use; a cluster's own settings are left alone."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("webloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all machines share: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a folder under /tmp stands in where it is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        root = "/tmp/webloom-checkpoints"
    return root.rstrip("/")


_SHIPPED: set[str] = set()


#: Rows of an Arrow batch in place of Spark's default of 10,000, which with whole texts would be some 100 MB a task.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that Python functions of it run wherever they are sent; keep Arrow batches small unless the session has a size of its own."""
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).parent
        archive = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(top.rglob("*.py")):
                z.write(path, path.relative_to(top.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
