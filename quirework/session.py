"""Session and storage helpers shared by the core and by optional subpackages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(app: str = "quirework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: adaptive plans, UTC, Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in ``spark.checkpoint.dir``; only on a single machine, as
    in tests, a temporary folder is made where that is unset. On a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quirework-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def hadoop_path(spark: SparkSession, path: str):
    """``path`` and its file system, on the side of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


_OWN: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This session's own folder within the shared one; it is deleted when the interpreter ends."""
    at = f"{shared_dir(spark)}/quirework-{spark.sparkContext.applicationId}"
    if at not in _OWN:
        _OWN.add(at)

        def leave(spark=spark, at=at) -> None:
            try:
                delete_path(spark, at)
            except Exception:  # the JVM may be gone
                pass

        atexit.register(leave)
    return at


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, so that Python stages can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = Path(__file__).resolve().parent
        own = tempfile.mkdtemp(prefix="quirework-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        target = Path(own, "quirework.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
    return spark


#: Shuffle files of a query are deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    What is written survives the loss of executors, is computed once, and is read column by column. The shuffle
    files of the plan that the cut makes superfluous are deleted with the write.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        delete_path(table.sparkSession, table._written_to)


def collect_once(df: DataFrame) -> list[Row]:
    """The rows of ``df``, which go through a written table, so that neither it nor shuffle files of its plan stay."""
    made = cut_lineage(df)
    rows = made.collect()
    discard(made)
    return rows
