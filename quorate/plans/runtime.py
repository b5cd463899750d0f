"""Session-level helpers: shared scratch tables, size checks, table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that workers find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quorate_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="quorate-"))  # on the driver, which serves it
    with zipfile.ZipFile(folder / "quorate.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"quorate/{f.relative_to(root)}")
    context.addPyFile(str(folder / "quorate.zip"))
    context._quorate_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset on a local master (tests on one machine) a local folder is made
    and set; on a cluster it is an error, as no other machine would see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quorate-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, rows: bool = False):
    """Writes df as a Parquet table in the shared folder and returns the scan of it.

    This cuts lineage as checkpoint() does, survives the loss of executors, and, being
    columnar, lets later steps read only the columns they need. With rows=True the row
    count (from the Parquet footers) is returned too.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, out.count()) if rows else out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope():
    """Removes the scratch tables made inside it at its end; results must be used or written inside."""
    before = len(_SCRATCH)
    try:
        yield
    finally:
        while len(_SCRATCH) > before:
            delete_path(*_SCRATCH.pop())


def drop_scratch() -> None:
    """Removes the scratch tables of this process; also done at its end."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone
            pass


atexit.register(drop_scratch)
