"""Where intermediate tables live, and how code reaches the executors.

Every intermediate result that must survive the loss of an executor is written
to the folder named by ``spark.checkpoint.dir``, which all executors share. The
setting is read from the session; only where it is unset on a local master (tests, a
laptop) a private temporary folder is made. On a cluster it must be set.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PRIVATE: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session's cluster, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="stavewright-")
        atexit.register(shutil.rmtree, _PRIVATE[app], ignore_errors=True)
    return f"file://{_PRIVATE[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; :func:`release` deletes it again."""
    path = f"{shared_dir(spark)}/stavewright/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there. ``by`` gives each of its values a folder, read alone.

    A task that is lost later re-reads its split of the written files instead of
    recomputing the plan behind them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session, once no result needs them."""
    for item in [x for x in _WRITTEN if x[0] is spark]:
        delete(*item)
        _WRITTEN.remove(item)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once a session)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="stavewright-code-")  # read by the driver alone, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = Path(folder) / f"{root.name}.zip"
    name.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(name))
    _SHIPPED.add(app)
