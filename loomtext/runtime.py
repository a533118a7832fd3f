"""Session helpers: shipping the package to executors and cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomtext-")) / "loomtext.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def scratch(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset (tests, a
    single machine) is a temporary folder made and the setting filled in.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = Path(tempfile.mkdtemp(prefix="loomtext-shared-")).as_uri()
        _ROOTS[app] = (spark, f"{base.rstrip('/')}/loomtext-{app}")
        atexit.register(_drop_root, app)
    return _ROOTS[app][1]


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table, if it is there."""
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system; None where there is none."""
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str, ending: str = "") -> list[str]:
    """The files of a folder with that ending, sorted; none where it isn't there."""
    fs, p = _filesystem(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if n.endswith(ending))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file: it is there whole or not at all."""
    fs, p = _filesystem(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(new, p):
        raise OSError(f"can't write {path}")


def _drop_root(app: str) -> None:
    spark, root = _ROOTS.pop(app)
    try:
        if spark.sparkContext._jsc is not None:
            drop(spark, root)
    except Exception:  # the session may be gone at exit
        local = root.removeprefix("file://")
        if os.path.isdir(local):
            import shutil

            shutil.rmtree(local, ignore_errors=True)


def written(df: DataFrame, name: str, *, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later jobs then start from files that outlive any executor. Returns the
    table read back and its path, for ``drop`` once nothing needs it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.partitionBy(*by) if by else df.write
    out.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
