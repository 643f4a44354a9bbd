"""Session construction and shared scratch locations.

``get_spark`` sets nothing that the submitter of a cluster job owns (master,
memory, shuffle partitions): pass such settings as ``conf`` where they are
wanted, as ``tools/local.py`` does for tests and the bench.

Scratch data (round-trip files, lineage cuts) lives under the checkpoint
directory the cluster names in ``spark.checkpoint.dir``.  Only a local session
that names none gets a folder of its own; on a cluster a machine-local folder
would be invisible to the other executors, so that raises.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "promptforge", conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory; a local session without one gets a
    new temporary folder, any other is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="promptforge-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/promptforge/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path`` (of any file system Spark knows)?"""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession, release: bool = True) -> Iterator[None]:
    """With ``release`` Spark removes the shuffle files of what runs in here once
    it is done, not when the driver next collects its garbage."""
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, str(release or before == "true").lower())
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def materialise(df: DataFrame, name: str, release: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder of
    ``spark.checkpoint.dir`` and read it back: the lineage is cut, every later
    branch reads the same rows, and lost executors take nothing with them.
    ``release``: :func:`shuffles_released`."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    with shuffles_released(spark, release):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder (of any file system Spark knows) with its files, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            removed(df.sparkSession, files[0].rsplit("/", 1)[0])
