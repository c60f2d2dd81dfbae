"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def session(app: str = "strandweave", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by name. With a schema nothing is inferred, and columns beyond it are not read."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandweave-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written and not yet removed, with their session. What a returned plan still reads is removed when the program ends.
_WRITTEN: dict[str, SparkSession] = {}


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The files survive the loss of any executor. `dropped` or `scratch` frees them; what a returned
    plan reads lazily is freed at the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandweave/{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandweave_path = path
    return out


def _removed(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by `written` that no later plan reads."""
    for df in tables:
        _removed(getattr(df, "_strandweave_path", ""))


@contextmanager
def scratch(df: DataFrame, partitions: int | None = None) -> Iterator[DataFrame]:
    """A written table for the time of a block whose results are all collected or written within."""
    out = written(df, partitions)
    try:
        yield out
    finally:
        dropped(out)


@atexit.register
def _end() -> None:
    for path in list(_WRITTEN):
        try:
            _removed(path)
        except Exception:  # the session has ended: nothing can be reached any more
            _WRITTEN.pop(path, None)
