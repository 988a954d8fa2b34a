"""Sessions: settings for local runs, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
_shipped: weakref.WeakSet = weakref.WeakSet()


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, in UTC, without the interface."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions)
    settings = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory, "spark.ui.showConsoleProgress": "false"}
    settings["spark.python.sql.dataFrameDebugging.enabled"] = "false"  # the place in the code of every expression costs more than small plans do
    return builder.config(map=settings).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where files with few row groups would keep some idle.  What has as many partitions as
    there are cores, as any large input does, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


#: Bytes of texts that Python holds as objects at once.
AT_ONCE = 1 << 21


def in_slices(batches: Iterable[pa.RecordBatch | pa.Array], most: int = AT_ONCE) -> Iterator[pa.RecordBatch | pa.Array]:
    """Batches (or columns) in slices of about so many bytes: Spark fills a batch with up to 10,000 rows or 64 MB, of which objects of Python
    would take several times as much."""
    for b in batches:
        step = max(1, len(b) * most // max(b.nbytes, 1))
        for start in range(0, len(b), step):
            yield b.slice(start, step)


def in_blocks(df: DataFrame, key: str, most: int) -> Iterator[list[Row]]:
    """Rows of a table on the driver, at most about ``most`` at a time, those of one key together.  A table that
    has no more is read once."""
    rows = df.limit(most + 1).collect()
    if len(rows) <= most:
        if rows:
            yield rows
        return
    blocks = -(-df.count() // most)
    for i in range(blocks):
        if part := df.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).collect():
            yield part


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; a folder of our own only where it says nothing, on a local master."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestra-"))


def kept(df: DataFrame) -> DataFrame:
    """Computed once, in the folder of checkpoints: read again after executors are lost, and no memory of theirs
    is held for it.  spark.cleaner.referenceTracking.cleanCheckpoints lets Spark delete it when it is done with."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for tables that are written and read again."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless they find it where the driver does: by
    PYTHONPATH, or, on one machine, in the working folder."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = context.master.startswith("local") and "cluster" not in context.master and Path.cwd().resolve() == ROOT
    if context in _shipped or ROOT in paths or here:
        return
    file = Path(tempfile.mkdtemp(prefix="attestra-")) / "attestra.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted((ROOT / "attestra").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(file))
    _shipped.add(context)
