"""Reading tables and cutting lineage in storage that every executor shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once, for clusters that don't have it installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="mneme-package-"))
    atexit.register(shutil.rmtree, folder, True)
    copy = folder / "copy" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", copy.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, cut to ``columns`` where given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of a side that are sent to every task at most.
BROADCAST_BYTES = 64 << 20
#: Bytes that a value of a fixed-width type takes in a broadcast table.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """Bytes of one value, from the sizes of what it holds."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        fixed = _WIDTHS.get(kind.elementType.simpleString())
        if fixed:
            return F.greatest(F.size(column), F.lit(0)).cast("long") * fixed
        parts = F.transform(column, lambda x: _bytes_of(x, kind.elementType))
        return F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda s, n: s + n), F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return _bytes_of(F.map_keys(column), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(column[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    return F.lit(_WIDTHS.get(kind.simpleString(), 16)).cast("long")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``most`` bytes; beyond that the join shuffles both sides."""
    row = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16).cast("long"))
    taken = df.select(row.alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    return F.broadcast(df) if taken <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly Python: only a scan of few or small files is shuffled for that."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(node in plan for node in ("Join", "Aggregate", "Window", "Repartition", "Sort", "Distinct")):
        return df  # shuffled anyway; counting its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions_for(rows: int, row_bytes: int, least: int = 1, each: int = 64 << 20) -> int:
    """Partitions of about ``each`` bytes, so that what one task reads does not grow with the data."""
    return max(least, -(-rows * row_bytes // each))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster that would be a folder of
    one machine, so it fails there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="mneme-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir("file://" + folder)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already; its folder then belongs to the cluster
        pass


#: Intermediate folders of this process: when made, session, path.
_made: list[tuple[float, SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; it is deleted when the driver's process ends, or by :func:`sweep`."""
    path = f"{shared_dir(spark)}/mneme-{os.getpid()}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(sweep, 0)
    _made.append((time.time(), spark, path))
    return f"{path}/{name}"


def sweep(seconds: float = 86_400) -> None:
    """Delete intermediate folders older than ``seconds``: results that still read them must be written by then."""
    before = time.time() - seconds
    for entry in [e for e in _made if e[0] <= before]:
        _delete(*entry[1:])
        _made.remove(entry)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    A later loss of executors recomputes nothing before this point, and a plan that uses the
    result twice computes it once.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
