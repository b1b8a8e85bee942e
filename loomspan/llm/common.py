"""Helpers the operators share: table reading and staged tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str, DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where it is unset and Spark is one local process (tests), a
    temporary one. A cluster without a shared folder can't stage anything that survives a lost machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomspan-checkpoint-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not _STAGED:
        atexit.register(release)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED.append((spark, path, out))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark's cleaner remove the shuffles of jobs that are done.

    The cleaner acts when the driver collects garbage, which a driver with little to do may put off for long."""
    for entry in [x for x in _STAGED if any(x[2] is f for f in frames)]:
        _STAGED.remove(entry)
        _delete(*entry[:2])
    gc.collect()
    spark._jvm.System.gc()


def release() -> None:
    """Delete the staged tables of this process; results that still read them must be written before."""
    while _STAGED:
        spark, path, _ = _STAGED.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key that holds more than one of so many of all rows is joined by a broadcast: there can't be more such keys than that.
SHARES = 2000


def skewed_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of ``groups`` for each key, which counts the key's rows in ``size``; these counts sum
    up to ``total`` at most. The few frequent keys, at most ``SHARES``, are broadcast, so that no task gets all rows of one."""
    often = F.col(size) * SHARES > total
    heavy, light = F.broadcast(groups.where(often)), groups.where(~often)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on))
