"""Tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_root: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests)
    and an error on a cluster, whose machines do not share such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="inkfathom-"))
    return _own_root[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below this application's own; removed when the driver ends."""
    path = f"{shared_root(spark)}/inkfathom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` made, once all that was computed from them has been written itself."""
    for t in tables:
        fs, p = file_system(t.sparkSession, t._scratch_path)
        fs.delete(p, True)


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Removes the scratch folders of other applications, untouched for so many hours (their drivers were killed); how many."""
    fs, top = file_system(spark, f"{shared_root(spark)}/inkfathom")
    gone = 0
    for f in fs.listStatus(top) if fs.exists(top) else []:
        if f.getPath().getName() != spark.sparkContext.applicationId and f.getModificationTime() < (time.time() - hours * 3600) * 1000:
            gone += fs.delete(f.getPath(), True)
    return gone


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@atexit.register
def _remove() -> None:
    for spark, folder in {path.rpartition("/")[0]: (spark, path.rpartition("/")[0]) for spark, path in _made}.values():
        try:
            fs, p = file_system(spark, folder)
            fs.delete(p, True)
        except Exception:  # the session has ended: the folder goes with the cluster's scratch space, or by sweep
            return


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder; `dropped` removes it before the driver ends."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (new name, column) in sums, the sum over all rows before this one in `order`.

    The order is cut into ranges; each range is summed by itself and shifted by the totals of those before it
    (one row a range), so no task sees all rows.
    """
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums])
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{n}") for n, c in sums.items()]).join(F.broadcast(shifts), "_range")
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])
