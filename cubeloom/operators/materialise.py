"""Tables in the shared folder that cut a lineage and survive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that this driver made and that lazy results may still read.
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the folder that ``setCheckpointDir`` named.

    Only a session on one machine may do without: it has ``/tmp/checkpoints``.
    Elsewhere no folder of one machine would do, and ``RuntimeError`` is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = spark._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """The name of a fresh folder that the driver and every executor can reach; :func:`clean` removes it."""
    path = f"{shared_base(spark)}/cubeloom/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def clean(spark: SparkSession) -> None:
    """Delete all folders that this driver made; lazy results that read them are void.  Runs when the driver ends."""
    for path in list(_made):
        remove_dir(spark, path)


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark._jsc is not None and not spark._jsc.sc().isStopped():
        clean(spark)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a shared folder and read again, and the folder."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` and the place of each row in an order, from 0, without bringing all rows to one task.

    Rows are sorted in ranges and written, as their numbers must not change;
    only the sizes of the ranges are summed up in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"range": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(sizes, "range").withColumn(name, F.col("base") + F.col("at")).drop("range", "at", "base")
