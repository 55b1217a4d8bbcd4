"""Scans of catalogues: fixed selections once, rolling windows again and again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Selector:
    """What to scan: mode ``once`` with fixed dates, or ``schedule`` with the last days before each run."""

    name: str
    request: dict[str, list]
    mode: str = "once"
    from_date: str | None = None
    to_date: str | None = None
    last_n_days: int | None = None
    interval_hours: float = 24.0

    def dates(self, today: dt.date) -> tuple[str, str]:
        if self.mode == "once":
            if not (self.from_date and self.to_date):
                raise ValueError(f"selector {self.name} needs from_date and to_date")
            return self.from_date, self.to_date
        if self.last_n_days is None:
            raise ValueError(f"selector {self.name} needs last_n_days")
        return (today - dt.timedelta(days=self.last_n_days)).strftime("%Y%m%d"), today.strftime("%Y%m%d")

    def due(self, last: dt.datetime | None, now: dt.datetime) -> bool:
        """Whether it is time to scan again; one that never ran is due."""
        return last is None or now - last >= dt.timedelta(hours=self.interval_hours)


def rows_of(source: DataFrame, selector: Selector, today: dt.date, date: str = "date") -> DataFrame:
    """Rows that a selector asks for; all tests reach the scan."""
    first, last = selector.dates(today)
    out = source.where(F.col(date).cast("string").between(first, last))
    for d, vs in selector.request.items():
        out = out.where(F.col(d).isin(list(vs)))
    return out


def run_once(source: DataFrame, selectors: list[Selector], dims: list[str], out: str, today: dt.date) -> None:
    """Write the identifiers of every fixed selector below ``out``."""
    for s in selectors:
        if s.mode == "once":
            rows_of(source, s, today).select(*dims).distinct().write.mode("overwrite").parquet(f"{out}/{s.name}")


def follow(
    spark: SparkSession, folder: str, schema: str, dims: list[str], out: str, checkpoint: str,
    event_time: str | None = None, delay: str = "1 day", once: bool = True, interval: str = "60 seconds",
    sink: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Follow a folder of Parquet files and append new identifiers to ``out``.

    With an event time the state of seen identifiers is bounded by the
    watermark; a later repetition is then appended again, and a reader's
    ``distinct`` (a set's own union) takes it out.  Without one no state is
    kept: what ``out`` has already is left out of a batch by a join, which also
    makes a repeated batch harmless.  ``sink`` gets every micro-batch, distinct
    in itself, instead of the table.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def append(batch: DataFrame, _: int) -> None:
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path):
            known = batch.sparkSession.read.schema(batch.schema).parquet(out).toDF(*[f"known {d}" for d in dims])
            same = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"known {d}")) for d in dims])
            batch = batch.join(known, same, "left_anti")
        batch.write.mode("append").parquet(out)

    write = sink or append
    if event_time:
        fresh, each = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(dims), write
    else:
        fresh, each = stream, lambda batch, k: write(batch.distinct(), k)
    writer = fresh.select(*dims).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    if sink is None and event_time:
        return writer.format("parquet").option("path", out).start()
    return writer.foreachBatch(each).start()
