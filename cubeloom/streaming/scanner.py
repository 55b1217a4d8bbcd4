"""Scans by configuration: every selector gives one node-array document, which a sink stores.

Configuration is a mapping (or its JSON) with ``selectors``, each with a
``name``, a ``selector`` such as ``class=od,expver=1/2``, a ``mode`` (``once`` with
``from_date`` and ``to_date``, or ``schedule`` with ``last_n_days`` and
``interval_hours``), and beside them ``location`` and ``stagger_minutes``.
Identifiers get the location as provenance.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cubeloom.plans.cubeset import CubeSet
from cubeloom.streaming.ingest import Selector, rows_of

log = logging.getLogger(__name__)

#: Stores a document under a name.
Sink = Callable[[str, str], Any]


@dataclass(frozen=True)
class Config:
    selectors: list[Selector]
    location: str = ""
    stagger_minutes: float = 0.0

    @classmethod
    def parse(cls, given: str | dict) -> Config:
        doc = json.loads(given) if isinstance(given, str) else given
        if not doc.get("selectors"):
            raise ValueError("a scan needs selectors")
        own = []
        for s in doc["selectors"]:
            request = {d.strip(): vs.split("/") for d, _, vs in (p.partition("=") for p in s.get("selector", "").split(",") if p.strip())}
            if s.get("mode") not in ("once", "schedule"):
                raise ValueError(f"selector {s['name']} has no mode once or schedule")
            dates = {k: s[k] for k in ("from_date", "to_date") if k in s}
            own.append(Selector(s["name"], request, s["mode"], last_n_days=s.get("last_n_days", 10), interval_hours=float(s.get("interval_hours", 24)), **dates))
        if len({s.name for s in own}) < len(own):
            raise ValueError("selectors need names of their own")
        return cls(own, doc.get("location", ""), float(doc.get("stagger_minutes", 0)))


def document(source: DataFrame, selector: Selector, dims: list[str], today: dt.date, location: str = "") -> str | None:
    """The node-array document of what a selector asks for; None if that is nothing."""
    found = CubeSet(rows_of(source, selector, today).select(*dims).distinct(), dims)
    if found.is_empty():
        return None
    return json.dumps((found.set_metadata({}, "location", [location]) if location else found).to_arena_json())


def scan(source: DataFrame, selector: Selector, dims: list[str], sink: Sink, today: dt.date, location: str = "") -> bool:
    """Scan one selector; whether there was anything to store."""
    doc = document(source, selector, dims, today, location)
    if doc is None:
        log.warning("%s: nothing found, nothing stored", selector.name)
        return False
    sink(f"{location}_{selector.name}.json" if location else f"{selector.name}.json", doc)
    return True


def run(
    spark: SparkSession, source: DataFrame, config: Config, dims: list[str], sink: Sink, now: Callable[[], dt.datetime] = dt.datetime.now,
    rounds: int | None = None, wait: Callable[[float], Any] = time.sleep, every: float = 60.0,
) -> dict[str, list[dt.datetime]]:
    """Scan fixed selectors at once, side by side, then scheduled ones whenever they are due, for ``rounds`` looks or forever.

    Returns when each selector was scanned.  A scan that fails is logged and
    comes again when it is due; the others go on.
    """
    ran: dict[str, list[dt.datetime]] = {s.name: [] for s in config.selectors}

    def guarded(s: Selector) -> None:
        try:
            scan(source, s, dims, sink, now().date(), config.location)
        except Exception:
            log.exception("%s failed", s.name)
        ran[s.name].append(now())

    fixed = [s for s in config.selectors if s.mode == "once"]
    if fixed:
        with ThreadPoolExecutor(len(fixed)) as pool:
            list(pool.map(guarded, fixed))
    rolling = [s for s in config.selectors if s.mode == "schedule"]
    began = now()
    look = 0
    while rolling and (rounds is None or look < rounds):
        if look:
            wait(every)
        for k, s in enumerate(rolling):
            last = ran[s.name][-1] if ran[s.name] else None
            if now() - began >= dt.timedelta(minutes=k * config.stagger_minutes) and s.due(last, now()):
                guarded(s)
        look += 1
    return ran


def to_folder(spark: SparkSession, folder: str) -> Sink:
    """A sink that writes documents to a folder of any file system that Spark knows."""

    def put(name: str, doc: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(doc.encode()))
        finally:
            out.close()

    return put


def to_store(url: str, key: str = "", timeout: float = 120.0) -> Sink:
    """A sink that puts documents to ``url/files/<name>`` by HTTP; an answer that is no success raises."""

    def put(name: str, doc: str) -> None:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{url.rstrip('/')}/files/{name}", doc.encode(), head, method="PUT")
        urllib.request.urlopen(request, timeout=timeout).close()

    return put
