"""Keyed state with timers: cache expiry (A12, A13) and page chains (A4) over streams.

Both are ``transformWithState`` processors: Spark deals rows and state by key, keeps state under the checkpoint folder and
replays a failed micro-batch from it. A key's state is small whatever arrives: instants that event time hasn't
reached yet, or at most ``max_pages`` pages that wait for an earlier one."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plaudit.constants import CACHE_HOURS, MAX_PAGES
from plaudit.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = T.StructType([T.StructField("appid", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("action", T.StringType())])
CHAIN = T.StructType([T.StructField("appid", T.LongType()), T.StructField("pull", T.LongType()), T.StructField("page_no", T.LongType()), T.StructField("json", T.StringType())])


def transitions(pending: list[int], last: int, upto: int, life: int) -> tuple[list[tuple[int, str]], list[int], int, int]:
    """What happens to one app until ``upto``: (instant, HIT or FETCH) in order, instants still ahead, the last refresh (-1: none
    that is still fresh), the next instant to look at (-1: none).

    A refresh makes the app fresh at its instant; ``life`` later it is stale, unless another refresh came by then."""
    out = []
    ahead = sorted(set(pending))
    while True:
        due = ahead[0] if ahead else None
        stale = last + life if last >= 0 else None
        if due is not None and due <= upto and (stale is None or due <= stale):
            out.append((due, "HIT"))
            last = max(last, due)
            ahead.pop(0)
        elif stale is not None and stale <= upto:
            out.append((stale, "FETCH"))
            last = -1
        else:
            break
    nexts = ([ahead[0]] if ahead else []) + ([last + life] if last >= 0 else [])
    return out, ahead, last, min(nexts) if nexts else -1


class RefreshProcessor(StatefulProcessor):
    """One app: instants wait in state until the watermark reaches them, so the order of arrival does not matter."""

    def __init__(self, hours: int):
        self.life = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pending array<bigint>, last bigint")

    def _advance(self, key, pending: list[int], last: int, upto: int) -> pd.DataFrame:
        out, pending, last, following = transitions(pending, last, upto, self.life)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((pending, last))
        if following >= 0:
            self.handle.registerTimer(following)
        return pd.DataFrame({"appid": pd.Series([key[0]] * len(out), dtype="int64"), "at": pd.to_datetime(pd.Series([i for i, _ in out], dtype="int64"), unit="ms"),
                             "action": pd.Series([a for _, a in out], dtype="str")})

    def _held(self) -> tuple[list[int], int]:
        if not self.state.exists():
            return [], -1
        pending, last = self.state.get()
        return [int(x) for x in pending], int(last)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending, last = self._held()
        for frame in rows:
            pending += [int(x) for x in frame["at_ms"]]
        yield self._advance(key, pending, last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, last = self._held()
        yield self._advance(key, pending, last, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def refresh_transitions(refreshes: DataFrame, hours: int = CACHE_HOURS, delay: str = "0 seconds") -> DataFrame:
    """(appid, at, action) of a stream of refreshes (appid, last_updated): HIT when an app becomes fresh or is refreshed, FETCH
    when ``hours`` pass without a row. At any instant the last transition of an app is the action of ``plan_refresh``
    (an app without one is FETCH). Instants are told apart to the millisecond. Rows without an appid only move the clock;
    rows more than ``delay`` behind it are dropped, as by every watermark."""
    stream = refreshes.select(F.col("appid").cast("bigint").alias("appid"), F.col("last_updated").cast("timestamp").alias("at"))
    stream = stream.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    return stream.groupBy("appid").transformWithStateInPandas(RefreshProcessor(hours), TRANSITIONS, "Append", "EventTime").where("appid is not null and appid >= 0")


def page_verdict(page: dict | None) -> tuple[bool, bool]:
    """(the page counts, the chain ends after it), as ``valid_page_prefix`` reads landed pages."""
    page = page or {}
    ok = page.get("success") == 1 and page.get("reviews") is not None
    return ok, not page.get("cursor")


class ChainProcessor(StatefulProcessor):
    """One pull of one app: the number of the next page, the pages that wait for it, and whether the chain has ended."""

    def __init__(self, first: int, max_pages: int):
        self.first, self.max_pages = first, max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "page bigint, ended boolean")
        self.waiting = handle.getMapState("waiting", "page bigint", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, ended = self.next.get() if self.next.exists() else (self.first, False)
        out = []
        for frame in rows:
            for page_no, text in zip(frame["page_no"], frame["json"]):
                # a page that comes again, or lies beyond the budget, changes nothing
                if not ended and following <= page_no < self.first + self.max_pages and not self.waiting.containsKey((int(page_no),)):
                    self.waiting.updateValue((int(page_no),), (text or "",))
        while not ended and self.waiting.containsKey((int(following),)):
            text = self.waiting.getValue((int(following),))[0]
            self.waiting.removeKey((int(following),))
            try:
                page = json.loads(text)
            except ValueError:
                page = None
            fine, last = page_verdict(page if isinstance(page, dict) else None)
            if fine:
                out.append((int(following), text))
            following += 1
            ended = not fine or last or following >= self.first + self.max_pages
        if ended:
            self.waiting.clear()
        self.next.update((int(following), bool(ended)))
        yield pd.DataFrame({"appid": pd.Series([key[0]] * len(out), dtype="int64"), "pull": pd.Series([key[1]] * len(out), dtype="int64"),
                            "page_no": pd.Series([n for n, _ in out], dtype="int64"), "json": pd.Series([t for _, t in out], dtype="str")})

    def close(self) -> None:
        pass


def page_chains(pages: DataFrame, first: int = 0, max_pages: int = MAX_PAGES) -> DataFrame:
    """The landed pages (appid, pull, page_no, json) that a cursor walk would read, each as soon as all pages before it are settled.

    Pages of a pull are numbered from ``first`` without gaps and may arrive in any order, again, or in several files; the
    result is that of ``valid_page_prefix`` on the whole pull. A page whose predecessor never comes is never read."""
    rows = pages.select(F.col("appid").cast("bigint").alias("appid"), F.col("pull").cast("bigint").alias("pull"), F.col("page_no").cast("bigint").alias("page_no"), "json")
    return rows.groupBy("appid", "pull").transformWithStateInPandas(ChainProcessor(first, max_pages), CHAIN, "Append", "None")


def run_to_table(stream: DataFrame, path: str, name: str, available_now: bool = True):
    """Start a stream into Parquet files (each micro-batch once); returns the StreamingQuery. Timed state needs the RocksDB store."""
    spark: SparkSession = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        return writer.start()
    finally:
        spark.conf.set(key, before)  # a started query keeps the setting it was started with
