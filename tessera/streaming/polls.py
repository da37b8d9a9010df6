"""The live feed: what each poll of a source has to tell, by a stateful operator with timers, and the same from a table.

A source's commits are told poll by poll, each a fixed span of event time.  The state holds the open polls: how many commits
there were, the commits to be told (no more than LIMIT of them) and the label of the index runs.  A timer at a poll's end tells
it and forgets it.  Commits of the index are told as one run; a poll of more than LIMIT commits is told as one resync.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT = 512
TOLD = "source string, poll long, kind string, commit_id long, summary string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def provider(spark: SparkSession):
    """Within it, streams that start keep their state where several tables and timers can be kept."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class Polls(StatefulProcessor):
    def __init__(self, span_ms: int, limit: int = LIMIT):
        self.span, self.limit = span_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "poll long", "n long, runs long, label string, informative boolean, labelled long")
        self.pending = handle.getMapState("pending", "poll long, commit_id long", "kind string, summary string")

    def _forget(self, poll: int) -> list[tuple]:
        found = sorted((k[1], *v) for k, v in self.pending.iterator() if k[0] == poll)
        for commit_id, *_ in found:
            self.pending.removeKey((poll, commit_id))
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        given["poll"] = given["at_ms"] // self.span
        for poll, part in given.sort_values("commit_id").groupby("poll"):
            poll = int(poll)
            known = self.open.containsKey((poll,))
            n, runs, label, informative, labelled = self.open.getValue((poll,)) if known else (0, 0, None, False, 0)
            for r in part.itertuples():
                n += 1
                if n == self.limit + 1:
                    self._forget(poll)
                if r.kind == "index":
                    runs += 1
                    # the last summary of a whole run, else the first of a single symbol's
                    if r.informative and (not informative or r.commit_id > labelled) or label is None or not informative and r.commit_id < labelled:
                        label, informative, labelled = r.summary, bool(r.informative), int(r.commit_id)
                elif r.kind != "paired" and n <= self.limit:
                    self.pending.updateValue((poll, int(r.commit_id)), (r.kind, r.summary))
            self.open.updateValue((poll,), (n, runs, label, informative, labelled))
            if not known:
                self.handle.registerTimer((poll + 1) * self.span)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        poll = expiredTimerInfo.getExpiryTimeInMs() // self.span - 1
        n, runs, label, _, _ = self.open.getValue((poll,))
        out = [(kind, commit_id, summary) for commit_id, kind, summary in self._forget(poll)]
        if n > self.limit:
            out = [("resync", None, f"more than {self.limit} commits since last poll")]
        elif runs:
            out.append(("index_run", None, f"{label} ({runs} commits)"))
        self.open.removeKey((poll,))
        yield pd.DataFrame([(key[0], poll, *x) for x in out], columns=["source", "poll", "kind", "commit_id", "summary"]).astype({"commit_id": "Int64"})

    def close(self) -> None:
        pass


def told(commits: DataFrame, span_ms: int, limit: int = LIMIT) -> DataFrame:
    """The stream of what polls tell, of a stream of commits (source, commit_id, at, kind, summary, informative)."""
    own = commits.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "0 seconds").withColumn("at_ms", F.unix_millis("at"))
    return own.groupBy("source").transformWithStateInPandas(Polls(span_ms, limit), TOLD, "Append", "EventTime")
