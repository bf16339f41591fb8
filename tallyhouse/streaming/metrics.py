"""Counters of what a run sends and refuses, taken while the rows pass, without a second look at them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.store import create_if_absent, exists

#: Name under which a stream's counters are told to listeners.
SENT = "sent"
_ROWS = "query string, run string, batch long, rows long, produced long, failed long, votes long"


def counters() -> list[Column]:
    """Of decoded messages: well-formed ones, malformed ones, and votes of the well-formed."""
    good = ~F.col("malformed")
    return [F.count_if(good).alias("produced"), F.count_if(F.col("malformed")).alias("failed"), F.coalesce(F.sum(F.when(good, F.size("votes").cast("long"))), F.lit(0)).alias("votes")]


def observed(decoded: DataFrame, by: Observation | str = SENT) -> DataFrame:
    """``decoded``, unchanged, counted as it passes: by an ``Observation`` of a batch, or by name for the listener of a stream."""
    return decoded.observe(by, *counters())


def counts_of(spark: SparkSession, observation: Observation) -> DataFrame:
    """One row of what an observation has counted; the batch must have run."""
    return spark.createDataFrame([observation.get], "produced long, failed long, votes long")


class CounterListener(StreamingQueryListener):
    """Leaves a row for each progress of a query, in a folder of small files that are made once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if (row := (p.observedMetrics or {}).get(SENT)) is not None:
            told = {"query": p.name, "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, **row.asDict()}
            create_if_absent(self.spark, f"{self.folder}/{p.runId}-{p.batchId:012d}.json", json.dumps(told))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def rows(self) -> DataFrame:
        """What has been counted so far: query, run, batch, rows, produced, failed, votes."""
        return self.spark.read.schema(_ROWS).json(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], _ROWS)
