"""Counters of running streams: one row per batch, written by a listener."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from faultline.operators.metrics import stats_columns

STATS = "ingest_stats"
ROW = "query_id string, batch bigint, ingested bigint, parsed bigint, errors bigint"
_NAMES = ("ingested", "parsed", "errors")


def observed(normalized: DataFrame) -> DataFrame:
    """Attach the ingest counters; every batch reports them under ``STATS``."""
    return normalized.observe(STATS, *stats_columns())


class BatchCounters(StreamingQueryListener):
    """Writes the counters of every finished batch of observed queries below ``path``.

    Register it with ``spark.streams.addListener`` before the query starts. A row's place is named by query and
    batch, so a batch that is reported again after a restart replaces its row. Reports come after the batch; ``wait`` until the
    query's end has been reported before the table is read as complete.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self.failure: Exception | None = None

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        counts = progress.observedMetrics.get(STATS)
        if counts is None:
            return
        values = counts.asDict()
        row = (str(progress.id), progress.batchId, *(values[name] for name in _NAMES))
        try:
            table = self._spark.createDataFrame([row], ROW).coalesce(1)
            table.write.mode("overwrite").json(f"{self._path}/{progress.id}-{progress.batchId}")
        except Exception as error:  # a listener cannot raise: the next wait() does
            self.failure = error

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._end_of(str(event.runId)).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Returns when all batches of the ended ``query`` are written; raises if one could not be."""
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError("the end of the query was not reported")
        if self.failure is not None:
            raise self.failure


def batch_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch."""
    return spark.read.schema(ROW).option("recursiveFileLookup", "true").json(path)


def totals(counters: DataFrame) -> DataFrame:
    """Number of batches that had events, and sums of the counters over all batches and restarts."""
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _NAMES]
    return counters.agg(F.count_if(F.col("ingested") > 0).alias("batches"), *sums)
