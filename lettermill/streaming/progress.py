"""Progress and errors of streams: what each batch did, as callbacks while it runs and as a table afterwards."""

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The name under which a watched stream counts.
NAME = "progress"
SCHEMA = "run string, batch long, rows long, errors long, total long, millis long, failure string"


def watched(stream: DataFrame, error: Column | None = None) -> DataFrame:
    """``stream`` with its rows, and those with an ``error``, counted as they pass; no second scan."""
    failed = error.isNotNull() if error is not None else F.lit(False)
    return stream.observe(NAME, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("errors"))


class Progress(StreamingQueryListener):
    """A listener for streams that are ``watched``; ``with Progress(spark) as p`` adds it and takes it off again.

    ``on_progress(rows so far, rows of this batch)`` and ``on_error(run, message)`` are called on the driver, batch by batch. The newest ``keep``
    batches stay for ``table``; longer histories are written by ``on_progress``.
    """

    def __init__(self, spark: SparkSession, on_progress: Callable[[int, int], None] | None = None, on_error: Callable[[str, str], None] | None = None, keep: int = 10_000):
        self.spark, self.on_progress, self.on_error = spark, on_progress, on_error
        self.rows: deque[tuple] = deque(maxlen=keep)
        self.total: dict[str, int] = {}

    def __enter__(self) -> "Progress":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        # Events come on a thread of their own: those that are under way are waited for.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.total.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(NAME)
        if seen is None:
            return
        run = str(p.runId)
        self.total[run] = self.total.get(run, 0) + seen["rows"]
        self.rows.append((run, p.batchId, seen["rows"], seen["errors"], self.total[run], p.batchDuration, None))
        if self.on_progress:
            self.on_progress(self.total[run], seen["rows"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            run = str(event.runId)
            self.rows.append((run, None, None, None, self.total.get(run, 0), None, event.exception.splitlines()[0]))
            if self.on_error:
                self.on_error(run, event.exception)

    def table(self) -> DataFrame:
        """(run, batch, rows, errors, total, millis, failure), one row a batch and one for each run that failed."""
        return self.spark.createDataFrame(list(self.rows), SCHEMA)
