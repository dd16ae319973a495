"""Progress of running streams, told while they run."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

TICK = "run string, micro_batch bigint, completed bigint, successful bigint, failed bigint"


def with_progress(results: DataFrame, name: str, ok: Column | str = "success") -> DataFrame:
    """The same rows; every micro-batch reports its counts under ``name`` as it passes, without another pass."""
    good = F.coalesce(F.col(ok) if isinstance(ok, str) else ok, F.lit(False))
    return results.observe(name, F.count(F.lit(1)).alias("completed"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))


class LiveProgress(StreamingQueryListener):
    """Gathers the counts of all queries that report under a name; one tick (run, micro_batch, completed, successful, failed) per micro-batch.

    ``on_tick`` is called with each. The last ``keep`` ticks stay in memory.
    """

    def __init__(self, name: str, on_tick: Callable[[dict], None] | None = None, keep: int = 10_000):
        self.name, self.on_tick = name, on_tick
        self.ticks: deque[dict] = deque(maxlen=keep)
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(self.name)
        if counts is None or not counts["completed"]:
            return
        tick = {"run": str(event.progress.runId), "micro_batch": int(event.progress.batchId), **{k: int(counts[k]) for k in ("completed", "successful", "failed")}}
        self.ticks.append(tick)
        if self.on_tick:
            self.on_tick(tick)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, run: str, seconds: float = 60) -> bool:
        """Wait until all ticks of a run have come; they are sent behind its work."""
        with self.changed:
            return self.changed.wait_for(lambda: str(run) in self.ended, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(t.values()) for t in self.ticks], TICK)
