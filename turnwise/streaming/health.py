"""Counters of running streams: sums and high-water marks that the streams themselves observe, batch by batch."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Prefixes that tell how a metric of several batches adds up.
SUM, MOST = "sum_", "most_"


def observed(rows: DataFrame, name: str, counts: dict[str, Column], marks: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` as they are; each batch reports how many have each of ``counts`` (conditions), and the largest of ``marks``."""
    metrics = [F.count_if(c).alias(SUM + n) for n, c in counts.items()] + [F.max(c).alias(MOST + n) for n, c in (marks or {}).items()]
    return rows.observe(name, F.count(F.lit(1)).alias(f"{SUM}rows"), *metrics)


class Health(StreamingQueryListener):
    """What ``observed`` streams have reported so far, without a scan of anything.

    A batch that runs again after a failure reports again under its number and replaces what it reported.
    """

    def __init__(self):
        self.lock, self.batches, self.failed, self.running = threading.Lock(), defaultdict(dict), 0, set()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.running.add(event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self.lock:
            for name, row in progress.observedMetrics.items():
                self.batches[name][str(progress.id), progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.running.discard(event.id)
            self.failed += event.exception is not None

    def counters(self) -> dict[str, dict[str, int | float]]:
        """name → metric → sum over all batches, or the largest of them."""
        with self.lock:
            out: dict[str, dict] = {}
            for name, batches in self.batches.items():
                own = out.setdefault(name, {})
                for row in batches.values():
                    for metric, value in row.items():
                        if value is None:
                            continue
                        kind, key = (SUM, metric[len(SUM) :]) if metric.startswith(SUM) else (MOST, metric[len(MOST) :])
                        own[key] = own.get(key, 0) + value if kind == SUM else max(own.get(key, value), value)
            return out

    def row(self) -> dict[str, int | float]:
        """One flat row: stream and metric, how many streams run, how many have failed, and ``ready``."""
        flat = {f"{name}_{key}": v for name, own in self.counters().items() for key, v in own.items()}
        return flat | {"running": len(self.running), "failed": self.failed, "ready": self.failed == 0}
