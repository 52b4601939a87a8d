"""Counters of a stream from Spark's progress reports, and their text for a Prometheus scraper."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Metrics:
    """Totals, and the durations of the last 1000 batches.

    ``detect`` counts what was processed and what failed (malformed messages, and those given up), the
    listener what was consumed and how long it took.
    """

    consumed: int = 0
    processed: int = 0
    failed: int = 0
    batches: int = 0
    ended_by_error: int = 0
    lag: dict[str, int] = field(default_factory=dict)
    durations: deque = field(default_factory=lambda: deque(maxlen=1000))

    def percentile(self, q: float) -> float:
        values = sorted(self.durations)
        return float(values[min(len(values) - 1, int(q * len(values)))]) if values else 0.0

    def snapshot(self) -> dict[str, float]:
        mean = sum(self.durations) / len(self.durations) if self.durations else 0.0
        done = self.processed + self.failed
        return {
            "messages_consumed": self.consumed,
            "messages_processed": self.processed,
            "messages_failed": self.failed,
            "batches": self.batches,
            "queries_ended_by_error": self.ended_by_error,
            "success_rate": self.processed / done if done else 1.0,
            "batch_ms_mean": mean,
            "batch_ms_p50": self.percentile(0.5),
            "batch_ms_p95": self.percentile(0.95),
            "batch_ms_p99": self.percentile(0.99),
        }


class ProgressListener(StreamingQueryListener):
    """Feeds ``Metrics``; register it with ``spark.streams.addListener``."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.metrics.batches += 1
        self.metrics.consumed += p.numInputRows
        self.metrics.durations.append(p.batchDuration)
        for source in p.sources:
            for k, v in (source.metrics or {}).items():
                if k.endswith("OffsetsBehindLatest"):
                    self.metrics.lag[k] = int(float(v))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.metrics.ended_by_error += bool(event.exception)


def prometheus_text(values: dict[str, float], prefix: str = "detection", labels: dict[str, str] | None = None) -> str:
    """One gauge or counter per value in the text exposition format."""
    mark = "{" + ",".join(f'{k}="{v}"' for k, v in sorted(labels.items())) + "}" if labels else ""
    out = []
    for name, value in values.items():
        kind = "counter" if name.startswith(("messages_", "batches", "events_")) else "gauge"
        out += [f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name}{mark} {value:g}"]
    return "\n".join(out) + "\n"
