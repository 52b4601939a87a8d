"""Settings of a detection stream, checked when they are made, and retries for what a sink may refuse."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

Result = TypeVar("Result")

#: Settings of the Java client, which Spark's Kafka source and sink use, that may be set from outside.
CONSUMER_OPTIONS = ("fetch.min.bytes", "fetch.max.wait.ms", "fetch.max.bytes", "max.partition.fetch.bytes", "max.poll.records", "isolation.level")
PRODUCER_OPTIONS = ("acks", "batch.size", "buffer.memory", "compression.type", "delivery.timeout.ms", "enable.idempotence", "linger.ms", "max.request.size")
COMMON_OPTIONS = ("client.id", "client.rack", "connections.max.idle.ms", "metadata.max.age.ms", "receive.buffer.bytes", "reconnect.backoff.max.ms", "reconnect.backoff.ms", "request.timeout.ms", "retry.backoff.ms", "send.buffer.bytes")
SECURITY_PREFIXES = ("security.", "sasl.", "ssl.")


class ConfigError(ValueError):
    """A setting is missing or out of range."""


@dataclass(frozen=True)
class RetryPolicy:
    """Waits of ``initial * multiplier^(n-1)`` seconds, capped, with up to ``jitter`` of that on top."""

    max_retries: int = 3
    initial: float = 0.1
    cap: float = 30.0
    multiplier: float = 2.0
    jitter: float = 0.1
    exponential: bool = True

    def __post_init__(self):
        if self.max_retries < 0 or self.initial < 0 or self.cap < self.initial or self.multiplier < 1 or not 0 <= self.jitter <= 1:
            raise ConfigError("a retry setting is out of range")

    def wait(self, attempt: int, random_: Callable[[], float] = random.random) -> float:
        """Seconds before the n-th retry."""
        if attempt <= 0:
            return 0.0
        try:
            base = self.initial * (self.multiplier ** (attempt - 1) if self.exponential else 1.0)
        except OverflowError:
            base = self.cap
        base = min(base, self.cap)
        return base + base * self.jitter * random_()

    def run(self, action: Callable[[], Result], retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Result:
        """Call ``action`` until it succeeds, isn't retryable or the retries are used up."""
        attempt = 0
        while True:
            try:
                return action()
            except Exception as e:
                attempt += 1
                if attempt > self.max_retries or not retryable(e):
                    raise
                sleep(self.wait(attempt))


@dataclass(frozen=True)
class StreamConfig:
    """A Kafka consumer as Structured Streaming takes it: group and offsets live in the checkpoint.

    A batch has at least ``batch_size`` messages or comes after ``trigger_seconds``, and at most the share
    ``pause_at`` of ``max_inflight``; that is all the back-pressure there is to set. ``dlq_topic`` gets malformed
    messages, and those whose alerts failed ``dlq_after_retries`` times.
    """

    brokers: str
    topics: tuple[str, ...]
    checkpoint: str
    group_id: str = "detection"
    starting_offsets: str = "latest"
    fail_on_data_loss: bool = True
    batch_size: int = 100
    max_inflight: int = 500
    pause_at: float = 0.8
    trigger_seconds: float = 1.0
    dlq_topic: str | None = None
    dlq_after_retries: int = 3
    retry: RetryPolicy = RetryPolicy()
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        checks = {
            "brokers": bool(self.brokers.strip()),
            "topics": bool(self.topics) and all(t.strip() for t in self.topics),
            "checkpoint": bool(self.checkpoint),
            "group_id": bool(self.group_id.strip()),
            "batch_size": self.batch_size > 0,
            "max_inflight": self.max_inflight >= self.batch_size,
            "pause_at": 0 < self.pause_at <= 1,
            "trigger_seconds": self.trigger_seconds >= 0,
            "dlq_after_retries": 0 <= self.dlq_after_retries <= self.retry.max_retries,
            "options": all(k in (*CONSUMER_OPTIONS, *PRODUCER_OPTIONS, *COMMON_OPTIONS) or k.startswith(SECURITY_PREFIXES) for k in self.options),
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ConfigError(f"out of range or not allowed: {', '.join(bad)}")

    def source_options(self) -> dict[str, str]:
        """Options for ``readStream.format("kafka")``."""
        own = {
            "kafka.bootstrap.servers": self.brokers,
            "subscribe": ",".join(self.topics),
            "kafka.group.id": self.group_id,
            "startingOffsets": self.starting_offsets,
            "minOffsetsPerTrigger": str(self.batch_size),
            "maxTriggerDelay": f"{max(1, int(self.trigger_seconds * 1000))}ms",
            "maxOffsetsPerTrigger": str(max(self.batch_size, int(self.max_inflight * self.pause_at))),
            "includeHeaders": "true",
            "failOnDataLoss": str(self.fail_on_data_loss).lower(),
        }
        return own | self._client(CONSUMER_OPTIONS)

    def sink_options(self, topic: str) -> dict[str, str]:
        """Options for ``write.format("kafka")``."""
        return {"kafka.bootstrap.servers": self.brokers, "topic": topic, "includeHeaders": "true"} | self._client(PRODUCER_OPTIONS)

    def _client(self, own: tuple[str, ...]) -> dict[str, str]:
        return {f"kafka.{k}": v for k, v in self.options.items() if k in (*own, *COMMON_OPTIONS) or k.startswith(SECURITY_PREFIXES)}
