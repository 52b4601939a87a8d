"""Detection on streams: parse, route what is malformed, evaluate, write.

Spark's checkpoint holds the offsets, so a restart goes on where the last finished batch ended; file and
table sinks are written under the batch's number and a repeated batch replaces what it wrote before. Text
that isn't JSON goes to the dead letters at once, without retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ruleloom.operators.aggregate import Aggregation, compare, group_text, number_or_zero
from ruleloom.operators.ruleset import RuleSet
from ruleloom.sources.events import parse_events
from ruleloom.streaming.config import RetryPolicy, StreamConfig
from ruleloom.streaming.metrics import Metrics

MESSAGE = ("key", "value", "topic", "partition", "offset", "timestamp", "headers")


def kafka_source(spark: SparkSession, config: StreamConfig) -> DataFrame:
    """Messages with their topic, partition, offset and headers."""
    return spark.readStream.format("kafka").options(**config.source_options()).load().select(*MESSAGE)


def text_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of files that appear in a folder, in the shape of messages."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_messages(reader.load(path), path)


def as_messages(lines: DataFrame, topic: str) -> DataFrame:
    return lines.select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.lit(-1).cast("long").alias("offset"),
        F.current_timestamp().alias("timestamp"),
        F.array().cast("array<struct<key: string, value: binary>>").alias("headers"),
    )


def split(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that are JSON, as a VARIANT ``event``, and those that aren't."""
    parsed = messages.withColumn("__text", F.col("value").cast("string")).withColumn("event", F.try_parse_json("__text"))
    return parsed.where(F.col("event").isNotNull()).drop("__text"), parsed.where(F.col("event").isNull()).drop("__text", "event")


def _header(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").cast("binary").alias("value"))


def dead_letters(messages: DataFrame, error: str | Column = "not valid JSON", attempts: int | Column = 0) -> DataFrame:
    """``key, value, headers`` for a dead-letter topic: the message as it was, its origin and the error as headers."""
    error, attempts = (x if isinstance(x, Column) else F.lit(x) for x in (error, attempts))
    own = F.array(
        _header("dlq.original.topic", F.col("topic")),
        _header("dlq.original.partition", F.col("partition")),
        _header("dlq.original.offset", F.col("offset")),
        _header("dlq.error.message", error),
        _header("dlq.error.attempts", attempts),
        _header("dlq.timestamp", F.unix_millis(F.current_timestamp())),
    )
    before = F.transform(
        F.coalesce("headers", F.array().cast("array<struct<key: string, value: binary>>")),
        lambda h: F.struct(F.concat(F.lit("dlq.original.header."), h["key"]).alias("key"), h["value"].alias("value")),
    )
    return messages.select("key", "value", F.concat(own, before).alias("headers"))


def dead_letters_json(messages: DataFrame, error: str = "not valid JSON", attempts: int = 0, metadata: dict[str, str] | None = None) -> DataFrame:
    """``key, value`` where the value is a JSON report of the error with the original payload as text."""
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]
    report = F.struct(
        F.lit(error).alias("error"),
        F.lit(attempts).alias("attempts"),
        F.current_timestamp().alias("timestamp"),
        F.struct("topic", "partition", "offset", "timestamp").alias("original"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string, string>")).alias("metadata"),
        F.col("value").cast("string").alias("original_payload"),
    )
    return messages.select("key", F.to_json(report).alias("value"))


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch under its number; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def kafka_sink(config: StreamConfig, topic: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for rows of ``key``, ``value`` and perhaps ``headers``; alerts have the rule's id as their key."""

    def write(df: DataFrame, number: int) -> None:
        columns = [c for c in ("key", "value", "headers") if c in df.columns]
        df.select(*columns).write.format("kafka").options(**config.sink_options(topic)).save()

    return write


def detect_topics(spark: SparkSession, config: StreamConfig, rules: RuleSet | Callable[[], RuleSet], alert_topic: str, metrics: Metrics | None = None, available_now: bool = False) -> StreamingQuery:
    """Detection from topics to topics: alerts, and dead letters where the settings name a topic for them."""
    dead = kafka_sink(config, config.dlq_topic) if config.dlq_topic else None
    return detect(
        kafka_source(spark, config), rules, config.checkpoint, kafka_sink(config, alert_topic), dead,
        retry=config.retry, dead_after=config.dlq_after_retries, metrics=metrics, available_now=available_now, trigger_seconds=config.trigger_seconds, name=config.group_id,
    )


def detect(
    messages: DataFrame,
    rules: RuleSet | Callable[[], RuleSet],
    checkpoint: str,
    alerts: Callable[[DataFrame, int], None],
    dead: Callable[[DataFrame, int], None] | None = None,
    retry: RetryPolicy = RetryPolicy(),
    dead_after: int | None = None,
    metrics: Metrics | None = None,
    available_now: bool = False,
    trigger_seconds: float = 1.0,
    name: str | None = None,
) -> StreamingQuery:
    """Start a detection stream. ``rules`` may be a function, which is asked once a batch for the current set.

    ``alerts`` gets rows of ``key`` (rule id) and ``value`` (alert JSON), ``dead`` dead letters. Where ``alerts``
    keeps failing, the batch's messages become dead letters after ``dead_after`` attempts; without that
    setting, or if the last retry comes first, the stream ends with the error.
    """

    def batch(df: DataFrame, number: int) -> None:
        now = rules() if callable(rules) else rules
        df = df.persist()  # the source is read once for alerts, dead letters and retries
        try:
            good, bad = split(df)
            attempts = 0

            def send() -> None:
                nonlocal attempts
                attempts += 1
                alerts(now.alerts_json(good, "timestamp"), number)

            given_up = lambda: dead is not None and dead_after is not None and attempts >= dead_after
            failed = False
            try:
                retry.run(send, retryable=lambda e: not given_up())
            except Exception as e:
                if not given_up():
                    raise
                failed = True
                letters = dead_letters(good, str(e), attempts)
                retry.run(lambda: dead(letters.union(dead_letters(bad)), number))
            else:
                if dead is not None:
                    retry.run(lambda: dead(dead_letters(bad), number))
            if metrics is not None:
                n_bad, n = bad.count(), df.count()
                metrics.processed += 0 if failed else n - n_bad
                metrics.failed += n if failed else n_bad
        finally:
            df.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{trigger_seconds} seconds")).start()


def drain(query: StreamingQuery, seconds: float = 30.0) -> bool:
    """Stop a stream between two batches: wait until the batch at hand has ended, then stop; false if time runs out first."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    idle = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return idle


def evaluate_stream(messages: DataFrame, rules: RuleSet, sequence: str | None = None) -> DataFrame:
    """Outcomes as a stream: ``sequence, matched, rules, error``, one row per message, malformed ones too."""
    number = F.col(sequence) if sequence else F.col("offset")
    parsed = messages.select(number.alias("sequence"), F.try_parse_json(F.col("value").cast("string")).alias("event"))
    found = rules.evaluate(parsed)
    names = F.transform(F.filter("results", lambda r: r["matched"]), lambda r: r["rule_id"])
    return found.select("sequence", (F.size(names) > 0).alias("matched"), names.alias("rules"), F.when(F.col("event").isNull(), "invalid JSON").alias("error"))


def running_stream(df: DataFrame, spec: Aggregation, ts: str = "ts", id_: str = "event_id", ttl_seconds: int = 3600) -> DataFrame:
    """Running aggregation on a stream: ``group, event_id, ts, value_agg, triggered`` for every event.

    State per group is five numbers and ends ``ttl_seconds`` after the group began. Events of one batch are taken
    in order of (time, id).
    """
    schema = "group string, event_id string, ts timestamp, value_agg double, triggered boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        if state.exists:
            n, total, low, high, began = state.get
        else:
            n, total, low, high, began = 0, 0.0, float("inf"), float("-inf"), state.getCurrentProcessingTimeMs()
        x = rows["x"].astype(float)
        count = n + pd.Series(range(1, len(x) + 1), index=x.index, dtype=float)
        sums = total + x.cumsum()
        lows, highs = x.cummin().clip(upper=low).ffill(), x.cummax().clip(lower=high).ffill()
        value = {"count": count, "sum": sums, "avg": sums / count, "min": lows, "max": highs}[spec.function]
        hit = {">": value > spec.threshold, ">=": value >= spec.threshold, "<": value < spec.threshold, "<=": value <= spec.threshold, "==": (value - spec.threshold).abs() < 2.3e-16, "!=": (value - spec.threshold).abs() >= 2.3e-16}[spec.comparison]
        state.update((int(count.iloc[-1]), float(sums.iloc[-1]), float(lows.iloc[-1]), float(highs.iloc[-1]), int(began)))
        left = began + ttl_seconds * 1000 - state.getCurrentProcessingTimeMs()
        state.setTimeoutDuration(max(1, int(left)))
        yield pd.DataFrame({"group": key[0], "event_id": rows["event_id"].astype(str), "ts": rows["ts"], "value_agg": value, "triggered": hit})

    narrow = df.select(group_text(df, spec.by_field).alias("group"), F.col(id_).cast("string").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"), number_or_zero(df, spec.field).alias("x"))
    return narrow.groupBy("group").applyInPandasWithState(step, schema, "n long, total double, low double, high double, began long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_stream(df: DataFrame, spec: Aggregation, ts: str = "ts", late_seconds: float = 60.0) -> DataFrame:
    """Groups that pass the threshold per tumbling window, with a watermark for late events."""
    from ruleloom.operators.aggregate import tumbling

    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{late_seconds} seconds")
    return tumbling(timed, spec, ts)


def unique_stream(df: DataFrame, id_: str = "event_id", ts: str = "ts", late_seconds: float = 60.0) -> DataFrame:
    """Drop events whose id occurred before, within the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{late_seconds} seconds").dropDuplicatesWithinWatermark([id_])


__all__ = ["as_messages", "compare", "dead_letters", "dead_letters_json", "detect", "detect_topics", "drain", "evaluate_stream", "kafka_sink", "kafka_source", "parse_events", "running_stream", "split", "text_source", "unique_stream", "windowed_stream", "write_batch"]
