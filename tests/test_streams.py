"""Streams equal the batch result; restarts lose nothing; settings, retries, service and CLI."""

import json

import pytest
from pyspark.sql import functions as F

from ruleloom.cli import main
from ruleloom.operators import aggregate as A
from ruleloom.operators.ruleset import RuleSet
from ruleloom.queries import make_rule
from ruleloom.service import BadEvent, Engine
from ruleloom.streaming.config import ConfigError, RetryPolicy, StreamConfig
from ruleloom.streaming.metrics import Metrics, prometheus_text
from ruleloom.streaming.pipeline import as_messages, detect, detect_topics, drain, evaluate_stream, kafka_sink, running_stream, text_source, unique_stream, windowed_stream, write_batch

RULES = RuleSet([make_rule("errors", "sel", sel={"type": "error"}), make_rule("big", "sel", sel={"n": [5, 6]})])


def test_detection_stream_with_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def run():
        q = detect(text_source(spark, str(tmp_path / "in"), 1), RULES, str(tmp_path / "cp"), lambda df, n: write_batch(df, str(tmp_path / "alerts"), n), lambda df, n: write_batch(df, str(tmp_path / "dead"), n), available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None

    put("a", [json.dumps({"type": "error", "n": i}) for i in range(4)] + ["no json"])
    run()
    put("b", [json.dumps({"type": "ok", "n": i}) for i in range(8)] + ["{"])
    run()
    run()
    alerts = spark.read.parquet(str(tmp_path / "alerts"))
    assert sorted(json.loads(r.value)["rule_title"] for r in alerts.collect()) == ["big", "big", "errors", "errors", "errors", "errors"]
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert sorted(r.v for r in dead.select(F.col("value").cast("string").alias("v")).collect()) == ["no json", "{"]


def test_running_stream_equals_batch(spark, tmp_path):
    rows = [(f"e{i}", f"u{i % 3}", float(i), f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    frame = spark.createDataFrame(rows, "event_id string, user string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    spec = A.Aggregation("sum", ">", 20, "value", "user")
    stream = running_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), spec)
    q = stream.writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_id, r.value_agg, r.triggered) for r in spark.table("running").collect()}
    assert got == {(r.event_id, r.value_agg, r.triggered) for r in A.running(frame, spec).collect()}


def test_sliding_window(spark):
    frame = spark.createDataFrame([(0, 1.0), (5, 2.0), (10, 4.0), (11, float("nan"))], "s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    rows = A.sliding(frame, 5, "v").orderBy("s").collect()
    assert [(r.window_sum, r.window_count) for r in rows] == [(1.0, 1), (3.0, 2), (6.0, 2), (A.HUGE, 2)]


@pytest.mark.parametrize("change", [{"brokers": ""}, {"topics": ()}, {"batch_size": 0}, {"pause_at": 0}, {"dlq_after_retries": 9}, {"options": {"bootstrap.servers": "x"}}])
def test_stream_settings(change):
    good = {"brokers": "b:9092", "topics": ("t",), "checkpoint": "/c"}
    assert StreamConfig(**good).source_options()["subscribe"] == "t"
    with pytest.raises(ConfigError):
        StreamConfig(**(good | change))


def test_retries():
    assert [RetryPolicy(jitter=0).wait(n) for n in (0, 1, 2, 3, 50, 5000)] == [0, 0.1, 0.2, 0.4, 30, 30]
    calls = []

    def fails(times):
        def action():
            calls.append(1)
            if len(calls) <= times:
                raise OSError("no")
            return "done"

        return action

    assert RetryPolicy().run(fails(3), sleep=lambda s: None) == "done"
    calls.clear()
    with pytest.raises(OSError):
        RetryPolicy().run(fails(9), sleep=lambda s: None)
    assert len(calls) == 4


def test_service(spark):
    engine = Engine(spark, RULES)
    answer = engine.evaluate_json('{"type": "error", "n": 6}')
    assert answer["matched"] and [r["rule_title"] for r in answer["rules"]] == ["errors", "big"] and answer["total_rules_evaluated"] == 2
    for bad in ("", "[]", "{}", "x", "1"):
        with pytest.raises(BadEvent):
            engine.evaluate_json(bad)
    many = engine.evaluate_many(['{"type": "error"}', "x", '{"n": 1}'])
    assert [len(m.get("rules", ())) for m in many] == [1, 0, 0] and many[1]["error"] == "invalid JSON"
    assert engine.health()["rules_loaded"] == 2 and engine.metrics()["events_matched"] == 1
    first = engine.rules_df(page_size=1).first().id
    assert engine.rules_df(page_token=first).count() == 1
    assert "detection_total_rules 2" in engine.prometheus()


def test_metrics():
    m = Metrics(consumed=4, processed=3, failed=1)
    m.durations.extend(range(1, 101))
    assert m.snapshot()["success_rate"] == 0.75 and m.percentile(0.5) == 51
    assert 'x_a{l="1"} 2' in prometheus_text({"a": 2}, "x", {"l": "1"})


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.yml").write_text(json.dumps({"title": "t", "id": "00000000-0000-0000-0000-000000000001", "detection": {"sel": {"v|startswith": "x"}, "condition": "sel"}}))
    (tmp_path / "in.json").write_text('{"v": "xy"}\n\n{"v": "z"}\n')
    assert main(["--rules", str(tmp_path / "r"), "--input", str(tmp_path / "in.json"), "--output", str(tmp_path / "out")]) == 0
    assert [json.loads(r.value)["rule_title"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["t"]


def test_kafka_settings():
    config = StreamConfig("b:9092", ("in",), "/c", options={"acks": "all", "fetch.min.bytes": "5", "sasl.mechanism": "PLAIN", "client.id": "x"})
    source, sink = config.source_options(), config.sink_options("alerts")
    assert source["failOnDataLoss"] == "true" and source["maxOffsetsPerTrigger"] == "400" and source["minOffsetsPerTrigger"] == "100"
    assert source["kafka.fetch.min.bytes"] == "5" and "kafka.acks" not in source
    assert sink["topic"] == "alerts" and sink["kafka.acks"] == "all" and "kafka.fetch.min.bytes" not in sink
    assert source["kafka.sasl.mechanism"] == sink["kafka.sasl.mechanism"] == "PLAIN"


def test_topics_to_topics(spark, tmp_path, monkeypatch):
    """The Kafka pipeline with files in the place of the topics, as there is no connector here."""
    from ruleloom.streaming import pipeline

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"type": "error"}\nno json\n')
    sent = []
    monkeypatch.setattr(pipeline, "kafka_source", lambda spark, config: text_source(spark, str(tmp_path / "in")))
    monkeypatch.setattr(pipeline, "kafka_sink", lambda config, topic: lambda df, n: sent.extend((topic, r.key, bytes(r.value) if topic == "dead" else r.value) for r in df.collect()))
    metrics = Metrics()
    q = detect_topics(spark, StreamConfig("b:9092", ("in",), str(tmp_path / "cp"), dlq_topic="dead"), RULES, "alerts", metrics, available_now=True)
    q.awaitTermination(120)
    assert [(t, k) for t, k, _ in sent] == [("alerts", RULES.rules[0].id), ("dead", None)] and sent[1][2] == b"no json"
    assert (metrics.processed, metrics.failed) == (1, 1)
    assert callable(kafka_sink(StreamConfig("b:9092", ("in",), "/c"), "t"))


@pytest.mark.parametrize("dead_after", [2, None])
def test_alerts_that_keep_failing(spark, tmp_path, dead_after):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"type": "error"}\n{"type": "ok"}\n')
    calls, letters = [], []

    def alerts(df, n):
        calls.append(n)
        raise OSError("refused")

    def dead(df, n):
        letters.extend({h["key"]: bytes(h["value"]).decode() for h in r.headers} for r in df.collect())

    q = detect(text_source(spark, str(tmp_path / "in")), RULES, str(tmp_path / "cp"), alerts, dead, RetryPolicy(max_retries=2, initial=0), dead_after, available_now=True)
    if dead_after is None:
        with pytest.raises(Exception, match="refused"):
            q.awaitTermination(120)
        assert len(calls) == 3 and not letters
    else:
        q.awaitTermination(120)
        assert len(calls) == 2 and [x["dlq.error.attempts"] for x in letters] == ["2", "2"] and {x["dlq.error.message"] for x in letters} == {"refused"}


def test_drain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"type": "error"}\n')
    seen = []
    q = detect(text_source(spark, str(tmp_path / "in")), RULES, str(tmp_path / "cp"), lambda df, n: seen.append(df.count()), trigger_seconds=0.1)
    while not seen:
        q.awaitTermination(0.2)
    assert drain(q, 60) and not q.isActive and seen == [1]


def _memory(stream, name, path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_evaluate_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"type": "error", "n": 5}\n{"n": 1}\n{\n')
    _memory(evaluate_stream(text_source(spark, str(tmp_path / "in")), RULES), "outcomes", tmp_path / "cp")
    got = spark.table("outcomes").collect()
    assert sorted((r.matched, len(r.rules), r.error) for r in got if r.error is None) == [(False, 0, None), (True, 2, None)]
    assert [r.error for r in got if r.error] == ["invalid JSON"]
    assert as_messages(spark.createDataFrame([("x",)], "value string"), "t").first().topic == "t"


def test_windows_and_unique_events_on_streams(spark, tmp_path):
    rows = [("a", 1200), ("a", 1200), ("b", 1210), ("c", 1270), ("d", 1700)]
    frame = spark.createDataFrame(rows, "event_id string, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    _memory(unique_stream(source()), "unique_events", tmp_path / "c1")
    assert sorted(r.event_id for r in spark.table("unique_events").collect()) == ["a", "b", "c", "d"]
    _memory(windowed_stream(source(), A.Aggregation("count", ">=", 2, window=60.0)), "windows", tmp_path / "c2", "update")
    assert [(r.value_agg) for r in spark.table("windows").collect()] == [3.0]


def test_aggregations_of_one_large_group(spark):
    import random

    rng = random.Random(8)
    rows = [(i, rng.randint(0, 400), rng.choice([1.0, 2.5, -3.0, None])) for i in range(700)] + [(900, None, 1.0)]
    frame = spark.createDataFrame(rows, "event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for name, f in (("count", len), ("sum", sum), ("avg", lambda x: sum(x) / len(x)), ("min", min), ("max", max)):
        got = {r.event_id: r.value_agg for r in A.running(frame, A.Aggregation(name, ">", 2, None if name == "count" else "value")).collect()}
        values, want = [], {}
        for i, _, v in order:
            values.append(v or 0.0)
            want[i] = f(values)
        assert got == pytest.approx(want), name
    near = {r.event_id: (r.window_sum, r.window_count) for r in A.sliding(frame.where("s is not null"), 30, "value").collect()}
    for i, s, _ in rows[:-1]:
        own = [v or 0.0 for _, t, v in rows[:-1] if s - 30 <= t <= s]
        assert near[i] == (pytest.approx(sum(own)), len(own))
    plan = A.running(frame, A.Aggregation("count", ">", 2))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize(("by", "whole"), [("user", 100_000), (None, 100_000), ("user", 150), ("user", 50)])
def test_running_sums_add_in_order(spark, monkeypatch, by, whole):
    """A sum that meets the threshold passes it or not by the order in which its doubles are added."""
    import random

    rng = random.Random(3)
    rows = [(i, f"u{i % 4 // 2}" if i % 4 else "u2", rng.randint(0, 500), rng.randint(1, 20_000) / 100) for i in range(400)]
    frame = spark.createDataFrame(rows, "event_id long, user string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    monkeypatch.setattr(A, "WHOLE", whole)
    want, sums = {}, {}
    for i, user, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        group = user if by else None
        want[i] = sums[group] = sums.get(group, 0.0) + v
    threshold = want[198]
    got = {r.event_id: (r.value_agg, r.triggered) for r in A.running(frame, A.Aggregation("sum", ">=", threshold, "value", by)).collect()}
    assert {i: v for i, (v, _) in got.items()} == pytest.approx(want, rel=1e-12)
    in_order = [i for i, user, *_ in rows if sum(r[1] == user for r in rows) <= whole] if by else list(want)
    assert [got[i] for i in in_order] == [(want[i], want[i] >= threshold) for i in in_order]
    assert len(in_order) == {100_000: 400, 150: 200, 50: 0}[whole]


@pytest.mark.parametrize("few", [256, 40, 0])
def test_sliding_sums_add_in_order(spark, monkeypatch, few):
    """Where two blocks hold few events, their windows are added up first to last; elsewhere up to rounding."""
    import random

    rng = random.Random(4)
    rows = [(i, f"u{i % 3}", rng.randint(0, 300) if i % 2 else rng.randint(0, 20), rng.randint(1, 20_000) / 100 if i % 9 else None) for i in range(240)]
    rows += [(300, "u0", None, 0.1), (301, "u0", None, 0.2), (302, "u0", None, None), (303, "u3", None, 1.5)]
    frame = spark.createDataFrame(rows, "event_id long, user string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    monkeypatch.setattr(A, "FEW", few)
    windows = {}
    for i, user, s, _ in rows:
        near = [r for r in rows if r[1] == user and (r[2] is None if s is None else r[2] is not None and s - 30 <= r[2] <= s)]
        windows[i] = [r[3] for r in sorted(near, key=lambda r: (r[2] or 0, r[0]))]
    want = {i: 0.0 for i in windows}
    for i, values in windows.items():
        for v in values:
            want[i] += v or 0.0
    got = {r.event_id: (r.value_agg, r.triggered) for r in A.running(frame, A.Aggregation("sum", ">", want[25], "value", "user", 30)).collect()}
    assert {i: v for i, (v, _) in got.items()} == pytest.approx(want, rel=1e-12)
    if few == 256:
        assert got == {i: (v, v > want[25]) for i, v in want.items() if i < 300} | {i: got[i] for i in got if i >= 300}
    others = (("count", len), ("avg", lambda x: sum(v or 0.0 for v in x) / len(x)), ("min", lambda x: min(v or 0.0 for v in x)), ("max", lambda x: max(v or 0.0 for v in x)))
    for name, f in others if few == 40 else ():  # both ways in one table
        got = {r.event_id: r.value_agg for r in A.running(frame, A.Aggregation(name, ">", 2, None if name == "count" else "value", "user", 30)).collect()}
        assert got == pytest.approx({i: f(x) for i, x in windows.items()}), name
    found = {r.event_id: (r.window_sum, r.window_count) for r in A.sliding(frame, 30, "value", by=("user",)).collect()}
    for i, values in windows.items():
        present = [v for v in values if v is not None]
        assert found[i] == ((pytest.approx(sum(present)) if present else None), len(values))


def test_windows_of_many_events_cost_no_more(spark):
    """Frames that slide row by row are read anew for each row: the cost grows with the events in a window."""
    rows = [(i, s, float(v)) for i, (s, v) in enumerate([(0, 1), (0, 2), (9, 4), (10, 8), (11, 16), (20, 32), (21, 64), (None, 128), (None, 256)])]
    frame = spark.createDataFrame(rows, "event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    found = A.sliding(frame, 10, "value")
    assert "specifiedwindowframe(RangeFrame" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.event_id: (r.window_sum, r.window_count, r.window_first and r.window_first.second, r.window_last and r.window_last.second) for r in found.collect()}
    assert got == {0: (3, 2, 0, 0), 1: (3, 2, 0, 0), 2: (7, 3, 0, 9), 3: (15, 4, 0, 10), 4: (28, 3, 9, 11), 5: (56, 3, 10, 20), 6: (112, 3, 11, 21), 7: (384, 2, None, None), 8: (384, 2, None, None)}
    for name, want in (("count", 3), ("sum", 112), ("avg", 112 / 3), ("min", 16), ("max", 64)):
        spec = A.Aggregation(name, ">", 0, None if name == "count" else "value", window=10)
        assert A.running(frame, spec).where("event_id = 6").select("value_agg").first()[0] == pytest.approx(want), name


def test_instants_sessions_and_statistics(spark):
    frame = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 2.0), ("a", 100, 4.0), ("b", 3, 8.0)], "g string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    instants = spark.createDataFrame([("a", 7), ("a", 60), ("b", 3)], "g string, s long").select("g", F.timestamp_seconds("s").alias("ts"))
    got = A.values_at(frame, instants, 5, "v", by=("g",)).select("g", F.unix_seconds("ts").alias("s"), "window_sum").collect()
    assert sorted(map(tuple, got)) == [("a", 7, 2.0), ("a", 60, 0.0), ("b", 3, 8.0)]
    found = A.sessions(frame, A.Aggregation("sum", ">", 0, "v", "g"), 10).select("group", F.unix_seconds("start"), F.unix_seconds("end"), "value_agg").collect()
    assert sorted(map(tuple, found)) == [("g:a", 0, 15, 3.0), ("g:a", 100, 110, 4.0), ("g:b", 3, 13, 8.0)]
    seen_frame, seen = A.statistics(frame, A.Aggregation("count", ">", 1, None, "g"))
    seen_frame.collect()
    assert seen.get == {"total_evaluations": 4, "active_groups": 2}
    with pytest.raises(ValueError, match="group"):
        A.running(frame.withColumnRenamed("g", "group"), A.Aggregation("count", ">", 1))
