"""Rules from a folder over events: a batch job from NDJSON files, or a stream from Kafka.

    python -m ruleloom.cli --rules DIR --input PATH [--output PATH] [--dead PATH] [--config FILE.json] [--debug]
    python -m ruleloom.cli --rules DIR --brokers HOST:PORT --topics A,B --alert-topic C --checkpoint PATH [--config FILE.json]

The configuration holds ``spark`` (Spark settings), ``options`` (how rules are read) and ``stream``
(fields of ``StreamConfig``). Lines that aren't JSON fail the batch job, or with ``--mode PERMISSIVE`` go to
``--dead``; in a stream they go to the dead-letter topic.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ruleloom.operators.ruleset import RuleSet
from ruleloom.plans.compile import Options
from ruleloom.sources.events import read_ndjson
from ruleloom.streaming.config import StreamConfig
from ruleloom.streaming.pipeline import detect_topics


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ruleloom", description="Evaluate detection rules over JSON events.")
    parser.add_argument("--rules", required=True, help="folder of .yml rules")
    parser.add_argument("--input", help="NDJSON files, any path that Spark reads")
    parser.add_argument("--brokers", help="Kafka brokers, for a stream")
    parser.add_argument("--topics", help="topics to read, with commas")
    parser.add_argument("--alert-topic", help="topic for alerts")
    parser.add_argument("--checkpoint", help="folder that keeps the stream's offsets")
    parser.add_argument("--once", action="store_true", help="end the stream when it has read what is there now")
    parser.add_argument("--dead", help="folder for lines that aren't JSON")
    parser.add_argument("--output", help="folder for alert NDJSON; without it alerts are printed")
    parser.add_argument("--config", help="JSON file of Spark settings and options")
    parser.add_argument("--mode", default="FAILFAST", choices=["FAILFAST", "PERMISSIVE", "DROPMALFORMED"])
    parser.add_argument("--debug", action="store_true")
    args = parser.parse_args(argv)
    if not args.input and not (args.brokers and args.topics and args.alert_topic and args.checkpoint):
        parser.error("--input, or --brokers, --topics, --alert-topic and --checkpoint")
    config = {}
    if args.config:
        with open(args.config) as f:
            config = json.load(f)
    builder = SparkSession.builder.appName("ruleloom")
    for k, v in config.get("spark", {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.debug else "WARN")
    rules = RuleSet.from_directory(args.rules, Options(**config.get("options", {})))
    if args.debug:
        print(rules.metadata(), rules.failed)
    if not args.input:
        settings = StreamConfig(brokers=args.brokers, topics=tuple(args.topics.split(",")), checkpoint=args.checkpoint, **config.get("stream", {}))
        detect_topics(spark, settings, rules, args.alert_topic, available_now=args.once).awaitTermination()
        return 0
    events = read_ndjson(spark, args.input, args.mode)
    if args.mode == "PERMISSIVE":
        if args.dead:
            events.where("event is null").select("value").write.mode("overwrite").text(args.dead)
        events = events.where("event is not null")
    alerts = rules.alerts_json(events.select("event")).select("value")
    if args.output:
        alerts.write.mode("overwrite").text(args.output)
    else:
        for row in alerts.toLocalIterator():
            print(row.value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
