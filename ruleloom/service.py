"""A façade over one rule set: the calls of a detection service as Python methods.

Single events are for tools and tests; they start a Spark job each. Data sets and streams go through
``evaluate``, ``matches`` and ``streaming.pipeline``.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.ruleset import RuleSet
from ruleloom.streaming.metrics import prometheus_text

MAX_EVENT_BYTES, VERSION = 1 << 20, "0.1.0"


class BadEvent(ValueError):
    """An event text is empty, too large, or no JSON object."""


class Engine:
    def __init__(self, spark: SparkSession, rules: RuleSet):
        self.spark, self.rules, self.started = spark, rules, time.time()
        self.events_processed = self.events_matched = 0

    def health(self) -> dict:
        return {"status": "healthy", "version": VERSION, "rules_loaded": len(self.rules.enabled), "uptime_seconds": int(time.time() - self.started)}

    def metrics(self) -> dict:
        return self.rules.metadata() | {"events_processed": self.events_processed, "events_matched": self.events_matched}

    def prometheus(self) -> str:
        return prometheus_text(self.metrics())

    def rules_df(self, page_size: int | None = None, page_token: str | None = None) -> DataFrame:
        """Rules by id; a page begins after the token, which is the last id of the page before."""
        found = self.rules.frame(self.spark).orderBy("id")
        if page_token:
            found = found.where(F.col("id") > page_token)
        return found.limit(page_size) if page_size else found

    def evaluate(self, df: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
        """Outcomes of all rules, or of some, for every event of a frame."""
        return (self.rules.only(ids=rule_ids) if rule_ids else self.rules).evaluate(df)

    def evaluate_json(self, text: str, rule_ids: list[str] | None = None) -> dict:
        """``matched, rules, total_rules_evaluated, evaluation_time_ms`` for one event."""
        if not text.strip() or len(text.encode()) > MAX_EVENT_BYTES:
            raise BadEvent("an event is a JSON object of at most 1 MB")
        try:
            event = json.loads(text)
        except ValueError as e:
            raise BadEvent(f"not valid JSON: {e}") from e
        if not isinstance(event, dict) or not event:
            raise BadEvent("an event is a JSON object that isn't empty")
        began = time.time()
        frame = self.spark.createDataFrame([(text,)], "value string").select(F.parse_json("value").alias("event"))
        rows = self.evaluate(frame, rule_ids).select("results").first().results
        hits = [{"rule_id": r.rule_id, "rule_title": r.rule_title} for r in rows if r.matched]
        self.events_processed += 1
        self.events_matched += bool(hits)
        return {"matched": bool(hits), "rules": hits, "total_rules_evaluated": len(rows), "evaluation_time_ms": (time.time() - began) * 1000}

    def evaluate_many(self, texts: list[str]) -> list[dict]:
        """One answer per text in order; a text that isn't JSON gets an error and the others go on."""
        frame = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sequence long, value string")
        parsed = frame.select("sequence", F.try_parse_json("value").alias("event"))
        rows = self.evaluate(parsed).orderBy("sequence").collect()
        return [{"sequence": r.sequence, "error": "invalid JSON"} if r.event is None else {"sequence": r.sequence, "rules": [x.rule_id for x in r.results if x.matched]} for r in rows]
