"""Rule sets: many rules in one pass over the events.

All rules become expressions over one projection of their leaves: no join with the rules, one scan whatever
their number, and a leaf that several rules have is computed once an event. Rules are SQL text over the
leaves' names, dealt into arrays of ``CHUNK`` rules, which keeps generated code small enough to compile.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.plans.compile import Compiler, LeafCompiler, Options, RuleWarning
from ruleloom.plans.rule import MAX_RULE_BYTES, Rule, RuleError, rules_frame, rules_from_text
from ruleloom.sources.events import event_schema

CHUNK, MAX_FILES = 25, 10_000


def quoted(text: str | None) -> str:
    """A text as a literal of Spark SQL."""
    if text is None:
        return "cast(null as string)"
    # A dollar sign is escaped as well: Spark replaces ${name} in SQL text.
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


class RuleSet:
    """An immutable set of rules; every change returns a new set."""

    def __init__(self, rules: Iterable[Rule] = (), options: Options = Options(), disabled: frozenset[str] = frozenset(), failed: tuple[tuple[str, str], ...] = ()):
        self.rules, self.options, self.disabled, self.failed = tuple(rules), options, frozenset(disabled), failed
        ids = [r.id for r in self.rules]
        if len(set(ids)) < len(ids):
            warnings.warn("several rules have the same id; all are evaluated", RuleWarning, stacklevel=2)

    @classmethod
    def from_directory(cls, path: str, options: Options = Options(), fail_on_error: bool = False) -> RuleSet:
        """All ``.yml`` files below a folder, at most ``MAX_FILES`` of at most 1 MB each; bad ones are counted."""
        rules, failed, n = [], [], 0
        for folder, dirs, files in os.walk(path):
            dirs.sort()
            for name in sorted(f for f in files if f.endswith(".yml")):
                full = os.path.join(folder, name)
                n += 1
                try:
                    if n > MAX_FILES:
                        raise RuleError(f"more than {MAX_FILES} rule files")
                    if os.path.getsize(full) > MAX_RULE_BYTES:
                        raise RuleError("the file is larger than 1 MB")
                    with open(full, "rb") as f:
                        rules += rules_from_text(f.read(), full)
                except (RuleError, UnicodeDecodeError) as e:
                    if fail_on_error:
                        raise RuleError(f"{full}: {e}") from e
                    failed.append((full, str(e)))
        return cls(rules, options, failed=tuple(failed))

    @classmethod
    def from_spark(cls, spark: SparkSession, path: str, options: Options = Options()) -> RuleSet:
        """The same for a folder in any store that Spark reads."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yml").load(path)
        rules, failed, last = [], [], ""
        for n, row in enumerate(files.select("path", "length").orderBy("path").toLocalIterator(), 1):
            if n > MAX_FILES:
                failed.append((row.path, f"more than {MAX_FILES} rule files"))
            elif row.length > MAX_RULE_BYTES:
                failed.append((row.path, "the file is larger than 1 MB"))
            last = row.path if n <= MAX_FILES else last
        taken = files.where((F.col("length") <= MAX_RULE_BYTES) & (F.col("path") <= F.lit(last)))
        for row in taken.orderBy("path").select("path", "content").collect():
            try:
                rules += rules_from_text(bytes(row.content), row.path)
            except (RuleError, UnicodeDecodeError) as e:
                failed.append((row.path, str(e)))
        return cls(rules, options, failed=tuple(failed))

    def _replace(self, **changes) -> RuleSet:
        return RuleSet(**{"rules": self.rules, "options": self.options, "disabled": self.disabled, "failed": self.failed} | changes)

    def add(self, *rules: Rule) -> RuleSet:
        return self._replace(rules=(*self.rules, *rules))

    def enable(self, rule_id: str) -> RuleSet:
        return self._replace(disabled=self.disabled - {self._known(rule_id)})

    def disable(self, rule_id: str) -> RuleSet:
        return self._replace(disabled=self.disabled | {self._known(rule_id)})

    def _known(self, rule_id: str) -> str:
        if rule_id not in {r.id for r in self.rules}:
            raise KeyError(rule_id)
        return rule_id

    def only(self, ids: Iterable[str] | None = None, logsource: dict | None = None, tags: Iterable[str] | None = None) -> RuleSet:
        """The rules of these ids, of a logsource, or with any of these tags; pruned before anything compiles."""
        ids, tags = None if ids is None else set(ids), None if tags is None else set(tags)
        return self._replace(rules=[r for r in self.rules if (ids is None or r.id in ids) and (logsource is None or r.logsource.matches(**logsource)) and (tags is None or r.has_any_tag(tags))])

    @property
    def enabled(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.id not in self.disabled)

    def metadata(self) -> dict[str, int]:
        return {"total_rules": len(self.rules), "enabled_rules": len(self.enabled), "failed_rules": len(self.failed)}

    def frame(self, spark: SparkSession) -> DataFrame:
        return rules_frame(spark, self.rules, self.disabled)

    # -- evaluation ---------------------------------------------------------------------------------

    def _compiled(self, df: DataFrame) -> tuple[DataFrame, list[tuple[Rule, Column]]]:
        events = event_schema(df)
        compiler = Compiler(events, self.options)
        found = [(r, compiler.rule(r)) for r in self.enabled]
        return events.bind(df), found

    def _leaves(self, df: DataFrame, exact: bool) -> tuple[DataFrame, list[tuple[Rule, str]]]:
        """The events with a column for each leaf, and each rule as SQL text over these."""
        prefix = "__p"
        while any(c.startswith(prefix) for c in df.columns):
            prefix += "_"
        events = event_schema(df)
        compiler = LeafCompiler(events, self.options, prefix)
        found = [(r, compiler.rule(r, exact)) for r in self.enabled]
        return events.bind(df).select(*[F.col(f"`{c}`") for c in df.columns], *compiler.columns), found

    @staticmethod
    def _array(items: list[str], kind: str) -> Column:
        if not items:
            return F.array().cast(f"array<{kind}>")
        chunks = [f"array({', '.join(items[i : i + CHUNK])})" for i in range(0, len(items), CHUNK)]
        return F.expr(f"concat({', '.join(chunks)})" if len(chunks) > 1 else chunks[0])

    def evaluate(self, df: DataFrame, column: str = "results") -> DataFrame:
        """Add every rule's outcome: ``array<struct<rule_id, rule_title, matched, applicable>>``."""
        bound, rules = self._leaves(df, exact=True)
        items = [f"named_struct('rule_id', {quoted(r.id)}, 'rule_title', {quoted(r.title)}, 'matched', coalesce({p}, false), 'applicable', ({p}) IS NOT NULL)" for r, p in rules]
        kind = "struct<rule_id: string, rule_title: string, matched: boolean, applicable: boolean>"
        return bound.select(*[F.col(f"`{c}`") for c in df.columns], self._array(items, kind).alias(column))

    def _hits(self, df: DataFrame, column: str) -> DataFrame:
        """Add the numbers of the rules that match."""
        bound, rules = self._leaves(df, exact=False)
        items = [f"if({p}, {i}, null)" for i, (_, p) in enumerate(rules)]
        return bound.select(*[F.col(f"`{c}`") for c in df.columns], F.array_compact(self._array(items, "int")).alias(column))

    def matches(self, df: DataFrame) -> DataFrame:
        """One row per event and matching rule, with ``rule_id`` and ``rule_title``."""
        hit = self._hits(df, "__rules").select(*[F.col(f"`{c}`") for c in df.columns], F.explode("__rules").alias("__rule"))
        return self._named(hit, "__rule")

    def _named(self, df: DataFrame, number: str) -> DataFrame:
        if not self.enabled:
            return df.withColumn("rule_id", F.lit(None).cast("string")).withColumn("rule_title", F.lit(None).cast("string")).drop(number)
        pick = lambda values: F.get(self._array([quoted(v) for v in values], "string"), F.col(number))
        return df.withColumn("rule_id", pick([r.id for r in self.enabled])).withColumn("rule_title", pick([r.title for r in self.enabled])).drop(number)

    def counts(self, df: DataFrame) -> DataFrame:
        """``rule_id, rule_title, n`` of matching events, for rules that match any: partial counts of all rules, summed up."""
        bound, rules = self._leaves(df, exact=False)
        total = bound.agg(self._array([f"count_if({p})" for _, p in rules], "long").alias("n"))
        hit = total.select(F.posexplode("n").alias("__rule", "n")).where("n > 0")
        return self._named(hit, "__rule").select("rule_id", "rule_title", "n")

    def any_match(self, df: DataFrame) -> DataFrame:
        """The events that any rule matches; one filter, pushed to the scan where all its parts can be."""
        bound, rules = self._compiled(df)
        if not rules:
            return df.limit(0)
        found = rules[0][1]
        for _, p in rules[1:]:
            found = found | p
        return bound.where(found).select(*df.columns)

    def alerts(self, df: DataFrame, ts_column: str | None = None) -> DataFrame:
        """Matches as alert rows: the event's JSON, the rule, and its tags and level."""
        ts = F.col(ts_column) if ts_column else F.current_timestamp()
        event = F.to_json("event") if "event" in df.columns and df.schema["event"].dataType.typeName() == "variant" else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        hit = self._hits(df, "__rules").select(ts.alias("timestamp"), event.alias("event"), F.explode("__rules").alias("__rule"))
        lists = [f"cast(array({', '.join(quoted(t) for t in r.tags)}) as array<string>)" for r in self.enabled]
        tags = F.get(self._array(lists, "array<string>"), F.col("__rule"))
        level = F.get(self._array([quoted(r.level) for r in self.enabled], "string"), F.col("__rule"))
        return self._named(hit.withColumn("tags", tags).withColumn("level", level), "__rule")

    def alerts_json(self, df: DataFrame, ts_column: str | None = None) -> DataFrame:
        """``key`` (the rule id) and ``value`` (JSON of timestamp, event, rule_id and rule_title), as a Kafka sink takes them."""
        rows = self.alerts(df, ts_column)
        return rows.select(F.col("rule_id").alias("key"), F.to_json(F.struct("timestamp", "event", "rule_id", "rule_title")).alias("value"))


def match(df: DataFrame, rule: Rule, options: Options = Options()) -> DataFrame:
    """The events that a rule matches."""
    events = event_schema(df)
    found = Compiler(events, options).rule(rule)
    return events.bind(df).where(found).select(*df.columns)


def outcome(df: DataFrame, rule: Rule, options: Options = Options()) -> DataFrame:
    """All events with ``matched`` and ``applicable`` of one rule."""
    events = event_schema(df)
    found = Compiler(events, options).rule(rule, exact=True)
    return events.bind(df).select(*df.columns, F.coalesce(found, F.lit(False)).alias("matched"), found.isNotNull().alias("applicable"))
