"""Threshold aggregations over matched events: running, sliding and per group.

A running aggregation reports, for every event, the value of its group so far and whether it passes the
threshold. With a window it covers the last seconds only. The order is (time, id), which makes ties definite.

Doubles are added in that order, one after the other: whether a sum that meets the threshold passes it depends on
the order. No group of over ``WHOLE`` events is sorted in one task: its events are dealt into slices of time, each
slice is aggregated on its own, and the sum of the slices before it, a small table, is added to its running
values, whose last digits may then differ. With a window, each window is added up on its own where events are few
(see ``_few_within``); elsewhere blocks of its length get running values forwards and backwards, of which each
window is made up (see ``_within``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ruleloom.operators.ruleset import match
from ruleloom.plans.compile import Options
from ruleloom.plans.condition import split_aggregation
from ruleloom.plans.rule import Rule, RuleError

EPSILON, HUGE = 2.220446049250313e-16, 1.7976931348623157e308
FUNCTIONS = ("count", "sum", "avg", "min", "max")
COMPARISONS = (">=", "<=", "==", "!=", ">", "<")
SLICES = 64
WHOLE = 100_000  # events of a group that one task adds up in order
FEW = 256  # events of two blocks up to which each window is added up in order


@dataclass(frozen=True)
class Aggregation:
    """``function(field) by by_field comparison threshold``, over all time or the last ``window`` seconds."""

    function: str
    comparison: str
    threshold: float
    field: str | None = None
    by_field: str | None = None
    window: float | None = None

    def __post_init__(self):
        if self.function not in FUNCTIONS or self.comparison not in COMPARISONS:
            raise RuleError(f"unknown function or comparison: {self.function} {self.comparison}")
        if self.function != "count" and not self.field:
            raise RuleError(f"{self.function} needs a field")
        if self.window is not None and self.window <= 0:
            raise RuleError("a window is longer than nothing")


def compare(value: Column, comparison: str, threshold: float) -> Column:
    """Threshold comparison; equality allows for rounding."""
    near = F.abs(value - F.lit(threshold)) < EPSILON
    return {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold, "==": near, "!=": ~near}[comparison]


def _kind(df: DataFrame, path: str) -> T.DataType | None:
    kind = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def number_or_zero(df: DataFrame, path: str | None) -> Column:
    """A field as a double; what is missing or no number counts as 0, texts too."""
    kind = _kind(df, path) if path else None
    if isinstance(kind, T.NumericType):
        return F.coalesce(_column(path).cast("double"), F.lit(0.0))
    if isinstance(kind, T.VariantType):
        v = _column(path)
        numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(numeric, F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0))).otherwise(0.0)
    return F.lit(0.0)


def group_text(df: DataFrame, path: str | None) -> Column:
    """``field:value``; ``field:unknown`` where there is no plain value, ``default`` without a field."""
    if not path:
        return F.lit("default")
    kind = _kind(df, path)
    if kind is None or isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.lit(f"{path}:unknown")
    c = _column(path)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        text = F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))
    elif isinstance(kind, T.VariantType):
        text = F.when(F.schema_of_variant(c).rlike("^(STRING|BIGINT|BOOLEAN|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(c, "$", "string"))
    else:
        text = c.cast("string")
    return F.concat(F.lit(f"{path}:"), F.coalesce(text, F.lit("unknown")))


def _micros(df: DataFrame, ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _over(spec: Aggregation, x: Column, w: WindowSpec | None) -> Column:
    at = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    finite = F.nanvl(x, F.lit(None).cast("double"))
    value = {
        "count": lambda: at(F.count(F.lit(1))).cast("double"),
        "sum": lambda: at(F.sum(x)),
        "avg": lambda: at(F.avg(x)),
        "min": lambda: F.coalesce(at(F.min(finite)), F.lit(HUGE)),
        "max": lambda: F.coalesce(at(F.max(finite)), F.lit(-HUGE)),
    }
    return value[spec.function]()


def _parts(spec: Aggregation) -> dict:
    """What a function is made of: for each part what aggregates ``__x``, what merges aggregates, and of what."""
    x = F.col("__x")
    finite = F.nanvl(x, F.lit(None).cast("double"))
    parts = {"n": (F.count, F.sum, F.lit(1)), "sum": (F.sum, F.sum, x), "min": (F.min, F.min, finite), "max": (F.max, F.max, finite)}
    return {k: parts[k] for k in {"count": ["n"], "sum": ["sum"], "avg": ["n", "sum"], "min": ["min"], "max": ["max"]}[spec.function]}


def _value(spec: Aggregation, part: Callable[[str], Column]) -> Column:
    value = {
        "count": lambda: part("n").cast("double"),
        "sum": lambda: part("sum"),
        "avg": lambda: part("sum") / part("n"),
        "min": lambda: F.coalesce(part("min"), F.lit(HUGE)),
        "max": lambda: F.coalesce(part("max"), F.lit(-HUGE)),
    }
    return value[spec.function]()


def _with_slices(df: DataFrame) -> DataFrame:
    """Add ``__slice``, which grows with ``__t``: about as many events in each."""
    steps = [i / SLICES for i in range(1, SLICES)]
    bounds = df.agg(F.percentile_approx("__t", steps, 1000)).first()[0]
    after = " + ".join(f"int(__t > {b}L)" for b in sorted(set(bounds or ()))) or "0"
    return df.withColumn("__slice", F.coalesce(F.expr(after), F.lit(-1)))  # no time comes first


def _with_slices_of_large_groups(df: DataFrame, group: str) -> DataFrame:
    """Add ``__slice``: by time in groups of over ``WHOLE`` events, the same for all events of another."""
    sizes = df.groupBy(F.col(group).alias("__large")).count()
    is_large = F.col("count") > WHOLE
    large, groups = sizes.agg(F.count_if(is_large), F.count("*")).first()
    if large == groups:
        return _with_slices(df)
    none = F.coalesce(F.pmod("__t", F.lit(1)), F.lit(0)).cast("int")  # 0, but no constant, so that a single group is dealt by it
    if not large:
        return df.withColumn("__slice", none)
    names = sizes.where(is_large).select("__large")  # one for each WHOLE events at most
    marked = _with_slices(df).join(F.broadcast(names), F.col(group) == F.col("__large"), "left")
    return marked.withColumn("__slice", F.when(F.col("__large").isNotNull(), F.col("__slice")).otherwise(none)).drop("__large")


def _block(reach: int) -> Column:
    return F.expr(f"(__t - pmod(__t, {reach + 1}L)) div {reach + 1}L")


def _same(left: list[str], right: list[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same &= F.col(a).eqNullSafe(F.col(b))
    return same


def _within(df: DataFrame, by: list[str], reach: int, parts: dict) -> DataFrame:
    """``__t``, ``by`` and parts of the events of the last ``reach`` microseconds up to ``__t``, for each time of ``df``.

    ``parts`` names columns with what aggregates events and what merges aggregates. Time is cut into blocks of one
    window, so a window is the start of its own block up to ``__t`` and the end of the block before: running values
    forwards and backwards, whose cost doesn't depend on how many events a window holds. Blocks are dealt into slices,
    and a small table adds what the other slices of a block hold.
    """
    width, key = reach + 1, [*by, "__block", "__slice"]
    times = df.groupBy(*by, "__t").agg(*[agg(c).alias(k) for k, (agg, _, c) in parts.items()]).withColumn("__at", F.col("__t"))
    nothing = [F.lit(None).cast(times.schema[k].dataType).alias(k) for k in parts]
    both = times.select("*", F.lit(0).alias("__asks")).union(times.where("__t is not null").select(*by, F.col("__t") - width, *nothing, "__at", F.lit(1)))
    both = _with_slices(both).withColumn("__block", _block(reach))
    in_slice = Window.partitionBy(*key)
    forwards = in_slice.orderBy("__t", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    backwards = in_slice.orderBy(F.desc("__t"), F.desc("__asks")).rowsBetween(Window.unboundedPreceding, 0)
    whole = both.groupBy(*key).agg(*[merge(k).alias(k) for k, (_, merge, _) in parts.items()])
    slices = Window.partitionBy(*by, "__block")
    before = slices.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    after = slices.orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__in{i}" for i in range(len(key))]
    carried = whole.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], *[m(k).over(w).alias(f"{k}{side}") for k, (_, m, _) in parts.items() for side, w in (("_before", before), ("_after", after))])
    forth = {f"{k}_forth": merge(k).over(forwards) for k, (_, merge, _) in parts.items()}
    back = {f"{k}_back": merge(k).over(backwards) for k, (_, merge, _) in parts.items()}
    met = both.withColumns(forth).withColumns(back).join(carried, _same(key, names))
    own = F.col("__asks") == 0
    ends = [F.when(own, F.array(f"{k}_forth", f"{k}_before")).otherwise(F.array(f"{k}_back", f"{k}_after")).alias(k) for k in parts]
    pieces = met.select(*by, "__at", F.explode(F.array(F.lit(0), F.lit(1))).alias("__side"), *ends)
    pieces = pieces.select(*by, "__at", *[F.get(k, "__side").alias(k) for k in parts])
    return pieces.groupBy(*by, F.col("__at").alias("__t")).agg(*[merge(k).alias(k) for k, (_, merge, _) in parts.items()])


_OF_ARRAY = {
    F.count: lambda a: F.size(F.filter(a, lambda x: x.isNotNull())).cast("long"),
    F.sum: lambda a: F.aggregate(a, F.lit(None).cast("double"), lambda total, x: F.coalesce(total + x, total, x)),
    F.min: F.array_min,
    F.max: F.array_max,
}


def _few_within(df: DataFrame, by: list[str], reach: int, parts: dict, ties: list[str], many: DataFrame | None) -> DataFrame:
    """``df``, which has ``__block``, with the parts of its windows, each added up from its first event to its last.

    A block's windows need its events and those of the block before, which are copied to it. Blocks in ``many`` are left out.
    """
    key, here = [*by, "__block"], F.col("__later") == 0
    kept = {*by, *ties, "__t"}
    event = F.struct("__t", *[c.alias(k) for k, (_, _, c) in parts.items()])
    both = df.withColumn("__event", event).withColumn("__later", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.select(*[F.col(f"`{c}`") if c in kept else F.when(here, F.col(f"`{c}`")).alias(c) for c in df.columns if c != "__block"], (F.col("__block") + F.col("__later")).alias("__block"), "__event", "__later")
    if many is not None:
        both = both.join(many, _same(key, many.columns), "left_anti")
    w = Window.partitionBy(*key).orderBy("__t", *ties).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = both.withColumn("__near", F.collect_list("__event").over(w)).where(here)
    inside = near.withColumn("__near", F.filter("__near", lambda e: e["__t"].between(F.col("__t") - reach, F.col("__t"))))
    return inside.select(*[F.col(f"`{c}`") for c in df.columns if c != "__block"], *[_OF_ARRAY[agg](F.col("__near").getField(k)).alias(k) for k, (agg, _, _) in parts.items()])


def _many_within(df: DataFrame, by: list[str], reach: int, parts: dict, many: DataFrame) -> DataFrame:
    """The same for the blocks in ``many``, with windows made up of running values."""
    key = [*by, "__block"]
    last = F.col(many.columns[-1])
    with_before = many.union(many.withColumn(many.columns[-1], last - 1)).distinct()
    found = _within(df.join(with_before, _same(key, many.columns), "left_semi"), by, reach, parts)
    names = [f"__of{i}" for i in range(len(by) + 1)]
    found = found.select(*[F.col(c).alias(n) for c, n in zip([*by, "__t"], names, strict=True)], *parts)
    asking = df.join(many, _same(key, many.columns), "left_semi").drop("__block")
    return asking.join(found, _same([*by, "__t"], names)).drop(*names)


def _with_window(df: DataFrame, by: list[str], seconds: float, parts: dict, ties: list[str]) -> DataFrame:
    """``df``, which has ``__t``, with the parts of the last ``seconds`` up to each event; ``ties`` order events of one time."""
    reach = int(seconds * 1e6)
    out = df.withColumn("__block", _block(reach))
    key = [*by, "__block"]
    held = out.select(*by, F.explode(F.expr("array(__block, __block + 1)")).alias("__block")).groupBy(*key).count()
    many = held.where((F.col("count") > FEW) | F.col("__block").isNull()).select(*[F.col(k).alias(f"__many{i}") for i, k in enumerate(key)])
    n = many.count()
    if not n:
        return _few_within(out, by, reach, parts, ties, None)
    many = F.broadcast(many) if n <= 100_000 else many
    few = _few_within(out, by, reach, parts, ties, many)
    return few.unionByName(_many_within(out, by, reach, parts, many))


def _free(df: DataFrame, *names: str) -> None:
    if taken := [n for n in names if n in df.columns]:
        raise ValueError(f"the events have columns of these names already: {taken}")


def running(df: DataFrame, spec: Aggregation, ts: str = "ts", id_: str = "event_id", group: str = "group", value: str = "value_agg", triggered: str = "triggered") -> DataFrame:
    """Add the group, its value so far and whether that passes the threshold to every event, in columns of these names."""
    _free(df, group, value, triggered)
    out = df.withColumn(group, group_text(df, spec.by_field)).withColumn("__x", number_or_zero(df, spec.field)).withColumn("__t", _micros(df, ts))
    if spec.window is not None:
        parts = _parts(spec)
        found = _with_window(out, [group], spec.window, {f"__{k}": part for k, part in parts.items()}, [c for c in (id_,) if c in df.columns]).withColumn(value, _value(spec, lambda k: F.col(f"__{k}")))
    else:
        found = _prefixed(_with_slices_of_large_groups(out, group), spec, group, value, ts, id_)
    return found.withColumn(triggered, compare(F.col(value), spec.comparison, spec.threshold)).select(*[F.col(f"`{c}`") for c in df.columns], group, value, triggered)


def _prefixed(sliced: DataFrame, spec: Aggregation, group: str, value: str, ts: str, id_: str) -> DataFrame:
    """Running values within slices, and what the slices before add to them."""
    parts = _parts(spec)
    # The key is no constant where the group is one, so that the slices are dealt by it.
    whole = sliced.groupBy(group, "__slice").agg(F.max(F.xxhash64(group)).alias("__key"), *[agg(c).alias(f"__{k}") for k, (agg, _, c) in parts.items()])
    before = Window.partitionBy(group, "__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows a group
    carried = whole.select(F.col(group).alias("__group"), F.col("__slice").alias("__in"), *[merge(f"__{k}").over(before).alias(f"__{k}_before") for k, (_, merge, _) in parts.items()])
    w = Window.partitionBy(group, "__slice").orderBy(ts, id_).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({f"__{k}": agg(c).over(w) for k, (agg, _, c) in parts.items()})
    both = local.join(carried, (F.col(group) == F.col("__group")) & (F.col("__slice") == F.col("__in")))

    def total(k: str) -> Column:
        here, there = F.col(f"__{k}"), F.col(f"__{k}_before")
        return {"min": F.least(here, there), "max": F.greatest(here, there)}.get(k, here + F.coalesce(there, F.lit(0)))

    return both.withColumn(value, _value(spec, total))


def statistics(df: DataFrame, spec: Aggregation) -> tuple[DataFrame, Observation]:
    """The events, and what Spark observes as they pass: ``total_evaluations`` and, about, ``active_groups``."""
    seen = Observation(f"aggregation-{spec.function}")
    return df.observe(seen, F.count(F.lit(1)).alias("total_evaluations"), F.approx_count_distinct(group_text(df, spec.by_field)).alias("active_groups")), seen


def per_group(df: DataFrame, spec: Aggregation) -> DataFrame:
    """``group, value_agg`` of the groups that pass the threshold as a whole: one partial and one final aggregation."""
    out = df.select(group_text(df, spec.by_field).alias("group"), number_or_zero(df, spec.field).alias("__x"))
    total = out.groupBy("group").agg(_over(spec, F.col("__x"), None).alias("value_agg"))
    return total.where(compare(F.col("value_agg"), spec.comparison, spec.threshold))


def tumbling(df: DataFrame, spec: Aggregation, ts: str = "ts") -> DataFrame:
    """``group, start, value_agg`` per window of ``spec.window`` seconds; works on streams with a watermark."""
    out = df.select(F.col(ts), group_text(df, spec.by_field).alias("group"), number_or_zero(df, spec.field).alias("__x"))
    by = F.window(F.col(ts).cast("timestamp"), f"{spec.window} seconds")
    total = out.groupBy("group", by).agg(_over(spec, F.col("__x"), None).alias("value_agg"))
    return total.select("group", F.col("window.start").alias("start"), "value_agg").where(compare(F.col("value_agg"), spec.comparison, spec.threshold))


def sessions(df: DataFrame, spec: Aggregation, gap_seconds: float, ts: str = "ts") -> DataFrame:
    """``group, start, end, value_agg`` per session, which ends ``gap_seconds`` after its last event; works on streams too."""
    out = df.withColumn("__group", group_text(df, spec.by_field)).withColumn("__x", number_or_zero(df, spec.field))
    by = F.session_window(F.col(ts).cast("timestamp"), f"{int(gap_seconds * 1e6)} microseconds").alias("session")
    total = out.groupBy("__group", by).agg(_over(spec, F.col("__x"), None).alias("value_agg"))
    found = total.select(F.col("__group").alias("group"), F.col("session.start").alias("start"), F.col("session.end").alias("end"), "value_agg")
    return found.where(compare(F.col("value_agg"), spec.comparison, spec.threshold))


def sliding(df: DataFrame, seconds: float, value: str, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Add the sum, count and first and last time of the last ``seconds`` before each event, itself included.

    A sum that isn't finite is the largest double.
    """
    parts = {
        "window_sum": (F.sum, F.sum, F.col(value).cast("double")),
        "window_count": (F.count, F.sum, F.lit(1)),
        "window_first": (F.min, F.min, F.col(ts)),
        "window_last": (F.max, F.max, F.col(ts)),
    }
    total = F.col("window_sum")
    odd = F.isnan(total) | (F.abs(total) == float("inf"))
    out = _with_window(df.withColumn("__t", _micros(df, ts)), list(by), seconds, parts, [value])
    return out.withColumn("window_sum", F.when(odd, HUGE).otherwise(total)).drop("__t")


def values_at(df: DataFrame, instants: DataFrame, seconds: float, value: str, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """``instants`` (columns ``ts`` and ``by``) with ``window_sum``, the sum of the values of the last ``seconds`` up to each."""
    asked = instants.select(F.col(ts), *by, F.lit(0.0).alias("__value"), F.lit(True).alias("__asked"))
    events = df.select(F.col(ts), *by, F.col(value).cast("double").alias("__value"), F.lit(False).alias("__asked"))
    return sliding(events.union(asked), seconds, "__value", ts, by).where("__asked").select(ts, *by, "window_sum")


_AGGREGATION = re.compile(r"(?i)(count|sum|avg|min|max)\s*\(\s*([\w.\-@]*)\s*\)(?:\s+by\s+([\w.\-@]+))?\s*(>=|<=|==|!=|=|>|<)\s*(-?\d+(?:\.\d+)?)")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def parse_aggregation(text: str, timeframe: str | None = None) -> Aggregation:
    """``count() by user > 5`` with a timeframe such as ``15m``."""
    m = _AGGREGATION.fullmatch(text.strip())
    if not m:
        raise RuleError(f"not an aggregation: {text!r}")
    seconds = None
    if timeframe is not None:
        t = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(timeframe))
        if not t:
            raise RuleError(f"not a timeframe: {timeframe!r}")
        seconds = float(int(t[1]) * _UNITS[t[2]])
    return Aggregation(m[1].lower(), "==" if m[4] == "=" else m[4], float(m[5]), m[2] or None, m[3], seconds)


def rule_alerts(df: DataFrame, rule: Rule, options: Options = Options(), ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Events at which a rule with a piped aggregation passes its threshold; an extension of the rule language."""
    from dataclasses import replace

    condition, aggregation = split_aggregation(rule.condition)
    if aggregation is None:
        raise RuleError("the condition has no aggregation")
    detection = dict(rule.detection)
    timeframe = detection.pop("timeframe", rule.extra.get("timeframe"))
    matched = match(df, replace(rule, condition=condition, detection=detection), options)
    return running(matched, parse_aggregation(aggregation, timeframe), ts, id_).where("triggered")
