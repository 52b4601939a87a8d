"""Named detection queries over the test tables, each with SQL that states its result.

The SQL of ``rule_metadata`` and ``rules_by_logsource_tag`` lists what the rules' source says; the others compute.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import aggregate as A
from ruleloom.operators.ruleset import RuleSet, match, outcome
from ruleloom.plans.compile import Options
from ruleloom.plans.rule import Rule, rule_from_dict
from ruleloom.sources.events import event_schema, parse_events
from ruleloom.streaming.pipeline import as_messages, dead_letters, dead_letters_json, split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def make_rule(title: str, condition: str, logsource: dict | None = None, tags: list[str] | None = None, level: str | None = None, **selections: Any) -> Rule:
    """A rule with an id that follows from its title."""
    id_ = str(uuid.uuid5(uuid.NAMESPACE_URL, title))
    return rule_from_dict({"title": title, "id": id_, "logsource": logsource or {}, "tags": tags or [], "level": level, "detection": {**selections, "condition": condition}})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few files out to all cores: parsing JSON, or hundreds of rules a row, costs more than moving the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _filter(name: str, source: str, key: str | list[str], sql: str, condition: str = "sel", options: Options = Options(), **selections: Any) -> None:
    """Register a query that keeps the ids of the rows that one rule matches."""
    keys = [key] if isinstance(key, str) else key

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match(table(spark, sf_dir, source), make_rule(name, condition, **selections), options).select(*keys)

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(keys)} FROM {source} WHERE {sql}"


_SPACES = r"regexp_replace(text, '\s+', ' ', 'g')"

# -- leaf predicates on typed columns ---------------------------------------------------------------
_filter("exact_match", "events", "event_id", "event_type = 'error'", sel={"event_type": "error"})
_filter("exact_case_insensitive", "part", "p_partkey", "lower(p_type) = 'promo'", options=Options(case_insensitive=True), sel={"p_type": "pRoMo"})
_filter("value_list_or", "customer", "c_custkey", "c_mktsegment IN ('BUILDING', 'FURNITURE')", sel={"c_mktsegment": ["BUILDING", "FURNITURE"]})
_filter("prefix", "pages", "page_id", "starts_with(url, 'https://blog.')", sel={"url|startswith": "https://blog."})
_filter("suffix", "customer", "c_custkey", "ends_with(c_name, '7')", sel={"c_name|endswith": "7"})
_filter("contains", "pages", "page_id", "contains(url, 'utm_source')", sel={"url|contains": "utm_source"})
_filter("contains_wildcard", "pages", "page_id", "url LIKE '%example%/en/%'", sel={"url|contains": "example*/en/"})
_filter("contains_all", "documents", "doc_id", "contains(text, 'the') AND contains(text, 'and') AND contains(text, 'tion')", sel={"text|contains|all": ["the", "and", "tion"]})
_filter("glob_star", "part", "p_partkey", "p_name LIKE 'small%t'", sel={"p_name": "small*t"})
_filter("glob_question", "part", "p_partkey", "p_brand LIKE 'Brand#_'", options=Options(glob_question=True), sel={"p_brand": "Brand#?"})
_filter("glob_question_literal", "part", "p_partkey", "p_brand = 'Brand#?'", sel={"p_brand": "Brand#?"})
_filter("glob_escaped", "documents", "doc_id", r"text LIKE '%\%\%\%%' ESCAPE '\' OR contains(text, '***')", "1 of sel_*", sel_a={"text|contains": "%%%"}, sel_b={"text|contains": r"\*\*\*"})
_filter("regex", "customer", "c_custkey", "regexp_matches(c_name, '#0*[1-4]5$')", sel={"c_name|re": "#0*[1-4]5$"})
_filter("slash_regex", "part", "p_partkey", "regexp_matches(p_brand, '^Brand#1[0-9]$')", sel={"p_brand": "/^Brand#1[0-9]$/"})
_filter("keyword", "conversations", ["conv_id", "turn"], "contains(text, 'ation')", sel={"text|keyword": "ation"})
_filter("numeric_eq", "part", "p_partkey", "p_size = 10", sel={"p_size": 10})
_filter("numeric_in", "events", "event_id", "user_id IN (3, 5, 8, 13)", sel={"user_id": [3, 5, 8, 13]})
_filter("float_truncation", "part", "p_partkey", "trunc(p_retailprice) = 905", sel={"p_retailprice": 905})
_filter("float_literal", "part", "p_partkey", "false", sel={"p_retailprice": 905.5})
_filter("labels_numeric", "labels", "doc_id", "quality = 1 AND toxic = 1", sel={"quality": 1, "toxic": 1})
_filter("whitespace_collapse", "documents", "doc_id", f"contains({_SPACES}, 'the of')", sel={"text|contains": "the   of"})
_filter("whitespace_newline", "documents", "doc_id", f"{_SPACES} LIKE '%. The%of %a%'", sel={"text|contains": ". The*of *a"})

# -- selections and conditions ----------------------------------------------------------------------
_filter("and_fields", "events", "event_id", "event_type = 'purchase' AND user_id = 7", sel={"event_type": "purchase", "user_id": 7})
_filter("list_of_maps_or", "events", "event_id", "(event_type = 'error' AND user_id = 2) OR (event_type = 'view' AND user_id = 3)", sel=[{"event_type": "error", "user_id": 2}, {"event_type": "view", "user_id": 3}])
_filter("one_of_them", "pages", "page_id", "starts_with(url, 'http://') OR contains(url, '/de/')", "1 of them", a={"url|startswith": "http://"}, b={"url|contains": "/de/"})
_filter("all_of_them", "pages", "page_id", "starts_with(url, 'https://') AND contains(url, '/en/')", "all of them", a={"url|startswith": "https://"}, b={"url|contains": "/en/"})
_filter("one_of_wildcard", "customer", "c_custkey", "c_mktsegment = 'BUILDING' OR c_nationkey = 3", "1 of sel_*", sel_a={"c_mktsegment": "BUILDING"}, sel_b={"c_nationkey": 3}, other={"c_nationkey": 4})
_filter("all_of_wildcard", "customer", "c_custkey", "c_mktsegment = 'BUILDING' AND c_nationkey = 3", "all of sel_*", sel_a={"c_mktsegment": "BUILDING"}, sel_b={"c_nationkey": 3}, other={"c_nationkey": 4})
_filter("nested_parens", "orders", "o_orderkey", "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT (o_orderpriority = '5-LOW' OR (starts_with(o_orderpriority, '3') AND o_orderstatus = 'P'))",
        "(fin or par) and not (low or (mid and par))", fin={"o_orderstatus": "F"}, par={"o_orderstatus": "P"}, low={"o_orderpriority": "5-LOW"}, mid={"o_orderpriority|startswith": "3"})
_filter("sel_not_filter", "events", "event_id", "event_type = 'error' AND user_id NOT IN (1, 2, 3)", "sel and not filter", sel={"event_type": "error"}, filter={"user_id": [1, 2, 3]})
_filter("not_without_space", "events", "event_id", "event_type <> 'click'", "not(sel)", sel={"event_type": "click"})
_filter("missing_field_under_not", "events", "event_id", "false", "sel and not filter", sel={"event_type": "error"}, filter={"no_such_field": "x"})
_filter("missing_field_false", "events", "event_id", "event_type = 'error'", "sel and not filter", options=Options(missing_field="false"), sel={"event_type": "error"}, filter={"no_such_field": "x"})
# What never matches still applies or doesn't, which shows under a negation and beside another selection.
_filter("glob_question_literal_negated", "part", "p_partkey", "p_brand <> 'Brand#?'", "not sel", sel={"p_brand": "Brand#?"})
_filter("float_literal_negated", "part", "p_partkey", "true", "not sel", sel={"p_retailprice": 905.5})
_filter("missing_field_beside_another", "events", "event_id", "event_type = 'view'", "other or (sel and not filter)", sel={"event_type": "error"}, filter={"no_such_field": "x"}, other={"event_type": "view"})
# Bare values belong to the field that has the selection's name; with an option a list is about the event's keywords.
_filter("bare_value", "events", "event_id", "event_type = 'error'", "event_type", event_type="error")
_filter("bare_list", "events", "event_id", "event_type IN ('error', 'view')", "event_type", event_type=["error", "view"])
_filter("null_scalar_in_list", "customer", "c_custkey", "c_mktsegment IN ('', 'BUILDING')", sel={"c_mktsegment": [None, "BUILDING"]})
_filter("one_of_name", "events", "event_id", "event_type = 'error'", "1 of sel", sel={"event_type": "error"}, other={"event_type": "view"})
_filter("upper_case_words", "events", "event_id", "event_type = 'error' OR (event_type = 'view' AND user_id <> 3)", "err OR (view AND NOT three)", err={"event_type": "error"}, view={"event_type": "view"}, three={"user_id": 3})
_filter("custom_modifier", "customer", "c_custkey", "length(c_name) = 18", options=Options(modifiers={"length": lambda text, n: F.length(text) == n}), sel={"c_name|length": 18})
_filter("strict_all", "part", "p_partkey", "contains(p_name, 'small') AND contains(p_name, 'a')", options=Options(strict=True), sel={"p_name|contains|all": ["small", "a"]})


def _keyword_rows(name: str, sql: str, condition: str, words: list[str]) -> None:
    """Register a query on events whose ``message`` is a keyword, missing in some, that reports all outcomes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("message"))
        return outcome(rows, make_rule(name, condition, keywords=words), Options(keyword_lists=True)).select("event_id", "matched", "applicable")

    QUERIES[name] = run
    SQL[name] = f"WITH e AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS message FROM events) SELECT event_id, coalesce({sql}, false) AS matched, message IS NOT NULL AS applicable FROM e"


_keyword_rows("keyword_set", "message = 'error'", "keywords", ["error"])
_keyword_rows("keyword_set_negated", "message <> 'error'", "not keywords", ["error"])
_keyword_rows("keyword_set_of_two", "message = 'error' AND message = 'view'", "keywords", ["error", "view"])


def _outcomes(name: str, sql: str, condition: str, **selections: Any) -> None:
    """Register a query that reports all three outcomes of a rule over events with missing fields."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("maybe"))
        return outcome(e, make_rule(name, condition, **selections)).select("event_id", "matched", "applicable")

    QUERIES[name] = run
    SQL[name] = f"WITH e AS (SELECT event_id, event_type, user_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS maybe FROM events), r AS ({sql}) SELECT event_id, coalesce(x, false) AS matched, x IS NOT NULL AS applicable FROM r"


_outcomes("not_compound_missing", "SELECT event_id, CASE WHEN maybe IS NULL THEN NULL WHEN maybe = 'error' AND user_id = 4 THEN false ELSE true END AS x FROM e", "not (a and b)", a={"maybe": "error"}, b={"user_id": 4})
_outcomes("and_first_not_true", "SELECT event_id, CASE WHEN event_type <> 'view' THEN false WHEN maybe IS NULL THEN NULL ELSE maybe = 'view' END AS x FROM e", "b and a", a={"maybe": "view"}, b={"event_type": "view"})
_outcomes("or_all_missing", "SELECT event_id, CASE WHEN maybe = 'view' THEN true WHEN maybe IS NULL THEN NULL ELSE false END AS x FROM e", "a or b", a={"maybe": "view"}, b={"absent": 1})
_outcomes("or_one_missing", "SELECT event_id, coalesce(maybe = 'view', false) OR user_id = 4 AS x FROM e", "a or b", a={"maybe": "view"}, b={"user_id": 4})

# -- JSON events ------------------------------------------------------------------------------------


def _json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and a VARIANT ``event`` with nested, numeric, textual, boolean, null and absent fields."""
    e = _spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"))
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k = F.col("k")
    fields = [
        '"id":', F.col("event_id").cast("string"), ',"type":"', F.col("event_type"), '","user":{"id":', F.col("user_id").cast("string"), '},"k":', k.cast("string"),
        ',"ktext":"', k.cast("string"), '","kpad":" ', k.cast("string"), '","half":', k.cast("string"), '.5,"flag":', F.when(k % 2 == 0, "true").otherwise("false"),
        F.when(k % 3 == 0, ',"opt":null').when(k % 3 == 1, ',"opt":"x"').otherwise(""), ',"tags":["a",', k.cast("string"), "]",
    ]
    text = F.concat(F.lit("{"), *[f if not isinstance(f, str) else F.lit(f) for f in fields], F.lit("}"))
    return parse_events(e.select("event_id", text.alias("value")), mode="FAILFAST").select("event_id", "event")


def _json(name: str, sql: str, condition: str = "sel", **selections: Any) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match(_json_events(spark, sf_dir), make_rule(name, condition, **selections)).select("event_id")

    QUERIES[name] = run
    SQL[name] = f"WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id FROM e WHERE {sql}"


_json("json_nested_field", "user_id = 7", sel={"user.id": 7})
_json("numeric_string_coercion", "k = 42", sel={"ktext": 42})
_json("padded_text_is_no_number", "false", sel={"kpad": 42})
_json("number_as_text", "k = 42", sel={"k": "42"})
_json("json_float_truncation", "k IN (10, 11)", sel={"half": [10, 11]})
_json("json_float_text", "k = 42", sel={"half": "42"})
_json("bool_not_numeric", "false", sel={"flag": 1})
_json("bool_literal", "k % 2 = 0", sel={"flag": True})
_json("null_is_text_null", "k % 3 = 0", sel={"opt": "null"})
_json("null_vs_missing", "k % 3 IN (0, 1) AND NOT k % 3 = 1", "sel and not x", sel={"type|contains": ""}, x={"opt": "x"})
_json("json_array_text", "k = 42", sel={"tags": '["a",42]'})
_json("array_index_is_no_path", "false", sel={"tags.0": "a"})
_json("padded_text_negated", "true", "not sel", sel={"kpad": 42})
_json("bool_not_numeric_negated", "true", "not sel", sel={"flag": 1})
_json("array_index_beside_another", "event_type = 'error'", "sel or other", sel={"tags.0": "a"}, other={"type": "error"})
_json("empty_in_list", "k % 3 = 1", sel={"opt": [None, "x"]})


def _json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and numbers of JSON fields as rules see them."""
    e = _json_events(spark, sf_dir)
    events = event_schema(e)
    found = {n: events.field(n) for n in ("k", "ktext", "half", "flag", "opt")}
    bound = events.bind(e)
    return bound.select("event_id", *[v.text.alias(f"{n}_text") for n, v in found.items()], *[v.number.alias(f"{n}_number") for n, v in found.items()], found["opt"].present.alias("opt_present"))


QUERIES["coercions"] = _json_types
SQL["coercions"] = """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(k AS VARCHAR) AS k_text, CAST(k AS VARCHAR) AS ktext_text, CAST(k AS VARCHAR) AS half_text, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS flag_text,
       CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'x' END AS opt_text, k AS k_number, k AS ktext_number, k AS half_number, CAST(NULL AS BIGINT) AS flag_number, CAST(NULL AS BIGINT) AS opt_number, k % 3 < 2 AS opt_present
FROM e
"""



def _json_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as doubles, where they are numbers or texts that stand for one."""
    e = _json_events(spark, sf_dir)
    events = event_schema(e)
    found = {n: events.field(n) for n in ("k", "ktext", "kpad", "half", "flag", "opt")}
    return events.bind(e).select("event_id", *[v.double.alias(f"{n}_double") for n, v in found.items()], found["ktext"].is_number.alias("text_is_number"), found["opt"].is_number.alias("opt_is_number"))


QUERIES["doubles"] = _json_doubles
SQL["doubles"] = """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(k AS DOUBLE) AS k_double, CAST(k AS DOUBLE) AS ktext_double, CAST(NULL AS DOUBLE) AS kpad_double, k + 0.5::DOUBLE AS half_double, CAST(NULL AS DOUBLE) AS flag_double, CAST(NULL AS DOUBLE) AS opt_double,
       true AS text_is_number, false AS opt_is_number FROM e
"""

# -- rule sets --------------------------------------------------------------------------------------


def event_rules() -> list[Rule]:
    """A few rules over ``events`` with logsources and tags."""
    return [
        make_rule("errors of early users", "sel and few", {"product": "shop", "category": "web"}, ["attack.t1"], "high", sel={"event_type": "error"}, few={"user_id": list(range(20))}),
        make_rule("purchases but not small", "sel and not small", {"product": "shop"}, ["attack.t2"], "low", sel={"event_type": "purchase"}, small={"value": list(range(10))}),
        make_rule("views or clicks", "1 of sel_*", {"product": "web"}, ["attack.t1", "attack.t2"], "medium", sel_a={"event_type": "view"}, sel_b={"event_type": "click"}),
        make_rule("never", "sel", {"product": "shop"}, [], "low", sel={"event_type": "nothing"}),
    ]


_RULE_SQL = {
    "errors of early users": "event_type = 'error' AND user_id < 20 AND user_id >= 0",
    "purchases but not small": "event_type = 'purchase' AND NOT (trunc(value) >= 0 AND trunc(value) < 10)",
    "views or clicks": "event_type IN ('view', 'click')",
    "never": "false",
}
_ALL_MATCHES = " UNION ALL ".join(f"SELECT event_id, '{r.id}' AS rule_id, '{r.title}' AS rule_title FROM events WHERE {_RULE_SQL[r.title]}" for r in event_rules())


def _registered(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


@_registered("ruleset_matches", _ALL_MATCHES)
def _ruleset_matches(spark, sf_dir):
    return RuleSet(event_rules()).matches(table(spark, sf_dir, "events")).select("event_id", "rule_id", "rule_title")


@_registered("ruleset_counts_by_rule", f"SELECT rule_id, rule_title, count(*) AS n FROM ({_ALL_MATCHES}) GROUP BY ALL")
def _ruleset_counts(spark, sf_dir):
    return RuleSet(event_rules()).counts(table(spark, sf_dir, "events"))


@_registered("ruleset_evaluate", " UNION ALL ".join(f"SELECT event_id, '{r.id}' AS rule_id, {_RULE_SQL[r.title]} AS matched, true AS applicable FROM events" for r in event_rules()))
def _ruleset_evaluate(spark, sf_dir):
    found = RuleSet(event_rules()).evaluate(table(spark, sf_dir, "events"))
    return found.select("event_id", F.explode("results").alias("r")).select("event_id", "r.rule_id", "r.matched", "r.applicable")


@_registered("any_match", f"SELECT DISTINCT event_id FROM ({_ALL_MATCHES})")
def _any_match(spark, sf_dir):
    return RuleSet(event_rules()).any_match(table(spark, sf_dir, "events")).select("event_id")


@_registered("disabled_rule", f"SELECT event_id, rule_title FROM ({_ALL_MATCHES}) WHERE rule_title <> 'views or clicks'")
def _disabled_rule(spark, sf_dir):
    rules = RuleSet(event_rules())
    return rules.disable(rules.rules[2].id).matches(table(spark, sf_dir, "events")).select("event_id", "rule_title")


@_registered("rules_by_logsource_tag", "SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.title}', '{r.level}')" for r in event_rules() if r.logsource.product == "shop" and "attack.t1" in r.tags) + ") AS t(id, title, level)")
def _rules_by_logsource(spark, sf_dir):
    return RuleSet(event_rules()).only(logsource={"product": "shop"}, tags=["attack.t1"]).frame(spark).select("id", "title", "level")


@_registered("rule_metadata", "SELECT * FROM (VALUES " + ", ".join(f"('{r.title}', {len(r.tags)}, '{r.logsource.product}', true)" for r in event_rules()) + ") AS t(title, n_tags, product, enabled)")
def _rule_metadata(spark, sf_dir):
    return RuleSet(event_rules()).frame(spark).select("title", F.size("tags").alias("n_tags"), "logsource.product", "enabled")


@_registered("alerts_json", f"SELECT rule_id AS key, CAST(event_id AS VARCHAR) AS event_id, rule_id, rule_title FROM ({_ALL_MATCHES})")
def _alerts_json(spark, sf_dir):
    rows = RuleSet(event_rules()).alerts_json(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value"))
    return rows.select("key", F.get_json_object(F.get_json_object("value", "$.event"), "$.event_id").alias("event_id"), F.get_json_object("value", "$.rule_id").alias("rule_id"), F.get_json_object("value", "$.rule_title").alias("rule_title"))


def many_rules(n: int = 454) -> list[Rule]:
    """Three-part rules over ``events``, all different."""
    kinds = ("error", "view", "click", "purchase", "signup")
    return [
        make_rule(f"rule {i}", "sel and (part or few) and not skip", sel={"event_type": kinds[i % 5]}, part={"props|contains": f"{i % 100}"}, few={"user_id": [i % 150, (i * 7) % 150]}, skip={"event_type|startswith": kinds[(i + 1) % 5][:3], "user_id": i % 150})
        for i in range(n)
    ]


@_registered(
    "many_rules_counts",
    """
WITH r AS (SELECT i, ['error', 'view', 'click', 'purchase', 'signup'][i % 5 + 1] AS kind, ['error', 'view', 'click', 'purchase', 'signup'][(i + 1) % 5 + 1] AS other FROM range(454) AS t(i))
SELECT 'rule ' || i AS rule_title, count(*) AS n FROM r JOIN events ON event_type = kind AND (contains(props, CAST(i % 100 AS VARCHAR)) OR user_id IN (i % 150, (i * 7) % 150)) AND NOT (starts_with(event_type, other[1:3]) AND user_id = i % 150)
GROUP BY i
""",
)
def _many_rules(spark, sf_dir):
    return RuleSet(many_rules()).counts(_spread(table(spark, sf_dir, "events").select("event_type", "user_id", "props"))).select("rule_title", "n")


# -- aggregations and windows -----------------------------------------------------------------------
def _running(name: str, spec: A.Aggregation, value: str, hit: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = A.running(table(spark, sf_dir, "events").where("event_type = 'purchase'"), spec)
        return found.select("event_id", "group", F.round("value_agg", 6).alias("value_agg"), "triggered")

    QUERIES[name] = run
    frame = "ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING" if spec.window is None else f"ORDER BY ts RANGE BETWEEN INTERVAL {int(spec.window)} SECOND PRECEDING AND CURRENT ROW"
    group = "'user_id:' || user_id" if spec.by_field == "user_id" else "'default'" if not spec.by_field else f"'{spec.by_field}:unknown'"
    SQL[name] = f"""
SELECT event_id, "group", round(v, 6) AS value_agg, v {hit} AS triggered FROM (
  SELECT event_id, {group} AS "group", CAST({value} OVER (PARTITION BY {group} {frame}) AS DOUBLE) AS v FROM events WHERE event_type = 'purchase')
"""


_running("running_count_threshold", A.Aggregation("count", ">", 5, None, "user_id"), "count(*)", "> 5")
_running("running_sum_threshold", A.Aggregation("sum", ">=", 500.5, "value", "user_id"), "sum(value)", ">= 500.5")
_running("running_avg_threshold", A.Aggregation("avg", "<", 60, "value", "user_id"), "avg(value)", "< 60")
_running("running_min_threshold", A.Aggregation("min", "<=", 5, "value", "user_id"), "min(value)", "<= 5")
_running("running_max_threshold", A.Aggregation("max", "!=", 100, "value", "user_id"), "max(value)", "<> 100")
_running("running_text_is_zero", A.Aggregation("sum", "==", 0, "event_type", "user_id"), "sum(0)", "= 0")
_running("group_unknown", A.Aggregation("count", ">", 10, None, "no_such_field"), "count(*)", "> 10")
_running("group_default", A.Aggregation("count", ">", 10), "count(*)", "> 10")
_running("sliding_count_threshold", A.Aggregation("count", ">=", 2, None, "user_id", 3600), "count(*)", ">= 2")
_running("sliding_sum_threshold", A.Aggregation("sum", ">", 100.5, "value", "user_id", 86_400), "sum(value)", "> 100.5")


@_registered("sliding_sum", "SELECT event_id, round(sum(value) OVER w, 6) AS window_sum, count(*) OVER w AS window_count, min(ts) OVER w AS window_first, max(ts) OVER w AS window_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def _sliding_sum(spark, sf_dir):
    found = A.sliding(table(spark, sf_dir, "events"), 3600, "value", by=("user_id",))
    return found.select("event_id", F.round("window_sum", 6).alias("window_sum"), "window_count", "window_first", "window_last")


@_registered("batch_count_threshold", "SELECT 'user_id:' || user_id AS \"group\", CAST(count(*) AS DOUBLE) AS value_agg FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 10")
def _batch_count(spark, sf_dir):
    return A.per_group(table(spark, sf_dir, "events").where("event_type = 'error'"), A.Aggregation("count", ">", 10, None, "user_id"))


@_registered("tumbling_count", "SELECT 'user_id:' || user_id AS \"group\", time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS DOUBLE) AS value_agg FROM events GROUP BY ALL HAVING count(*) >= 5")
def _tumbling(spark, sf_dir):
    found = A.tumbling(table(spark, sf_dir, "events"), A.Aggregation("count", ">=", 5, None, "user_id", 86_400))
    return found.select("group", F.col("start").cast("timestamp_ntz").alias("start"), "value_agg")


@_registered("session_count", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT 'user_id:' || user_id AS "group", min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", CAST(count(*) AS DOUBLE) AS value_agg FROM s GROUP BY user_id, n HAVING count(*) >= 2
""")
def _sessions(spark, sf_dir):
    found = A.sessions(table(spark, sf_dir, "events"), A.Aggregation("count", ">=", 2, None, "user_id"), 6 * 3600)
    return found.select("group", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "value_agg")


@_registered("sliding_all", "SELECT event_id, round(sum(value) OVER w, 6) AS window_sum, count(*) OVER w AS window_count FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def _sliding_all(spark, sf_dir):
    return A.sliding(table(spark, sf_dir, "events"), 3600, "value").select("event_id", F.round("window_sum", 6).alias("window_sum"), "window_count")


@_registered("values_at", """
WITH i AS (SELECT ts, user_id FROM events WHERE event_type = 'error')
SELECT i.ts, i.user_id, round(sum(e.value), 6) AS window_sum FROM (SELECT DISTINCT * FROM i) i JOIN events e ON e.user_id = i.user_id AND e.ts BETWEEN i.ts - INTERVAL 1 DAY AND i.ts GROUP BY ALL
""")
def _values_at(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = A.values_at(events, events.where("event_type = 'error'").select("ts", "user_id").distinct(), 86_400, "value", by=("user_id",))
    return found.select("ts", "user_id", F.round("window_sum", 6).alias("window_sum"))


@_registered("rule_aggregation", "SELECT event_id, CAST(v AS DOUBLE) AS value_agg FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS v FROM events WHERE event_type = 'error') WHERE v > 1")
def _rule_aggregation(spark, sf_dir):
    rule = make_rule("many errors", "sel | count() by user_id > 1", sel={"event_type": "error"}, timeframe="12h")
    return A.rule_alerts(table(spark, sf_dir, "events"), rule).select("event_id", "value_agg")


# -- malformed input --------------------------------------------------------------------------------
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("test-message-"), "event_id")).otherwise(F.col("props")).alias("value"))


@_registered("dlq_malformed", "SELECT 'test-message-' || event_id AS payload, 'not valid JSON' AS error, 'lines' AS topic FROM events WHERE event_id % 7 = 0")
def _dlq(spark, sf_dir):
    dead = dead_letters(split(as_messages(_lines(spark, sf_dir), "lines"))[1])
    header = lambda k: F.get(F.filter("headers", lambda h: h["key"] == k), 0)["value"].cast("string")
    return dead.select(F.col("value").cast("string").alias("payload"), header("dlq.error.message").alias("error"), header("dlq.original.topic").alias("topic"))


@_registered("dlq_json", "SELECT 'test-message-' || event_id AS payload, 'not valid JSON' AS error, 'lines' AS topic, 2 AS attempts, 'shop' AS origin FROM events WHERE event_id % 7 = 0")
def _dlq_json(spark, sf_dir):
    dead = dead_letters_json(split(as_messages(_lines(spark, sf_dir), "lines"))[1], attempts=2, metadata={"origin": "shop"})
    at = lambda path: F.get_json_object("value", path)
    return dead.select(at("$.original_payload").alias("payload"), at("$.error").alias("error"), at("$.original.topic").alias("topic"), at("$.attempts").cast("int").alias("attempts"), at("$.metadata.origin").alias("origin"))


@_registered("ndjson_dropmalformed", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def _dropmalformed(spark, sf_dir):
    events = parse_events(_lines(spark, sf_dir), mode="DROPMALFORMED")
    return events.select(F.try_variant_get("event", "$.k", "bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of users outside a filter, the first query a rule engine should answer."""
    return QUERIES["sel_not_filter"](spark, sf_dir)
