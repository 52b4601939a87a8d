"""Rules, conditions and patterns: truth tables, errors, and random rules against a plain interpreter."""

import json
import random
import warnings

import pytest
from interp import evaluate
from pyspark.sql import functions as F

from ruleloom.functions import patterns as P
from ruleloom.operators.ruleset import RuleSet, match, outcome
from ruleloom.plans.compile import Options, RuleWarning
from ruleloom.plans.condition import ConditionError, describe, parse
from ruleloom.plans.rule import RuleError, rule_from_text
from ruleloom.queries import make_rule


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a and b or c", "((a and b) or c)"),
        ("a or b and not c", "(a or (b and not c))"),
        ("not(a)", "not a"),
        ("(a or b) AND c", "((a or b) and c)"),
        ("1 of them", "(a or b or c or sel_1 or sel_2)"),
        ("all of sel_*", "(sel_1 and sel_2)"),
        ("1 of a", "a"),
    ],
)
def test_condition(text, want):
    assert describe(parse(text, ["a", "b", "c", "sel_1", "sel_2"])) == want


@pytest.mark.parametrize("text", ["", "a and", "(a", "a)", "not not a", "x", "them", "sel_*", "1 of y*", "a | count() > 1", "count", "a b", "(" * 60 + "a" + ")" * 60])
def test_condition_errors(text):
    with pytest.raises(ConditionError):
        parse(text, ["a", "sel_1"])


@pytest.mark.parametrize("change", [{"title": " "}, {"id": "x"}, {"detection": {"sel": {"a": 1}}}, {"detection": {"condition": "sel"}}, {"detection": {"": {"a": 1}, "condition": "sel"}}, {"tags": ["t"] * 2, "title": "x" * 300}])
def test_rule_errors(change):
    good = {"title": "t", "id": "00000000-0000-0000-0000-000000000001", "detection": {"sel": {"a": 1}, "condition": "sel"}}
    assert rule_from_text(json.dumps(good)).title == "t"
    with pytest.raises(RuleError):
        rule_from_text(json.dumps(good | change))


@pytest.mark.parametrize(
    ("pattern", "hits", "misses"),
    [
        ("a*b", ["ab", "axxb", "a\nb"], ["abc", "xab"]),
        ("a?b", ["axb"], ["ab", "axxb"]),
        (r"test\*escape", ["test*escape"], ["testxescape"]),
        (r"c:\win\*", ["c:\\win*"], ["c:\\winx"]),
        (r"c:\\*", ["c:\\x"], ["c:x"]),
        ("100%_*", ["100%_x"], ["100xyx"]),
        ("[a]*", ["[a]b"], ["ab"]),
    ],
)
def test_globs(spark, pattern, hits, misses):
    rows = spark.createDataFrame([(x,) for x in hits + misses], "v string")
    assert sorted(r.v for r in rows.where(P.glob_match(F.col("v"), pattern)).collect()) == sorted(hits)


@pytest.mark.parametrize(("pattern", "hits", "misses"), [("^x$", ["x"], ["x\n", "xy"]), ("a.b", ["a\rb"], ["a\nb"]), ("(?P<n>a+)c", ["aac"], ["c"]), (r"\d{3}", ["x123"], ["12"])])
def test_regexes(spark, pattern, hits, misses):
    rows = spark.createDataFrame([(x,) for x in hits + misses], "v string")
    assert sorted(r.v for r in rows.where(P.regex_match(F.col("v"), pattern)).collect()) == sorted(hits)


@pytest.mark.parametrize("pattern", ["", "(a+)+", "(?=x)", r"(a)\1", "x" * 1001, "(" * 11 + ")" * 11, "["])
def test_unsafe_regexes(pattern):
    with pytest.raises(P.UnsafeRegex):
        P.regex_match(F.lit("x"), pattern)


def test_coercions(spark):
    values = ['{"v": 3}', '{"v": "3"}', '{"v": 3.9}', '{"v": -3.9}', '{"v": true}', '{"v": null}', "{}", '{"v": " 3 "}', '{"v": [3]}', '{"v": 1e30}', '{"v": {"w": 3}}']
    rows = spark.createDataFrame(list(enumerate(values)), "n long, value string").select("n", F.parse_json("value").alias("event"))

    def hits(selection):
        return sorted(r.n for r in match(rows, make_rule("t", "s", s=selection)).collect())

    assert hits({"v": 3}) == [0, 1, 2]
    assert hits({"v": "-3"}) == [3]
    assert hits({"v": True}) == [4]
    assert hits({"v": "null"}) == [5]
    assert hits({"v": "9223372036854775807"}) == [9]
    assert hits({"v.w": 3}) == [10]
    assert hits({"v": "[3]"}) == [8]
    assert hits({"v|endswith": "3"}) == [0, 1, 2, 3]


def test_unknown_modifier_and_null(spark):
    rows = spark.createDataFrame([(1, "x")], "n long, v string")
    with pytest.warns(RuleWarning):
        assert match(rows, make_rule("t", "s", s={"v|gte": "x"})).count() == 1
    with pytest.raises(RuleError):
        match(rows, make_rule("t", "s", s={"v|gte": "x"}), Options(strict=True))
    with pytest.raises(RuleError):
        match(rows, make_rule("t", "s", s={"v": None}))
    with pytest.warns(RuleWarning):
        assert match(rows, make_rule("t", "s", s={"v": "x", "n": None}), Options(lenient=True)).count() == 1


def test_missing_field_under_not(spark):
    rows = spark.createDataFrame([(1, "x")], "n long, v string")
    rule = make_rule("t", "s and not f", s={"v": "x"}, f={"gone": "y"})
    assert match(rows, rule).count() == 0 and match(rows, rule, Options(missing_field="false")).count() == 1


def _random_rule(rng, i):
    def value():
        return rng.choice(["x", "y z", "ab*", 1, 22, ["x", "b*", 3], ["ab", "q"]])

    names = ["a", "b", "c", "d.e", "gone"]
    kinds = ["", "", "|contains", "|startswith", "|endswith"]
    sels = {}
    for n in ("s1", "s2", "t1"):
        sel = {}
        for f in rng.sample(names, rng.randint(1, 2)):
            k = rng.choice(kinds)
            sel[f + k] = rng.choice(["x", "a", "b z", "2"]) if k else value()
        sels[n] = sel
    parts = ["s1", "s2", "t1", "not s1", "not (s1 or t1)", "not (s2 and t1)", "1 of s*", "all of them", "not 1 of them", "not (not s1)"]
    return make_rule(f"r{i}", f"{rng.choice(parts)} {rng.choice(['and', 'or'])} {rng.choice(parts)}", **sels)


def _random_event(rng):
    values = ["x", "y  z", "abc", "b z", "22", 1, 22, 3, 2.7, True, None, "q"]
    event = {k: rng.choice(values) for k in "abc" if rng.random() < 0.7}
    if rng.random() < 0.7:
        event["d"] = {"e": rng.choice(values)} if rng.random() < 0.8 else "x"
    return event


def test_random_rules_against_the_interpreter(spark):
    rng = random.Random(42)
    rules = [_random_rule(rng, i) for i in range(60)]
    events = [_random_event(rng) for _ in range(200)]
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)], "n long, value string").select("n", F.parse_json("value").alias("event"))
    matched = {(r.n, r.rule_id) for r in RuleSet(rules).matches(rows).select("n", "rule_id").collect()}
    for r in RuleSet(rules).evaluate(rows).select("n", "results").collect():
        for rule, got in zip(rules, r.results, strict=True):
            want = evaluate(events[r.n], rule)
            assert (got.matched, got.applicable) == (want is True, want is not None), (events[r.n], rule.detection, rule.condition)
            assert ((r.n, rule.id) in matched) == (want is True)


def test_rule_set(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = {"title": "t", "id": "00000000-0000-0000-0000-000000000001", "tags": ["attack.x"], "logsource": {"product": "windows"}, "detection": {"sel": {"v": "x"}, "condition": "sel"}}
    (tmp_path / "sub" / "a.yml").write_text(json.dumps(good))
    (tmp_path / "b.yml").write_text("{")
    (tmp_path / "c.yaml").write_text(json.dumps(good))
    rules = RuleSet.from_directory(str(tmp_path))
    assert rules.metadata() == {"total_rules": 1, "enabled_rules": 1, "failed_rules": 1}
    assert RuleSet.from_spark(spark, str(tmp_path)).metadata() == rules.metadata()
    with pytest.raises(RuleError):
        RuleSet.from_directory(str(tmp_path), fail_on_error=True)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "n long, v string")
    assert rules.matches(rows).count() == 1 and rules.disable(good["id"]).matches(rows).count() == 0
    assert rules.only(logsource={"product": "linux"}).metadata()["total_rules"] == 0
    assert [(r.matched, r.applicable) for r in outcome(rows, rules.rules[0]).orderBy("n").collect()] == [(True, True), (False, True), (False, False)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert rules.add(rules.rules[0]).matches(rows).count() == 2
    assert rules.any_match(rows).count() == 1


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "v string, w long").write.parquet(str(tmp_path / "t"))
    found = match(spark.read.parquet(str(tmp_path / "t")), make_rule("t", "s and not f", s={"v|contains": "x"}, f={"w": [1, 2]})).select("v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(v,x)" in plan and "ReadSchema: struct<v:string,w:bigint>" in plan


def test_rule_folder_names_the_files_it_skips(spark, tmp_path, monkeypatch):
    from ruleloom.operators import ruleset

    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.yml").write_text("x" * (2 << 20) if name == "a" else "not: a rule")
    monkeypatch.setattr(ruleset, "MAX_FILES", 2)
    local, remote = RuleSet.from_directory(str(tmp_path)), RuleSet.from_spark(spark, str(tmp_path))
    assert [x[0].rsplit("/", 1)[1] for x in sorted(remote.failed)] == ["a.yml", "b.yml", "c.yml"]
    assert remote.metadata() == local.metadata()


def test_yaml_rules(spark):
    from ruleloom.plans.rule import rules_from_text

    text = """
title: first
id: 00000000-0000-0000-0000-000000000001
logsource: {product: shop}
tags: [attack.t1]
detection:
  sel:
    kind|startswith: ['er', "vi"]
    n: 3
  skip:
    - note: 'it''s'
    - note: "a\\\\b"
  condition: sel and not skip
---
title: second
id: 00000000-0000-0000-0000-000000000002
detection:
  kind: view
  condition: kind
"""
    rules = rules_from_text(text.encode(), "x.yml")
    frame = spark.createDataFrame([(0, "error", 3, "n"), (1, "view", 3, "it's"), (2, "view", 3, "a\\b"), (3, "click", 3, "")], "i long, kind string, n long, note string")
    got = RuleSet(rules).matches(frame).collect()
    assert sorted((r.i, r.rule_title) for r in got) == [(0, "first"), (1, "second"), (2, "second")]


def test_wildcard_limit():
    options = Options(max_wildcards=2)
    for bad in ("sel_*_*_*", "sel**", "s*?*"):
        with pytest.raises(ConditionError):
            parse(f"1 of {bad}", ["sel_a_b_c"], options.max_wildcards)
    assert describe(parse("1 of sel_*", ["sel_a"], 2)) == "sel_a"


def test_literals_in_rule_sets(spark):
    titles = ["it's", "back\\slash", 'quote "', "new\nline", "ünï $x ${y}"]
    rules = RuleSet([make_rule(t, "sel", sel={"v": t}) for t in titles])
    frame = spark.createDataFrame([(t,) for t in titles], "v string").withColumn("__p0", F.lit(1)).withColumn("a.b", F.lit(2))
    assert sorted((r.v, r.rule_title) for r in rules.matches(frame).collect()) == sorted((t, t) for t in titles)
    assert sorted((r.rule_title, r.n) for r in rules.counts(frame).collect()) == sorted((t, 1) for t in titles)
    assert all(sum(x.matched for x in r.results) == 1 for r in rules.evaluate(frame).collect())


def test_rule_sets_agree_with_single_rules(spark):
    rng = random.Random(77)
    frame = spark.createDataFrame([(i, rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for i in range(60)], "i long, a string, b long")
    shapes = ["not (p and q)", "p and not q", "p or (q and not r)", "not (p or (q and not (r and p)))", "all of them", "1 of them", "not 1 of them"]
    rules = [make_rule(s, s, p={"a": "x", "b": 1}, q={"b": 2}, r=[{"a": "y"}, {"missing": 1, "b": 1}]) for s in shapes]
    for missing in ("reference", "false"):
        options = Options(missing_field=missing)
        got = {(r.i, x.rule_id): (x.matched, x.applicable) for r in RuleSet(rules, options).evaluate(frame).collect() for x in r.results}
        for rule in rules:
            assert {r.i: (r.matched, r.applicable) for r in outcome(frame, rule, options).collect()} == {i: v for (i, k), v in got.items() if k == rule.id}, rule.title
            assert {r.i for r in match(frame, rule, options).collect()} == {i for (i, k), (m, _) in got.items() if k == rule.id and m}


def test_identity_of_events(spark):
    from ruleloom.sources.events import with_identity

    frame = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "n long, at string")
    given = with_identity(frame, "n", "at").collect()
    assert [(r.event_id, r.event_ts.day) for r in given] == [("1", 1), ("2", 2)]
    made = with_identity(frame).collect()
    assert len({r.event_id for r in made}) == 2 and all(r.event_ts for r in made)
