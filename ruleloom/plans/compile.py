"""Rules to boolean Columns.

A rule's outcome on an event is true, false or null: null means that it doesn't apply, because a field is
missing. This isn't SQL's logic: a conjunction is its first item that isn't true, be it false or null, and
a disjunction is null only if all its items are. The difference shows under a negation, and where outcomes
are reported; elsewhere a filter keeps true rows only and the compiler emits plain ``AND`` and ``OR``, which
Catalyst can push to the scan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions import patterns as P
from ruleloom.plans.condition import And, Name, Not, Or, parse, split_aggregation
from ruleloom.plans.rule import Rule, RuleError

Modifier = Callable[[Column, Any], Column]
_KINDS = {"contains": "contains", "startswith": "startswith", "prefix": "startswith", "endswith": "endswith", "suffix": "endswith", "re": "regex", "regex": "regex", "keyword": "contains"}
_I64 = range(-(2**63), 2**63)


class RuleWarning(UserWarning):
    """A rule compiles, but not to what its author is likely to mean."""


@dataclass(frozen=True)
class Options:
    """How rules are read.

    missing_field: ``reference`` keeps "doesn't apply" under a negation, ``false`` makes a missing field false.
    case_insensitive: ignore the case of A-Z. glob_question: ``?`` alone makes a value a glob.
    strict: unknown modifiers are errors, and ``all`` over values of mixed types means all of them.
    lenient: items of a selection that don't compile are left out with a warning.
    keyword_lists: a selection that is a list of texts is about the event's keywords, not a field of its name.
    max_wildcards: how many of ``*`` and ``?`` a condition's ``1 of name*`` may hold, without two in a row.
    """

    missing_field: str = "reference"
    case_insensitive: bool = False
    glob_question: bool = False
    strict: bool = False
    lenient: bool = False
    keyword_lists: bool = False
    max_wildcards: int | None = None
    regex: P.RegexLimits = P.RegexLimits()
    modifiers: dict[str, Modifier] = field(default_factory=dict)


def all_of(items: list[Column], exact: bool) -> Column:
    """Conjunction: the first item that isn't true."""
    if len(items) == 1:
        return items[0]
    if not exact:
        return reduce(lambda a, b: a & b, items)
    # Each item becomes a number that grows with its place, far larger where the item is true; the least one
    # decides, and its remainder tells false (0), true (1) or null (2). No item is written twice.
    value = F.array(F.lit(0), F.lit(1_000_001), F.lit(2))
    numbers = [F.get(value, F.coalesce(x.cast("int"), F.lit(2))) + F.lit(4 * i) for i, x in enumerate(items)]
    return F.get(F.array(F.lit(False), F.lit(True), F.lit(None).cast("boolean")), F.least(*numbers) % 4)


def any_of(items: list[Column], exact: bool) -> Column:
    """Disjunction: true if any is, null if all are."""
    if len(items) == 1:
        return items[0]
    return F.greatest(*items) if exact else reduce(lambda a, b: a | b, items)


class Compiler:
    """Compiles rules against one event schema."""

    def __init__(self, events, options: Options = Options()):
        self.events, self.options = events, options

    def rule(self, rule: Rule, exact: bool = False) -> Column:
        """The outcome of a rule; ``exact`` tells false from null in the result, not only under negations."""
        condition, aggregation = split_aggregation(rule.condition)
        if aggregation is not None:
            raise RuleError("a condition with an aggregation needs operators.aggregate.rule_alerts")
        return self.expression(parse(condition, rule.detection, self.options.max_wildcards), rule, exact)

    def expression(self, node, rule: Rule, exact: bool) -> Column:
        if isinstance(node, Name):
            return self.selection(node.name, rule.detection[node.name], rule.collapse_whitespace, exact)
        if isinstance(node, Not):
            return self.negated(self.expression(node.of, rule, True))
        items = [self.expression(x, rule, exact) for x in node.of]
        return self.all_of(items, exact) if isinstance(node, And) else self.any_of(items, exact)

    all_of, any_of = staticmethod(all_of), staticmethod(any_of)

    @staticmethod
    def negated(item: Column) -> Column:
        return ~item

    def selection(self, name: str, value: Any, collapse: bool = True, exact: bool = False) -> Column:
        """A map is all of its fields, a list any of its items; bare values belong to the field of that name.

        With ``keyword_lists``, a list of texts asks for an event that has all of them as its keywords.
        """
        if isinstance(value, dict):
            keys = sorted(value, key=str)
            return self.all_of(self._kept([lambda k=k: self.field(str(k), value[k], collapse) for k in keys], name), exact)
        if isinstance(value, list) and any(isinstance(x, dict) for x in value):
            return self.any_of(self._kept([lambda x=x: self.selection(name, x, collapse, exact) for x in value], name), exact)
        if self.options.keyword_lists and isinstance(value, list) and value and all(isinstance(x, str) for x in value):
            return self.keywords(value)
        return self.field(name, value, collapse)

    def keywords(self, words: list[str]) -> Column:
        """Whether all words are keywords of the event; null if it has none."""
        own = self.events.keywords()
        return F.when(own.isNotNull(), reduce(lambda a, b: a & b, [F.array_contains(own, w) for w in words]))

    def _kept(self, makers: list[Callable[[], Column]], where: str) -> list[Column]:
        out = []
        for make in makers:
            try:
                out.append(make())
            except RuleError as e:
                if not self.options.lenient:
                    raise
                warnings.warn(f"{where}: left out: {e}", RuleWarning, stacklevel=2)
        if not out:
            raise RuleError(f"{where!r} has nothing that compiles")
        return out

    def field(self, key: str, value: Any, collapse: bool = True) -> Column:
        """One field with its modifiers against a value or a list of values."""
        path, *given = key.split("|")
        kind, every, custom = None, False, None
        for m in (g.lower() for g in given):
            if m == "all":
                every = True
            elif m in self.options.modifiers:
                custom = self.options.modifiers[m]
            elif m in _KINDS:
                kind = m
            elif self.options.strict:
                raise RuleError(f"unknown modifier {m!r}")
            else:
                warnings.warn(f"unknown modifier {m!r} on {path!r} is ignored", RuleWarning, stacklevel=2)
        values = value if isinstance(value, list) else [value]
        if isinstance(value, dict) or any(isinstance(v, (dict, list)) for v in values):
            raise RuleError(f"a value of {path!r} has an unsupported type")
        if not values:
            raise RuleError(f"{path!r} has no values")
        if value is None:
            raise RuleError(f"a null for {path!r} is supported in lists only")
        at = self.events.field(path)
        if at is None:
            none = F.lit(None).cast("boolean")
            for v in values:  # patterns are checked whether or not the field exists
                if isinstance(v, str) and kind in ("re", "regex"):
                    P.regex_match(F.lit(""), self._text(v, collapse), False, self.options.regex)
            return F.lit(False) if self.options.missing_field == "false" else none
        every = every and (all(isinstance(v, str) for v in values) or self.options.strict)
        if custom is not None:
            leaves = [custom(at.text, v) for v in values]
        elif every:
            leaves = [self._leaf(at, kind, v, collapse) for v in values]
        else:
            leaves = self._any(at, kind, values, collapse)
        # All leaves are on one field, so they apply or not together.
        found = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), leaves)
        return F.coalesce(found, F.lit(False)) if self.options.missing_field == "false" else found

    @staticmethod
    def _text(value: str, collapse: bool) -> str:
        return P.collapse(value) if collapse else value

    def _shape(self, kind: str | None, text: str) -> str:
        """How a text value matches: exact, glob, contains, startswith, endswith or regex."""
        if kind is None or kind == "keyword":
            if len(text) > 2 and text.startswith("/") and text.endswith("/"):
                return "slash"
        if kind is not None:
            return _KINDS[kind]
        return "glob" if "*" in text or (self.options.glob_question and "?" in text) else "exact"

    def _any(self, at, kind: str | None, values: list, collapse: bool) -> list[Column]:
        """Leaves of a list; equal comparisons become one ``IN``."""
        texts, numbers, leaves = [], [], []
        for v in values:
            if isinstance(v, int) and not isinstance(v, bool) and v in _I64:
                numbers.append(v)
            elif isinstance(v, str) and self._shape(kind, self._text(v, collapse)) == "exact" and not any(c.isspace() for c in self._text(v, collapse)) and not self.options.case_insensitive:
                texts.append(self._text(v, collapse))
            else:
                leaves.append(self._leaf(at, kind, v, collapse))
        if len(texts) > 1:
            leaves.append(at.text.isin(texts))
        elif texts:
            leaves.append(at.text == F.lit(texts[0]))
        if numbers:
            leaves.append(self._number(at, numbers))
        return leaves

    def _number(self, at, values: list[int]) -> Column:
        equal = at.number.isin(values) if len(values) > 1 else at.number == F.lit(values[0])
        return equal if at.exact_number else F.when(at.present, F.coalesce(equal, F.lit(False)))

    def _leaf(self, at, kind: str | None, value: Any, collapse: bool) -> Column:
        fold = self.options.case_insensitive
        if value is None:
            return at.text == F.lit("")
        if isinstance(value, bool):
            return at.text == F.lit("true" if value else "false")
        if isinstance(value, int) and value in _I64:
            return self._number(at, [value])
        if isinstance(value, (int, float)):
            return at.text == F.lit(decimal_text(float(value)))
        text = self._text(str(value), collapse)
        shape = self._shape(kind, text)
        if shape in ("regex", "slash"):
            return P.regex_match(at.text, text if shape == "regex" else text[1:-1], fold, self.options.regex)
        if shape == "contains":
            return P.contains_match(at.text, text, fold, collapse)
        if shape == "glob":
            return P.glob_match(at.text, text, fold, collapse)
        return P.literal_match(shape, at.text, text, fold, collapse)


class LeafCompiler(Compiler):
    """Compiles rules to SQL text over leaf columns, which rules share: each is computed once an event.

    ``columns`` holds the leaves, named from ``prefix``.
    """

    def __init__(self, events, options: Options = Options(), prefix: str = "__p"):
        super().__init__(events, options)
        self.columns: list[Column] = []
        self._prefix, self._names = prefix, {}

    def _named(self, key: tuple, make: Callable[[], Column]) -> str:
        if key not in self._names:
            name = f"{self._prefix}{len(self._names)}"
            self.columns.append(make().alias(name))
            self._names[key] = name
        return self._names[key]

    def field(self, key: str, value: Any, collapse: bool = True) -> str:
        return self._named((key, repr(value), collapse), lambda: super(LeafCompiler, self).field(key, value, collapse))

    def keywords(self, words: list[str]) -> str:
        return self._named(("keywords", repr(words)), lambda: super(LeafCompiler, self).keywords(words))

    @staticmethod
    def all_of(items: list[str], exact: bool) -> str:
        if len(items) == 1:
            return items[0]
        if not exact:
            return f"({' AND '.join(items)})"
        if all(x.isidentifier() for x in items[:-1]):  # short to write twice
            return reduce(lambda rest, x: f"if({x}, {rest}, {x})", reversed(items[:-1]), items[-1])
        numbers = ", ".join(f"get(array(0, 1000001, 2), coalesce(int({x}), 2)) + {4 * i}" for i, x in enumerate(items))
        return f"get(array(false, true, null), least({numbers}) % 4)"

    @staticmethod
    def any_of(items: list[str], exact: bool) -> str:
        if len(items) == 1:
            return items[0]
        return f"greatest({', '.join(items)})" if exact else f"({' OR '.join(items)})"

    @staticmethod
    def negated(item: str) -> str:
        return f"(NOT {item})"


def decimal_text(x: float) -> str:
    """A double the way rules write it: whole numbers without a fraction, no exponent."""
    from decimal import Decimal

    return str(int(x)) if x == int(x) else format(Decimal(repr(x)), "f")
